"""Secret scans: fixed patterns, and a battery of randomness tests over all other tokens.

Ordinary words and identifiers repeat letters, stay within one kind of letter and put like beside like;
keys are drawn evenly. Every run of key characters is read in the smallest encoding that holds it, and
three tests ask whether its symbols could be even draws from that alphabet:

* chi-squared uniformity of the alphabet, with mean and variance exact for the length;
* runs above and below the middle of the alphabet (Wald and Wolfowitz);
* serial correlation of neighbours.

Fisher's method combines their two-sided p-values; a token that the battery refuses is no secret. One
that it accepts may still be an ordinary token, the likelier the shorter it is. So the null hypothesis
that it is ordinary is tested as well: pairs of neighbouring characters counted over the whole corpus
give the probability of the token as ordinary text, and that divided by its probability as even draws is
a valid p-value (a likelihood ratio exceeds x with a probability of at most 1/x). It falls with every
further symbol. Benjamini and Hochberg's procedure over all tokens of a range of lengths bounds the
share of ordinary ones among the reported ones by ``rate``, so short tokens are judged among their like.

What reaches the driver are two tables of fixed size: character pairs, and counts of p-values by length
range and power of ten.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, text_bytes

# fixed values: the patterns that always count, with the length a match (its second group) must have
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: The kinds in the order in which spans that start together are listed; ``random`` is the battery's.
KINDS = ("assign", "access", "hex", "random")

# fixed values: alphabets by name, the smaller first
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower26", "abcdefghijklmnopqrstuvwxyz"),
    ("upper26", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Lengths from each of these up to the next are judged together.
LENGTHS = np.array([16, 20, 24, 32, 40, 48, 64, 96, 128, 256])
#: The battery refuses a token below this p-value; p-values of being ordinary are counted to 10 ** -POWERS.
REFUSED, POWERS = 0.01, 300

_CODES = np.full((len(ENCODINGS), 128), -1, np.int64)
for _i, (_, _letters) in enumerate(ENCODINGS):
    _CODES[_i, [ord(c) for c in _letters]] = np.arange(len(_letters))
_SIZES = np.array([len(letters) for _, letters in ENCODINGS])


def encoding(token: bytes) -> int:
    """The first alphabet that holds the whole token; -1 if none does."""
    codes = _CODES[:, np.frombuffer(token, np.uint8)]
    held = (codes >= 0).all(axis=1)
    return int(held.argmax()) if held.any() else -1


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(codes: np.ndarray, size: int) -> float:
    """p-value of the chi-squared statistic: a scaled chi-squared variable with the statistic's exact mean
    and variance under even draws, by Wilson and Hilferty's cube root."""
    n = len(codes)
    counts = np.bincount(codes, minlength=size)
    chi = size / n * float((counts.astype(float) ** 2).sum()) - n
    spread = 2 * (n - 1) / (9 * (size - 1) * n)
    return _normal_two_sided(((max(chi, 0.0) / (size - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def runs(codes: np.ndarray, size: int) -> float:
    """p-value of the number of runs of symbols in the upper and the lower half of the alphabet."""
    up = codes >= size / 2
    n, a = len(up), int(up.sum())
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_two_sided((1 + int((up[1:] != up[:-1]).sum()) - mean) / np.sqrt(variance)) if variance > 0 else 1.0


def serial(codes: np.ndarray) -> float:
    """p-value of the correlation of each symbol with the one before (mean and variance of a shuffle)."""
    n = len(codes)
    x = codes - codes.mean()
    around = float((x * x).sum())
    if not around:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / around
    return _normal_two_sided((r + 1 / n) * np.sqrt(n))


def evenness(token: bytes, encoded: int) -> float:
    """The combined p-value of the battery for a token in an encoding."""
    codes, size = _CODES[encoded, np.frombuffer(token, np.uint8)], int(_SIZES[encoded])
    half = -sum(math.log(max(p, 1e-300)) for p in (uniformity(codes, size), runs(codes, size), serial(codes)))
    return math.exp(-half) * (1 + half + half * half / 2)  # twice half is chi-squared with six degrees of freedom


def ordinary_powers(token: bytes, encoded: int, pair_logs: np.ndarray) -> int:
    """k for a p-value of at most 10 ** -k that the token is ordinary; 0 where it is likelier so than not."""
    codes = np.frombuffer(b" " + token, np.uint8)
    logs = float(pair_logs[codes[:-1], codes[1:]].sum()) + len(token) * math.log10(_SIZES[encoded])
    return min(POWERS, max(0, math.floor(-logs)))


def character_pairs(texts: DataFrame) -> np.ndarray:
    """log10 of the probability of each ASCII character after another, counted over all texts (all
    other bytes as one character, white space as the space) and smoothed by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for piece in pieces(batch, "t"):
                c = np.frombuffer(b" " + b" ".join(piece.column("t").to_pylist()) + b" ", np.uint8).astype(np.int64)
                c[c > 127] = 0
                c[(c >= 9) & (c <= 13)] = 32
                seen += np.bincount(c[:-1] * 128 + c[1:], minlength=128 * 128)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pair", "n"])

    seen = np.ones(128 * 128)
    for r in texts.select("t").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        seen[r.pair] += r.n
    seen = seen.reshape(128, 128)
    return np.log10(seen / seen.sum(axis=1, keepdims=True))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each leftmost and without overlaps among its own."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]], pair_logs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(start, end, length range, powers of the ordinary p-value, battery's p-value) of key-like tokens
    that touch no fixed span."""
    marks = sorted((s, e) for s, _, e in taken)
    k, reach = 0, 0
    for m in TOKEN.finditer(text):
        while k < len(marks) and marks[k][0] < m.end():
            reach = max(reach, marks[k][1])
            k += 1
        if reach > m.start():
            continue
        token = m.group().encode()
        e = encoding(token)
        if e >= 0:
            powers = ordinary_powers(token, e, pair_logs)
            yield m.start(), m.end(), int(np.searchsorted(LENGTHS, len(token), side="right")) - 1, powers, evenness(token, e) if powers else 0.0


def thresholds(counts: dict[int, dict[int, int]], rate: float) -> dict[int, int]:
    """The smallest power reported in each length range, by Benjamini and Hochberg's step-up procedure
    over counted p-values; at least 1, and missing where nothing is reported."""
    out = {}
    for length, seen in counts.items():
        all_, beyond = sum(seen.values()), 0
        for power in sorted(seen, reverse=True):
            beyond += seen[power]
            if power and all_ * 10.0**-power <= rate * beyond:
                out[length] = power
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_TOKEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("length", pa.int32()), ("power", pa.int32()), ("p", pa.float64())])
_FOUND = "doc_id long, fixed array<struct<start:int,kind:int,end:int>>, tokens array<struct<start:int,end:int,length:int,power:int,p:double>>"


def find(texts: DataFrame, pair_logs: np.ndarray) -> DataFrame:
    """Of (doc_id, t): (doc_id, fixed, tokens), the spans of the fixed patterns and the tested tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                fixed, tokens = [], []
                for t in piece.column("t"):
                    text = t.as_py().decode()
                    own = fixed_spans(text)
                    fixed.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in own])
                    tokens.append([dict(zip(("start", "end", "length", "power", "p"), c, strict=True)) for c in candidates(text, own, pair_logs)])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fixed, pa.list_(_SPAN)), pa.array(tokens, pa.list_(_TOKEN))], ["doc_id", "fixed", "tokens"])

    return texts.mapInArrow(rows, _FOUND)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rate: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, counts of the fixed kinds, the digest of their spans,
    and all spans with those that the battery adds.

    Spans are code points, end exclusive. A null or empty text has none, and the digest is that of the
    empty text; repeated rows are scanned each and count each in the rates; a text of any length is
    scanned whole; further columns are ignored; an empty table gives no row.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("t"))
    found = stored(find(texts, character_pairs(texts)), "secret-spans")
    counts: dict[int, dict[int, int]] = {}
    for r in found.select(F.inline("tokens")).groupBy("length", "power").count().collect():
        counts.setdefault(r["length"], {})[r["power"]] = r["count"]
    firsts = thresholds(counts, rate)
    least = F.array(*[F.lit(firsts.get(b, POWERS + 1)) for b in range(len(LENGTHS))])
    even = F.filter("tokens", lambda x: (x["p"] >= REFUSED) & (x["power"] >= F.get(least, x["length"])))
    added = F.transform(even, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), x["end"].alias("end")))
    def number(kind: int) -> Column:
        return F.size(F.filter("fixed", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(number, range(3)), F.sha2(_listed(F.col("fixed")), 256).alias("base_sha256"), _listed(F.concat("fixed", added)).alias("spans"))
