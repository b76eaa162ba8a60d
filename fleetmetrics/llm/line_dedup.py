"""Line dedup by winnowing over line hashes.

Lines with a word are hashed; a window is a shortest run of lines with ``min_words`` words, ending at
a line or beginning at one. A run repeated elsewhere with that many words has the same windows inside,
and each window selects the smallest of its line hashes, so both copies select a common fingerprint:
no repeated run goes unnoticed. Positions of fingerprints are joined over documents; a fingerprint
in two documents extends to all windows around it, to either side, and windows equal over all their
lines chain up to the whole repeated run. Every line of a run that an earlier place has as well is
deleted. Places are ordered by doc_id, then position; all are judged on the input.

Only hashes and word counts of lines are joined, a few bytes a line; texts move once, to meet the
list of their deleted lines. A line that a third of all documents share is one row after the partial
aggregation of each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free_names, pieces, stored, text_bytes

#: Words of the shortest run that is deleted unless said otherwise; with 1, any repeated line with a word is.
MIN_WORDS = 8
_HALF = 2**64 - 1


def line_hashes(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Number, 128-bit hash and words of every line that has a word (outer white space aside)."""
    at, hashes, words = [], [], []
    for k, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        if n:
            at.append(k)
            hashes.append(xxhash.xxh3_128_intdigest(line.strip()))
            words.append(n)
    return at, hashes, words


def halves(hashes: list[int]) -> list[np.ndarray]:
    """The upper and lower 64 bits of hashes; windows select among the upper ones, runs compare both."""
    return [np.array([x >> shift & _HALF for x in hashes], np.uint64).view(np.int64) for shift in (64, 0)]


def windows(words: list[int], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Shortest runs (start, end) with ``least`` words: for each end, and for each start, that has one."""
    ending, beginning = [], []
    start, total = 0, 0
    for j, n in enumerate(words):
        total += n
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            ending.append((start, j + 1))
    end, total = 0, 0
    for i in range(len(words)):
        while end < len(words) and total < least:
            total += words[end]
            end += 1
        if total < least:
            break
        beginning.append((i, end))
        total -= words[i]
    return ending, beginning


def fingerprints(hashes: list[int], ending: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest line hash of each window, by the window's end (winnowing with a sliding minimum)."""
    out: dict[int, int] = {}
    line: list[int] = []  # positions with ascending hashes
    head = at = 0
    for s, e in ending:
        while at < e:
            while len(line) > head and hashes[line[-1]] > hashes[at]:
                line.pop()
            line.append(at)
            at += 1
        while line[head] < s:
            head += 1
        out[e] = hashes[line[head]]
    return out


def window_keys(hashes: list[int], spans: list[tuple[int, int]]) -> list[bytes]:
    data = b"".join(x.to_bytes(16) for x in hashes)
    return [xxhash.xxh3_128_digest(data[16 * s : 16 * e]) for s, e in spans]


def repeats_within(hashes: list[int], spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, bytes]]]:
    """Windows that the text has had before, and the first place and key of each window."""
    seen: set[bytes] = set()
    again, first = [], []
    for (s, e), key in zip(spans, window_keys(hashes, spans), strict=True):
        if key in seen:
            again.append((s, e))
        else:
            seen.add(key)
            first.append((s, e, key))
    return again, first


def _spans(words: list[int], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """All windows in text order, and those that are shortest for their end."""
    ending, beginning = windows(words, least)
    return sorted({*ending, *beginning}), ending


def deleted(text: bytes, runs: list[tuple[int, int]], least: int) -> set[int]:
    """Numbers of the lines to delete: of ``runs`` found elsewhere and of repeats within the text."""
    at, hashes, words = line_hashes(text)
    again, _ = repeats_within(hashes, _spans(words, least)[0])
    mark = np.zeros(len(at) + 1, np.int64)
    for s, e in [*again, *runs]:
        mark[s] += 1
        mark[e] -= 1
    return {at[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) > 0)}


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, tie, starts, ends): for each document its windows that a document with a smaller doc_id has."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t"):
                rows = [(*halves(h), w) for _, h, w in (line_hashes(t.as_py()) for t in piece.column("t"))]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("tie"), *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["id", "tie", "h", "h2", "w"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, prints = [], [], []
            for i, tie, h, w in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "h", "w")), strict=True):
                own = set(fingerprints(h, windows(w, min_words)[0]).values())
                ids += [i] * len(own)
                ties += [tie] * len(own)
                prints += own
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(ids, pa.int64()), pa.array(ties, pa.int64())], ["fp", "id", "tie"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            keys: list[bytes] = []
            for i, tie, h, h2, w, near in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "h", "h2", "w", "near")), strict=True):
                spans, ending = _spans(w, min_words)
                shared, of = set(near), fingerprints(h, ending)
                hashes = [(a & _HALF) << 64 | b & _HALF for a, b in zip(h, h2, strict=True)]
                for s, e, key in repeats_within(hashes, [x for x in spans if of[x[1]] in shared])[1]:
                    rows.append((i, tie, s, e))
                    keys.append(key)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["k1", "k2", "id", "tie", "s", "e"])

    texts = docs.select(doc_key(doc_id).alias("id"), F.xxhash64(text).alias("tie"), text_bytes(text).alias("t"))
    lines = stored(texts.mapInArrow(hashed, "id long, tie long, h array<long>, h2 array<long>, w array<int>").where(F.size("h") > 0), "lines")
    if not lines.groupBy("id", "tie").count().where("count > 1").isEmpty():
        lines = stored(lines.dropDuplicates(["id", "tie"]), "unlike-lines")  # equal rows have the same runs
    prints = lines.select("id", "tie", "h", "w").mapInArrow(select, "fp long, id long, tie long")
    # stored, so that a join that meets a hot line has two plain sides and can be split
    shared = stored(prints.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("fp"), "shared-lines")
    near = stored(prints.join(shared, "fp").groupBy("id", "tie").agg(F.collect_set("fp").alias("near")), "near-lines")
    found = stored(lines.join(near, ["id", "tie"]).select("id", "tie", "h", "h2", "w", "near").mapInArrow(extend, "k1 long, k2 long, id long, tie long, s int, e int"), "line-windows")
    first = stored(found.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("k1", "k2", "lo"), "first-lines")
    later = found.join(first, ["k1", "k2"]).where("id > lo").select("id", "tie", F.struct("s", "e").alias("run")).distinct()
    return later.groupBy("id", "tie").agg(F.collect_list("run").alias("runs"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, removed: str = "n_removed_lines") -> DataFrame:
    """Delete later repeated runs of lines with at least ``min_words`` words; ``removed`` counts lines.

    Null texts stay null, and lines without words stay where they are. A null doc_id sorts last, and
    rows with equal or null doc_id are not earlier than one another; equal rows lose the same lines.
    All other columns are kept, a column named as ``removed`` is replaced, an empty table stays empty.
    """
    found = stored(repeated_runs(docs, text, doc_id, min_words), "line-runs")
    own_id, own_tie, id_, tie, runs, done = free_names(docs, "own_id", "own_tie", "id", "tie", "runs", "cut")
    found = found.select(F.col("id").alias(id_), F.col("tie").alias(tie), F.col("runs").alias(runs))

    @F.pandas_udf("text string, n long")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out, counts = [], []
        for t, r in zip(texts, found, strict=True):
            gone = deleted(t, [(x["s"], x["e"]) for x in r] if r is not None else [], min_words)
            lines = t.split(b"\n")
            out.append(b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode() if gone else t.decode())
            counts.append(len(gone))
        return pd.DataFrame({"text": out, "n": counts})

    keyed = docs.withColumns({own_id: doc_key(doc_id), own_tie: F.xxhash64(text)})
    joined = keyed.join(found, (F.col(own_id) == F.col(id_)) & (F.col(own_tie) == F.col(tie)), "left")
    made = joined.withColumn(done, cut(text_bytes(text), F.col(runs)))
    kept = [F.when(F.col(text).isNotNull(), F.col(f"{done}.text")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != removed]
    return made.select(*kept, F.col(f"{done}.n").alias(removed))
