"""Substring dedup by difference-cover anchors.

Wanted are the words inside windows of 50 consecutive words whose sequence also starts in a document
with a smaller doc_id. Hashing every window is avoided: a difference cover D of period P has, for any
two positions i and j, a shift d < P with both i + d and j + d in D modulo P. So two equal windows of
50 words hold an equal anchor, 50 - (P - 1) words long, that begins at a cover position of both
documents. With P = 31 and six residues, 19 % of the positions are hashed.

1. Anchors are aggregated by hash, with the smallest and largest doc_id and the smallest and largest
   hash of their surroundings (all words that any window over the anchor can hold). One partial row
   for each task and anchor leaves a task, so copies cost little.
2. Anchors in two documents are joined back to their places. Where all surroundings agree, the match
   extends over all of them: every window over the anchor is in the smallest document as well, and
   nothing else is compared. Else the anchor extends to the windows around it, but for those already
   told that way, and their 128-bit hashes are aggregated to the smallest doc_id and joined back.
3. The covered words of each document are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, doc_key, mixed, pieces, stored, text_bytes

WINDOW = 50
# fixed values: a perfect difference set modulo 31
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - (PERIOD - 1)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Hasher:
    """Word hashes of many texts and rolling hashes over them; kept while a task runs."""

    def __init__(self):
        self.words, self.one, self.two = WordHashes(), Rolling(_B1), Rolling(_B2)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two prefix sums over the words of all texts in a row, and where each text begins."""
        flat: list[bytes] = []
        borders = [0]
        for t in texts:
            flat += t.split()
            borders.append(len(flat))
        h = self.words.of(flat, len(flat))
        return self.one.prefix(h), self.two.prefix(mixed(h + np.uint64(_B1))), np.array(borders, np.int64)


def anchors(hasher: Hasher, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position, hash and hash of the surroundings of every anchor."""
    p1, p2, borders = hasher.texts(texts)
    n = np.diff(borders)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(borders[-1])
    local = at - borders[:-1][doc]
    on = _IN_COVER[local % PERIOD] & (local + ANCHOR <= n[doc]) & (n[doc] >= WINDOW)
    doc, at, local = doc[on], at[on], local[on]
    left = np.minimum(local, PERIOD - 1)
    right = np.minimum(n[doc] - local, WINDOW)
    around = hasher.two.ranges(p2, at - left, at + right) ^ mixed((left * 64 + right).astype(np.uint64))
    return doc, local, hasher.one.ranges(p1, at, at + ANCHOR), around


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for piece in pieces(batch, "t"):
            doc, local, a, around = anchors(hasher, piece.column("t").to_pylist())
            ids, ties = np.asarray(piece.column("id")), np.asarray(piece.column("tie"))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[doc]), pa.array(ties[doc]), pa.array(local.astype(np.int32))], ["a", "c", "id", "tie", "pos"])


def _over(places: np.ndarray, last: int) -> np.ndarray:
    """Whether the window at each start up to ``last`` holds one of the anchors at ``places``."""
    mark = np.zeros(last + 2, np.int64)
    np.add.at(mark, np.maximum(places - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(places, last) + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for piece in pieces(batch, "t"):
            p1, p2, borders = hasher.texts(piece.column("t").to_pylist())
            starts, owner = [], []
            for k, found in enumerate(piece.column("places")):
                places = np.asarray(found.values)
                last = int(borders[k + 1] - borders[k]) - WINDOW
                s = np.flatnonzero(_over(places[places & 1 == 1] >> 1, last) & ~_over(places[places & 1 == 0] >> 1, last))
                starts.append(s)
                owner.append(np.full(len(s), k))
            s, k = np.concatenate(starts), np.concatenate(owner)
            at = borders[:-1][k] + s
            ids, ties = np.asarray(piece.column("id")), np.asarray(piece.column("tie"))
            yield pa.RecordBatch.from_arrays([pa.array(hasher.one.ranges(p1, at, at + WINDOW).view(np.int64)), pa.array(hasher.two.ranges(p2, at, at + WINDOW).view(np.int64)), pa.array(ids[k]), pa.array(ties[k]), pa.array(s.astype(np.int32))], ["k1", "k2", "id", "tie", "s"])


def covered(n: int, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of ``n`` words are covered: by all windows over the anchors at ``places`` whose
    surroundings agree everywhere (even numbers, halved), and by the windows at ``starts``."""
    mark = np.zeros(n + 1, np.int64)
    whole = places[places & 1 == 0] >> 1
    np.add.at(mark, np.maximum(whole - (PERIOD - 1), 0), 1)
    np.add.at(mark, np.minimum(whole + WINDOW, n), -1)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return np.cumsum(mark[:-1]) > 0


def find_repeats(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, tie, t): (id, tie, places) of anchors that matter, and (id, tie, starts) of windows that
    a smaller id has, apart from those that the places tell already."""
    found = texts.mapInArrow(_anchor_rows, "a long, c long, id long, tie long, pos int")
    known = found.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("lo < hi")
    # stored, so that a join that meets a hot anchor or window has two plain sides and can be split
    shared = stored(known.select("a", "lo", (F.col("c0") != F.col("c1")).alias("several")), "shared-anchors")
    at = found.select("a", "id", "tie", "pos").join(shared, "a").where("several or id > lo")
    place = F.col("pos").cast("long") * 2 + F.col("several").cast("int")
    places = stored(at.groupBy("id", "tie").agg(F.collect_list(place).alias("places")), "anchors")
    open_ = places.where(F.exists("places", lambda x: x % 2 == 1))
    windows = stored(texts.join(open_, ["id", "tie"]).select("id", "tie", "t", "places").mapInArrow(_window_rows, "k1 long, k2 long, id long, tie long, s int"), "windows")
    first = stored(windows.groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("k1", "k2", "lo"), "first-windows")
    starts = windows.join(first, ["k1", "k2"]).where("id > lo").groupBy("id", "tie").agg(F.collect_list("s").alias("starts"))
    return places, stored(starts, "starts")


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed, kept_sha256) of every row, kept words joined by one space.

    Words are runs without ASCII white space, unchanged. Null and empty texts have none; a null
    doc_id is larger than any other, and rows with equal or null doc_id are not smaller than one
    another; equal rows lose the same words; further columns are ignored; an empty table gives no row.
    """
    texts = docs.select(doc_key(doc_id).alias("id"), F.xxhash64(text).alias("tie"), text_bytes(text).alias("t"))
    places, starts = find_repeats(texts)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), doc_key(doc_id).alias("id"), F.xxhash64(text).alias("tie"), text_bytes(text).alias("t"))
    joined = own.join(places, ["id", "tie"], "left").join(starts, ["id", "tie"], "left")

    @F.pandas_udf("kept_text string, n_words long, n_removed long, kept_sha256 string")
    def cut(data: pd.Series, places: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, p, s in zip(data, places, starts, strict=True):
            words = t.split()
            kept = words
            if p is not None or s is not None:
                gone = covered(len(words), np.asarray([] if p is None else p, np.int64), np.asarray([] if s is None else s, np.int64))
                kept = [words[i] for i in np.flatnonzero(~gone)]
            out = b" ".join(kept)
            rows.append((out.decode(), len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest()))
        return pd.DataFrame(rows, columns=["kept_text", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", cut("t", "places", "starts").alias("r")).select("doc_id", "r.*")
