"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short and documents long, so Jaccard similarity says nothing; wanted is the share of an
item's word shingles that a document holds. Items are partitioned by the number of their shingles
(powers of two). The sketch of an item holds its smallest shingle hashes, as many as the upper bound
of its partition may miss, and one more: a document that holds enough of the item must hold one of
them. The largest hash of a partition's sketches bounds what a document has to look up there, and
documents with too few shingles for a partition skip it. Candidates are then verified by exact
containment, shingle by shingle as strings.

The items are the stated query set: they are broadcast in blocks of bounded size, and every block
is searched against all documents in a map-side pass of its own, without a shuffle of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, WordHashes, free_names, mixed, stored, text_bytes

#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 16 << 20
HIT = "array<struct<item_id:long,n_shingles:int,n_shared:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def shingles(words: list[bytes], n: int) -> set[bytes]:
    """Distinct n-word shingles; fewer words are one shingle, none is none."""
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def needed(count: int, share: float) -> int:
    return max(1, math.ceil(share * count - 1e-9))


class Block:
    """Sketches of a block of items, by partition."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int, share: float):
        self.n, self.share, self.words = n, share, WordHashes()
        self.items = [(i, s) for i, t in items if (s := shingles(t.lower().split(), n))]
        classes: dict[int, list[int]] = {}
        for k, (_, s) in enumerate(self.items):
            classes.setdefault(len(s).bit_length(), []).append(k)
        self.partitions = []
        for size, members in sorted(classes.items()):
            upper = max(len(self.items[k][1]) for k in members)
            least = min(needed(len(self.items[k][1]), share) for k in members)
            keep = upper - needed(upper, share) + 1
            pairs = [(h, k) for k in members for h in sorted(self._hash(s) for s in self.items[k][1])[:keep]]
            pairs.sort()
            hashes = np.array([h for h, _ in pairs], np.uint64)
            top = np.zeros(1 << 16, bool)
            top[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.partitions.append((least, hashes, np.array([k for _, k in pairs]), top, hashes[-1]))

    def _hash(self, shingle: bytes) -> int:
        words = shingle.split(b" ")
        return int(self.hashes(words, [len(words)])[0][0])

    def hashes(self, words: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of texts given as one list of words, and the text of each."""
        h = self.words.of(words, len(words))
        counts_ = np.asarray(counts, np.int64)
        per = np.where(counts_ >= self.n, counts_ - self.n + 1, np.minimum(counts_, 1))
        doc = np.repeat(np.arange(len(counts_)), per)
        first = np.cumsum(counts_) - counts_
        start = first[doc] + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        length = np.minimum(counts_[doc], self.n)
        out = length.astype(np.uint64)
        for j in range(self.n):
            on = j < length
            out = np.where(on, out * _BASE + h[np.minimum(start + j, max(0, len(h) - 1))], out)
        return mixed(out), doc

    def search(self, texts: list[bytes]) -> list[list[tuple]]:
        split = [t.lower().split() for t in texts]
        counts = [len(w) for w in split]
        found: list[list[tuple]] = [[] for _ in texts]
        if not self.items or not sum(counts):
            return found
        h, doc = self.hashes([w for ws in split for w in ws], counts)
        size = np.bincount(doc, minlength=len(texts))
        top = (h >> np.uint64(48)).astype(np.int64)
        candidates: set[tuple[int, int]] = set()
        for least, hashes, item, tops, most in self.partitions:
            at = np.flatnonzero(tops[top])
            at = at[(h[at] <= most) & (size[doc[at]] >= least)]
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            for j in np.flatnonzero(hi > lo):
                d = int(doc[at[j]])
                candidates.update((d, int(k)) for k in item[lo[j] : hi[j]])
        last, own = -1, set()
        for d, k in sorted(candidates):
            if d != last:
                last, own = d, shingles(split[d], self.n)
            item_id, s = self.items[k]
            both = len(s & own)
            if both >= needed(len(s), self.share):
                found[d].append((item_id, len(s), both))
        return found


def _blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about BLOCK_BYTES (a longer item is a block of its own)."""
    sized = items.select(F.col(item_id).cast("long").alias("i"), text_bytes(text).alias("t"))
    total = sized.agg(F.coalesce(F.sum(F.length("t") + 64), F.lit(0)).alias("b")).first().b
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        yield [(r.i, bytes(r.t)) for r in sized.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k).collect()]


def _searcher(sent: Broadcast):
    @F.pandas_udf(HIT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = sent.value
        for batch in batches:
            out: list = []
            texts: list[bytes] = []
            held = 0
            for t in batch:
                texts.append(t)
                held += len(t)
                if held > PIECE_BYTES // 4:
                    out += block.search(texts)
                    texts, held = [], 0
            out += block.search(texts) if texts else []
            yield pd.Series([[{"item_id": i, "n_shingles": a, "n_shared": b} for i, a, b in hits] for hits in out])

    return search


def _searches(items: DataFrame, text: str, item_id: str, n: int, share: float) -> Iterator[Callable[[Column], Column]]:
    """For each block of items the search as a function of a column of texts."""
    for block in _blocks(items, text, item_id):
        yield _searcher(items.sparkSession.sparkContext.broadcast(Block(block, n, share)))


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", n: int = 5, share: float = 0.8, into: str = "hits") -> DataFrame:
    """Add the items of which a document holds at least ``share`` of the ``n``-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than ``n`` words is
    one shingle, so such an item is found in texts equal to it; null and empty items and texts have
    none and give no hit. Repeated items are found each; a null item_id stays null; a column named as
    ``into`` is replaced; empty tables give no hit.

    A task holds one block of items. Further blocks each take a pass over the stored result of the
    one before.
    """
    (held,) = free_names(docs, "held_hits")
    out: DataFrame | None = None
    for search in _searches(items, item_text, item_id, n, share):
        if out is None:
            out = docs.withColumn(held, search(text_bytes(text)))
        else:
            out = stored(out, "hits").withColumn(held, F.concat(F.col(held), search(text_bytes(text))))
    same = [c for c in docs.columns if c.lower() == into.lower()]
    own = [F.col(held).alias(into) if c in same else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, *([] if same else [F.col(held).alias(into)]))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id", n: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every hit: one pass over the documents for each block
    of items. Cases are as in ``with_hits``."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("t"))
    passes = [whole.select("doc_id", F.explode(search(F.col("t"))).alias("h")).select("doc_id", "h.*") for search in _searches(items, item_text, item_id, n, share)]
    return reduce(DataFrame.unionAll, passes)
