"""Packing into fixed windows by Karmarkar-Karp multiway differencing.

Every task packs the documents of its own partition: no shuffle, and nothing crosses tasks. Whole
windows are cut off the front of a document. What remains is cut into items of at most ``item``
tokens and gathered into groups of about ``windows`` windows; a group is divided into near-equal
windows by merging partial partitions so that the fullest window of one meets the emptiest of the
other. If a window then holds more than the capacity, the group gets one window more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pieces, text_bytes
from .encoding import byte_bpe

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = pa.schema([*((n, pa.int64()) for n in "doc_id start length doc_tokens sequence_id offset".split()), ("ids", pa.binary())])


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, so that the sums of the windows are near-equal.

    A partial partition is the descending vector of its k sums less the smallest. The two with the
    widest spread are merged in opposite order until one is left; the orders met on the way then
    lead every item to its window.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    vectors: list = [None] * (2 * n - 1)
    merges: list[tuple[int, int, np.ndarray]] = []
    for i, s in enumerate(sizes):
        vectors[i] = np.zeros(k, np.int64)
        vectors[i][0] = s
    heap = [(-int(s) if k > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = vectors[a] + vectors[b][::-1]
        order = np.argsort(-total, kind="stable")
        v = total[order]
        v -= v[-1]
        node = n + len(merges)
        vectors[node], vectors[a], vectors[b] = v, None, None
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(v[0]), node))
    window, at = np.zeros(n, np.int64), {n + len(merges) - 1: np.arange(k)}
    for j in range(len(merges) - 1, -1, -1):
        a, b, order = merges[j]
        to = np.empty(k, np.int64)
        to[order] = at.pop(n + j)
        at[a], at[b] = to, to[::-1]
    for i in range(n):
        window[i] = at[i][0]
    return window


def near_equal(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of at most ``capacity``: as few as the sum needs, one more as long as one overflows."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window, k
        k += 1


class _Packer:
    """Packs the documents of one task in their order; numbers start at ``first``."""

    def __init__(self, first: int, capacity: int, windows: int, item: int):
        self.next, self.capacity, self.most, self.item = first, capacity, windows * capacity, item
        self.items: list[tuple[int, int, int, int, bytes]] = []
        self.held = 0
        self.rows: list[tuple] = []
        self.row_bytes = 0

    def _put(self, row: tuple) -> None:
        self.rows.append(row)
        self.row_bytes += len(row[-1])

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, c = len(ids), self.capacity
        whole = n - n % c
        for s in range(0, whole, c):
            self._put((doc_id, s, c, n, self.next, 0, ids[s : s + c].tobytes()))
            self.next += 1
        for s in range(whole, n, self.item):
            part = ids[s : s + self.item]
            self.items.append((doc_id, s, len(part), n, part.tobytes()))
            self.held += len(part)
        if self.held >= self.most:
            self.close()

    def close(self) -> None:
        if not self.items:
            return
        window, k = near_equal(np.array([x[2] for x in self.items]), self.capacity)
        filled = np.zeros(k, np.int64)
        last: dict[int, list] = {}  # neighbours of one document in one window become one piece
        for w, (doc_id, s, n, of, ids) in zip(window.tolist(), self.items, strict=True):
            p = last.get(w)
            if p is not None and p[0] == doc_id and p[1] + p[2] == s and p[3] == of:
                p[2] += n
                p[6].append(ids)
            else:
                if p is not None:
                    self._put((*p[:6], b"".join(p[6])))
                last[w] = [doc_id, s, n, of, self.next + w, int(filled[w]), [ids]]
            filled[w] += n
        for p in last.values():
            self._put((*p[:6], b"".join(p[6])))
        self.next += k
        self.items, self.held = [], 0

    def taken(self) -> pa.RecordBatch:
        rows, self.rows, self.row_bytes = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FIELDS)], schema=_FIELDS)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 0, windows: int = 64, item: int = 96) -> DataFrame:
    """Pieces of all documents, each with its ids (little-endian unsigned 32-bit) and its place.

    A document is its token ids followed by ``end_id``; a null or empty text is that id alone, so it
    is packed as well. Repeated rows are packed each; a null doc_id stays null; an empty table gives
    no piece. ``sequence_id`` is unique, ``offset`` counts from 0 without gaps.
    """
    path = public_tokenizers.path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path)
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, windows, item)
        for batch in batches:
            for piece in pieces(batch, "t"):
                for i, t in zip(piece.column("i").to_pylist(), piece.column("t"), strict=True):
                    packer.add(i, np.array([*encode(t.as_py().decode()), end_id], np.uint32))
                    if packer.row_bytes > 4 << 20:
                        yield packer.taken()
        packer.close()
        yield packer.taken()

    return docs.select(docs[doc_id].cast("long").alias("i"), text_bytes(text).alias("t")).mapInArrow(run, SCHEMA)
