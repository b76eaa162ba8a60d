"""Chat formatting by columnar byte assembly.

Turns are sorted by range on (conversation, turn), so a conversation with very many turns is spread
over tasks. Each task lays the turns of an Arrow batch into one preallocated buffer: the lengths of
all segments give their offsets, the offsets give the place of every byte, and headers and texts are
copied with one scatter each. The rows of the result are slices of that buffer.

A turn reads ``<|turn|>role<|text|>text<|end|>\\n``. Control strings inside roles and texts, those of
other templates too, are broken by an escape byte after their first character, and an escape byte of
the text is doubled; ``unescape`` reverses both.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>\n"
ESCAPE = 0x10
#: An escape goes after the first byte of each of these: the escape itself, and control strings. "<|"
#: opens every mark above; the others are those that chat templates in common use put around turns.
_BREAK = re.compile(rb"\x10|<(?:\||s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>)|\[/?INST\]")
SCHEMA = "conv_id long, turn long, seq long, n_turns long, formatted binary, loss array<struct<start:int,length:int>>"


def unescape(data: bytes) -> bytes:
    return re.sub(rb"\x10(\x10?)", rb"\1", data)


def _scatter(out: np.ndarray, source: np.ndarray, src: np.ndarray, length: np.ndarray, dst: np.ndarray) -> None:
    """Copy segments (start ``src``, ``length``) of ``source`` to ``dst`` in ``out``."""
    total = int(length.sum())
    ends = np.cumsum(length)
    within = np.arange(total) - np.repeat(ends - length, length)
    out[np.repeat(dst, length) + within] = source[np.repeat(src, length) + within]


def _escaped(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column with escapes put in, and start and length of each value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = (memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b"")
    offsets = offsets - offsets[0]
    source = np.frombuffer(raw, np.uint8)
    found = np.array([m.span() for m in _BREAK.finditer(raw)], np.int64).reshape(-1, 2)
    within = offsets[np.searchsorted(offsets, found[:, 0], side="right")] >= found[:, 1] if len(found) else np.zeros(0, bool)
    cut = found[within, 0] + 1  # a match over the border of two values is none
    before = np.searchsorted(cut, offsets, side="right")  # escapes up to each border
    out = np.full(len(source) + len(cut), ESCAPE, np.uint8)
    out[np.arange(len(source)) + np.searchsorted(cut, np.arange(len(source)), side="right")] = source
    moved = offsets + before
    return out, moved[:-1], np.diff(moved)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer; where each begins (and the last ends); text start and length."""
    n = len(roles)
    marks = np.frombuffer(TURN + TEXT + END, np.uint8)
    mark_start = np.array([0, len(TURN), len(TURN) + len(TEXT)])
    mark_length = np.array([len(TURN), len(TEXT), len(END)])
    role, role_start, role_length = _escaped(roles)
    text, text_start, text_length = _escaped(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = mark_length
    lengths[:, 1], lengths[:, 3] = role_length, text_length
    ends = np.cumsum(lengths.ravel())
    at = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for j in range(3):
        _scatter(out, marks, np.full(n, mark_start[j]), lengths[:, 2 * j], at[:, 2 * j])
    _scatter(out, role, role_start, role_length, at[:, 1])
    _scatter(out, text, text_start, text_length, at[:, 3])
    return out, np.append(at[:, 0], len(out)), at[:, 3], text_length


def format_conversations(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted conversations in parts: a run of turns of one conversation from one Arrow batch.

    The parts of a conversation in the order of (turn, seq) are its formatted text. ``loss`` has the
    byte spans, within a part, of the texts of the roles in ``learn``. Null roles and texts are
    empty; a null conv_id is a conversation of its own and a null turn comes first; turns with equal
    numbers go by role, then text, and repeated rows stay; further columns are ignored.
    """
    loss_roles = {r.encode() for r in learn}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out, starts, text_start, text_length = assemble(batch.column("role"), batch.column("text"))
            conv, turn, roles = batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist(), batch.column("role").to_pylist()
            first = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1])]
            bounds = [*first, len(conv)]
            offsets = starts[np.array(bounds)].astype(np.int32)
            formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
            loss = [[{"start": int(text_start[i] - starts[a]), "length": int(text_length[i])} for i in range(a, b) if roles[i] in loss_roles] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                pa.array([conv[i] for i in first], pa.int64()), pa.array([turn[i] for i in first], pa.int64()), pa.array(range(seq, seq + len(first)), pa.int64()),
                pa.array(np.diff(bounds), pa.int64()), formatted, pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
            ], ["conv_id", "turn", "seq", "n_turns", "formatted", "loss"])
            seq += len(first)

    whole = [F.coalesce(F.col(c), F.lit("")).cast("binary").alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *whole)
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SCHEMA)


_TURN = re.compile(rb"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of every turn, as they were."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digest(parts: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row each, with hashes over all its parts in order.

    A hash needs the parts of a conversation in order, so they come to one task, which holds one
    part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[tuple] = []

        def closed() -> tuple:
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        def chars(b: bytes) -> int:
            return len(b.decode())

        for batch in batches:
            for conv, part, spans in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss"), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = part.as_py()
                for role, text in parse(data):
                    now[1] += 1
                    now[2].update(role + b"\n" + text + b"\n")
                for s in spans.as_py():
                    learnt = unescape(data[s["start"] : s["start"] + s["length"]])
                    now[3] += chars(learnt)
                    now[4].update(learnt)
                now[5] += chars(data)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=fields)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, closed(), strict=True))], schema=fields)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fields = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
    ordered = parts.select("conv_id", "turn", "seq", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
