"""Token counts by a map-side lookup in two tiers.

A text is cut into pre-tokens at places where the vocabulary can never merge: before a run of
spaces and before a line feed. The lengths of frequent pre-tokens come from a compact table that is
broadcast (its size is a parameter); all others are encoded once by a worker and kept in its cache.
No pre-token is shuffled: the pass that finds the frequent ones sends at most ``per_task`` of them
from each task, after counting every text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, text_bytes

MODEL = "piece_bpe_32k.model"
#: The mark that the model puts for a space; written in a text it is read as a space.
MARK = "▁"
UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Code points of the longest pre-token a worker's cache keeps: with its entries that bounds its bytes.
LONGEST_KEPT = 64
_CACHES: dict = {}


def units(text: str) -> list[str]:
    """Pre-tokens of a text, with the space that the model puts first; none for the empty text."""
    return UNIT.findall(" " + text.replace(MARK, " ")) if text else []


def check_vocabulary(model: sentencepiece.SentencePieceProcessor) -> None:
    """The cut is exact only if no piece holds a line feed, or a space after another character."""
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if "\n" in p or MARK in p.lstrip(MARK):
            raise ValueError(f"piece {p!r} can cross the border of a pre-token")


class PieceLengths(dict):
    """Pre-token to number of pieces; misses are encoded and kept, up to a number of entries and a length
    each (without spaces a pre-token is a whole line)."""

    def __init__(self, model_file: str, frequent: dict[str, int]):
        self.model, self.frequent = sentencepiece.SentencePieceProcessor(model_file=model_file), frequent
        super().__init__(frequent)

    def __missing__(self, unit: str) -> int:
        if unit[0] == "\n":  # the model puts its space first, which stays a piece of its own
            n = len(self.model.encode(unit)) - 1
        elif len(unit) == 1:
            n = 1
        else:
            n = len(self.model.encode(unit[1:]))
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(self.frequent)
            self[unit] = n
        return n


def frequent_units(docs: DataFrame, text: str = "text", per_task: int = 4096, most: int = 32768, longest: int = 48) -> list[str]:
    """The most frequent pre-tokens of the whole table (a table of bounded size)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(units(t.as_py().decode()))
            if len(seen) > CACHE_ENTRIES:  # rare ones go; a frequent one loses nothing that matters
                seen = Counter(dict(seen.most_common(CACHE_ENTRIES // 4)))
        top = [(u, n) for u, n in seen.most_common(per_task) if len(u) <= longest]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    found = docs.select(text_bytes(text)).mapInArrow(count, "unit string, n long")
    return [r.unit for r in found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(most).collect()]


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL, limit: int = 4096, into: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """Add the bytes and tokens of every text and whether it has more than ``limit`` tokens.

    Null and empty texts have none; a very long text is counted whole; repeated rows are counted each; columns named as in ``into`` are
    replaced; an empty table stays empty.
    """
    model_file = public_tokenizers.path(model)
    lengths = PieceLengths(model_file, {})
    check_vocabulary(lengths.model)
    frequent = docs.sparkSession.sparkContext.broadcast({u: lengths[u] for u in frequent_units(docs, text)})

    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = PieceLengths(model_file, frequent.value)
        get = _CACHES[key].__getitem__
        for batch in texts:
            yield pd.Series([sum(map(get, units(t))) for t in batch], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(into[1], n_tokens(whole)).withColumn(into[0], F.octet_length(whole).cast("long"))
    return out.withColumn(into[2], F.col(into[1]) > limit)
