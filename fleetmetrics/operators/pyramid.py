"""A roll-up pyramid: windows of any length and end from a logarithmic number of stored states.

Level 0 holds one state for each (series, base cell), every further level merges ``fan`` cells of the
one below. A window is covered by the coarsest whole cells that fit, at most ``2 * (fan - 1)`` of each
level, and by raw samples where it begins or ends inside a base cell. Cells are half open like windows,
``(end - size, end]``, and numbered by their end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..timeutil import ceil_div, instant_micros, micros
from .windows import _FINAL, _NEEDS, _PARTIAL


@dataclass(frozen=True)
class Pyramid:
    path: str
    base: int  # microseconds of a base cell
    levels: int
    fan: int = 4
    keys: tuple[str, ...] = ("series_key",)

    def size(self, level: int) -> int:
        return self.base * self.fan**level

    def build(self, samples: DataFrame, value: str = "value", ts: str = "ts") -> None:
        """Store all levels; each is merged from the stored one below, so samples are read once."""
        spark = samples.sparkSession
        flat = _flat(samples, self.keys, value, ts)
        now = flat.groupBy(*self.keys, ceil_div(F.col("_u"), self.base).alias("cell")).agg(*[make().alias(p) for p, (make, _) in _PARTIAL.items()])
        for level in range(self.levels):
            if level:
                now = spark.read.parquet(self._folder(level - 1)).groupBy(*self.keys, ceil_div(F.col("cell"), self.fan).alias("cell")).agg(*[merge().alias(p) for p, (_, merge) in _PARTIAL.items()])
            # in order of time, so that a range of cells prunes row groups
            now.repartitionByRange("cell", *self.keys).sortWithinPartitions("cell").write.mode("overwrite").parquet(self._folder(level))

    def _folder(self, level: int) -> str:
        return f"{self.path}/level={level}"

    def cover(self, start: int, end: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """Ranges of cells ``(level, first, last)`` and of raw time ``(start, end]`` that make up a window."""
        lo, hi = -(-start // self.base), end // self.base  # cells lo + 1 .. hi lie inside
        if lo >= hi:
            return [], [(start, end)] if start < end else []
        raw = [x for x in ((start, lo * self.base), (hi * self.base, end)) if x[0] < x[1]]
        return list(self._cells(0, lo, hi)), raw

    def _cells(self, level: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """Cells lo + 1 .. hi of a level, as many as possible from the levels above."""
        up_lo, up_hi = -(-lo // self.fan), hi // self.fan
        if level + 1 >= self.levels or up_lo >= up_hi:
            if lo < hi:
                yield level, lo + 1, hi
            return
        if lo < up_lo * self.fan:
            yield level, lo + 1, up_lo * self.fan
        if up_hi * self.fan < hi:
            yield level, up_hi * self.fan + 1, hi
        yield from self._cells(level + 1, up_lo, up_hi)

    def cells(self, start: int, end: int) -> int:
        """How many cells of a series a window reads at most."""
        return sum(last - first + 1 for _, first, last in self.cover(start, end)[0])

    def window(self, spark: SparkSession, samples: DataFrame, end, span, fns: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
        """``<fn>_over_time`` of the one window ``(end - span, end]``, for the functions of ``over_time``."""
        hi = instant_micros(end)
        cells, raw = self.cover(hi - micros(span), hi)
        parts = [p for p in _PARTIAL if any(p in _NEEDS[f] for f in fns)]
        states = [spark.read.parquet(self._folder(level)).where(F.col("cell").between(first, last)).select(*self.keys, *parts) for level, first, last in cells]
        if raw:
            inside: Column = F.lit(False)
            for a, b in raw:  # bare comparisons of the stored column, which reach the scan
                inside = inside | ((F.col(ts) > F.timestamp_micros(F.lit(a))) & (F.col(ts) <= F.timestamp_micros(F.lit(b))))
            ends = _flat(samples.where(inside), self.keys, value, ts)
            states.append(ends.groupBy(*self.keys).agg(*[_PARTIAL[p][0]().alias(p) for p in parts]))
        if not states:
            raise ValueError("the window is empty")
        out = states[0]
        for s in states[1:]:
            out = out.unionByName(s)
        merged = out.groupBy(*self.keys).agg(*[_PARTIAL[p][1]().alias(p) for p in parts])
        return merged.select(*self.keys, *[_FINAL[f]().alias(f) for f in fns])


def _flat(samples: DataFrame, keys: Sequence[str], value: str, ts: str) -> DataFrame:
    return samples.where(F.col(value).isNotNull()).select(*keys, F.unix_micros(ts).alias("_u"), F.col(value).cast("double").alias("_v"))
