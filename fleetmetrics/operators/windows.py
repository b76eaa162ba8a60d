"""Instant and range vectors on a step grid.

A sample at ``u`` belongs to the half-open window ``(t - w, t]`` of every grid instant
``t = k * step`` with ``u <= t < u + w``.  The time line is cut at every grid instant and, if the
window is no whole number of steps, also where windows begin, ``w mod step`` before it.  Every
window is then a whole number of these buckets, of which a step has two at most, whatever window and
step are.  Samples are folded into buckets first, on the map side, and windows are put together from
bucket states by doubling: about log2(buckets) merges on one partitioning, without a range join.
Buckets are keyed by (series, time), which also splits a series that holds a large share of all rows.

Samples must be unique per (series, ts); ``streaming.ingest.dedupe`` and ``dedupe`` below see to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..timeutil import ceil_div, floor_div, instant_micros, micros
from .selectors import largest


@dataclass(frozen=True)
class Grid:
    """Evaluation instants ``k * step`` (microseconds since the epoch) from start to end."""

    step: int
    start: int
    end: int

    @staticmethod
    def of(step, start, end) -> Grid:
        return Grid(micros(step), instant_micros(start), instant_micros(end))

    @property
    def first(self) -> int:
        return -(-self.start // self.step)

    @property
    def last(self) -> int:
        return self.end // self.step


def dedupe(samples: DataFrame, keys: Sequence[str] = ("series_key",), value: str = "value", ts: str = "ts") -> DataFrame:
    """One value per (series, ts): the largest, so that the result does not depend on row order."""
    return samples.groupBy(*keys, ts).agg(F.max(value).alias(value))


def _in_reach(samples: DataFrame, keys: Sequence[str], grid: Grid, w: int, value: str, ts: str, offset: int) -> DataFrame:
    lo, hi = grid.first * grid.step - w - offset, grid.last * grid.step - offset
    c = F.col(ts)
    return (
        samples.where((c > F.timestamp_micros(F.lit(lo))) & (c <= F.timestamp_micros(F.lit(hi))) & F.col(value).isNotNull())
        .select(*keys, (F.unix_micros(c) + F.lit(offset)).alias("_u"), F.col(value).cast("double").alias("_v"))
    )


@dataclass(frozen=True)
class Cuts:
    """Numbered buckets that every window of length ``w`` on a grid of ``step`` is a whole number of."""

    step: int
    w: int

    @property
    def rest(self) -> int:
        return self.w % self.step

    @property
    def per_step(self) -> int:
        return 2 if self.rest else 1

    @property
    def length(self) -> int:
        """Buckets of a window; its last bucket ends at the grid instant."""
        whole = self.w // self.step
        return 2 * whole + 1 if self.rest else whole

    def index(self, u: Column) -> Column:
        """The bucket that holds the instant ``u``."""
        k = ceil_div(u, self.step)
        if not self.rest:
            return k
        return k * 2 - (u <= k * F.lit(self.step) - F.lit(self.rest)).cast("bigint")

    def end(self, x: Column) -> Column:
        """The instant at which bucket ``x`` ends."""
        if not self.rest:
            return x * F.lit(self.step)
        return ceil_div(x, 2) * F.lit(self.step) - F.pmod(x, F.lit(2)) * F.lit(self.rest)


Merge = Callable[[DataFrame, Sequence[str]], DataFrame]
Shift = Callable[[DataFrame, Column], DataFrame]


def _slide(states: DataFrame, keys: Sequence[str], grid: Grid, cuts: Cuts, merge: Merge, shift: Shift | None = None) -> DataFrame:
    """States of buckets ``_x`` merged to one state for each (series, grid number ``_k``).

    Level i holds, at every bucket, the state of the 2**i buckets that end there; two neighbours make
    the next level.  A window is the disjoint union of the levels that its length has as binary
    digits.  Levels (``_r`` = 0) and finished parts of windows (``_r`` = 1) travel in one frame,
    which is partitioned by series once; its size per series follows the time span.  ``shift``
    re-bases states that are relative to their bucket end by a number of seconds.
    """
    length, per_step = cuts.length, cuts.per_step
    first, last = grid.first * per_step, grid.last * per_step
    if length == 1:
        own = states.where(F.col("_x").between(first, last) & (F.pmod("_x", F.lit(per_step)) == 0))
        return own.withColumn("_k", floor_div(F.col("_x"), per_step)).drop("_x")
    cols = [c for c in states.columns if c not in (*keys, "_x")]
    cur = states.select(*keys, F.lit(0).alias("_r"), "_x", *cols).repartition(*keys)
    done = 0
    for i in range(length.bit_length()):
        size, x = 1 << i, F.col("_x")
        parts = []
        if length >> (i + 1):
            parts += [F.struct(F.lit(0).alias("r"), (x + F.lit(d)).alias("x")) for d in (0, size)]
        if length >> i & 1:
            parts.append(F.struct(F.lit(1).alias("r"), (x + F.lit(done)).alias("x")))
            done += size
        keep = F.array(F.struct(F.col("_r").alias("r"), x.alias("x")))
        moved = cur.select(*keys, *cols, "_x", F.explode(F.when(F.col("_r") == 0, F.array(*parts)).otherwise(keep)).alias("_e"))
        on_grid = (F.col("_e.r") == 0) | (F.pmod(F.col("_e.x"), F.lit(per_step)) == 0)
        moved = moved.where((F.col("_e.x") <= F.lit(last)) & on_grid)
        if shift is not None:
            moved = shift(moved, (cuts.end(F.col("_e.x")) - cuts.end(F.col("_x"))) / F.lit(1e6))
        moved = moved.select(*keys, *cols, F.col("_e.r").alias("_r"), F.col("_e.x").alias("_x"))
        cur = merge(moved, [*keys, "_r", "_x"])
    out = cur.where((F.col("_r") == 1) & (F.col("_x") >= F.lit(first)))
    return out.withColumn("_k", floor_div(F.col("_x"), per_step)).drop("_r", "_x")


# partial state -> (per-bucket aggregate, merge of bucket aggregates)
_PARTIAL = {
    "n": (lambda: F.count("_v"), lambda: F.sum("n")),
    "s": (lambda: F.sum("_v"), lambda: F.sum("s")),
    "lo_v": (lambda: F.min("_v"), lambda: F.min("lo_v")),
    "hi_v": (lambda: largest(F.col("_v")), lambda: largest(F.col("hi_v"))),
    "last_u": (lambda: F.max("_u"), lambda: F.max("last_u")),
    "last_v": (lambda: F.max_by("_v", "_u"), lambda: F.max_by("last_v", "last_u")),
    "first_u": (lambda: F.min("_u"), lambda: F.min("first_u")),
    "first_v": (lambda: F.min_by("_v", "_u"), lambda: F.min_by("first_v", "first_u")),
}
_NEEDS = {
    "avg": ("n", "s"), "sum": ("s",), "count": ("n",), "min": ("lo_v",), "max": ("hi_v",),
    "last": ("last_u", "last_v"), "last_ts": ("last_u",), "first": ("first_u", "first_v"),
}
_FINAL = {
    "avg": lambda: F.col("s") / F.col("n"), "sum": lambda: F.col("s"), "count": lambda: F.col("n"),
    "min": lambda: F.col("lo_v"), "max": lambda: F.col("hi_v"), "last": lambda: F.col("last_v"),
    "last_ts": lambda: F.timestamp_micros("last_u"), "first": lambda: F.col("first_v"),
}


def _instant_column(grid: Grid) -> Column:
    return F.timestamp_micros(F.col("_k") * F.lit(grid.step)).alias("t")


def over_time(
    samples: DataFrame, grid: Grid, window, fns: Sequence[str], keys: Sequence[str] = ("series_key",),
    value: str = "value", ts: str = "ts", offset=0,
) -> DataFrame:
    """``<fn>_over_time`` on the grid for any of avg, sum, count, min, max, last, last_ts, first."""
    w, d = micros(window), micros(offset)
    cuts = Cuts(grid.step, w)
    parts = [p for p in _PARTIAL if any(p in _NEEDS[f] for f in fns)]
    base = _in_reach(samples, keys, grid, w, value, ts, d).withColumn("_x", cuts.index(F.col("_u")))
    states = base.groupBy(*keys, "_x").agg(*[_PARTIAL[p][0]().alias(p) for p in parts])
    merged = _slide(states, keys, grid, cuts, lambda df, group: df.groupBy(*group).agg(*[_PARTIAL[p][1]().alias(p) for p in parts]))
    return merged.select(*keys, _instant_column(grid), *[_FINAL[f]().alias(f) for f in fns])


def instant(samples: DataFrame, grid: Grid, lookback="5m", keys: Sequence[str] = ("series_key",), offset=0, **kw) -> DataFrame:
    """Instant vector on the grid: the newest sample of ``(t - lookback, t]``."""
    return over_time(samples, grid, lookback, ["last"], keys, offset=offset, **kw).withColumnRenamed("last", "value")


def instant_at(samples: DataFrame, at, lookback="5m", keys: Sequence[str] = ("series_key",), **kw) -> DataFrame:
    """Instant vector at one instant."""
    t = instant_micros(at)
    return _single(samples, t, lookback, keys, **kw)


def _single(samples: DataFrame, t: int, lookback, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    lo = F.timestamp_micros(F.lit(t - micros(lookback)))
    hi = F.timestamp_micros(F.lit(t))
    return (
        samples.where((F.col(ts) > lo) & (F.col(ts) <= hi)).groupBy(*keys)
        .agg(F.max_by(F.col(value).cast("double"), F.unix_micros(ts)).alias("value")).withColumn("t", hi)
    )


def with_offset(vector: DataFrame, grid: Grid, offset, keys: Sequence[str] = ("series_key",), value: str = "value") -> DataFrame:
    """Pair every element of an instant vector with the element ``offset`` earlier, without a join.

    Each element is emitted for its own instant and for the one ``offset`` later, and the two are
    folded by (series, t); the offset has to be a multiple of the step.
    """
    d = micros(offset)
    if d % grid.step:
        raise ValueError("offset must be a multiple of the step")
    both = F.array(
        F.struct(F.col("t").alias("t"), F.col(value).alias("now"), F.lit(None).cast("double").alias("before")),
        F.struct(
            F.timestamp_micros(F.unix_micros("t") + F.lit(d)).alias("t"),
            F.lit(None).cast("double").alias("now"), F.col(value).alias("before"),
        ),
    )
    return (
        vector.select(*keys, F.inline(both)).groupBy(*keys, "t")
        .agg(F.max("now").alias(value), F.max("before").alias("before"))
        .where(F.col(value).isNotNull() & F.col("before").isNotNull())
    )


# --- ordered states: counters, deltas, changes -------------------------------------------------


def counter_states(samples: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Fold ``(_u, _v)`` samples into ordered states of buckets ``_b``, cut further by ``_x`` if given.

    ``corr`` sums the values lost at counter resets between neighbours inside the bucket, ``chg``
    counts differing neighbours, and ``pen_*`` is the last but one sample.  The sort runs per
    (series, bucket), so a very hot series is still cut into step-sized pieces, and the fold
    reuses the partitioning of the sort.  The bucket number leads the sort: comparing it settles
    most pairs, where series keys share long prefixes.
    """
    at = ["_b", *(["_x"] if "_x" in samples.columns else [])]
    w = Window.partitionBy(*at, *keys).orderBy("_u")
    prev = F.lag("_v").over(w)
    ordered = samples.withColumn("_b", ceil_div(F.col("_u"), bucket)).select(
        *keys, *at, "_u", "_v", prev.alias("_pv"), F.lag("_u").over(w).alias("_pu"),
    )
    return ordered.groupBy(*keys, *at).agg(
        F.count("_v").alias("n"),
        F.min("_u").alias("first_u"), F.min_by("_v", "_u").alias("first_v"),
        F.max("_u").alias("last_u"), F.max_by("_v", "_u").alias("last_v"),
        F.max("_pu").alias("pen_u"), F.max_by("_pv", "_pu").alias("pen_v"),
        F.coalesce(F.sum(F.when(F.col("_v") < F.col("_pv"), F.col("_pv"))), F.lit(0.0)).alias("corr"),
        F.coalesce(F.sum(F.when(F.col("_v") != F.col("_pv"), 1)), F.lit(0)).alias("chg"),
    )


def link_states(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the step from the preceding bucket to each bucket.

    This window sorts buckets, not samples: at most (time span / bucket) rows for each series.
    """
    w = Window.partitionBy(*keys).orderBy("_b", *(["_x"] if "_x" in states.columns else []))
    prev_v, prev_u = F.lag("last_v").over(w), F.lag("last_u").over(w)
    return (
        states.withColumns({"_qv": prev_v, "_qu": prev_u})
        .withColumns(
            {
                "x_corr": F.when(F.col("first_v") < F.col("_qv"), F.col("_qv")).otherwise(F.lit(0.0)),
                "x_chg": F.when(F.col("first_v") != F.col("_qv"), F.lit(1)).otherwise(F.lit(0)),
                "pen_v": F.when(F.col("n") > 1, F.col("pen_v")).otherwise(F.col("_qv")),
                "pen_u": F.when(F.col("n") > 1, F.col("pen_u")).otherwise(F.col("_qu")),
            }
        )
        .withColumns({"corr": F.col("corr") + F.col("x_corr"), "chg": F.col("chg") + F.col("x_chg")})
        .drop("_qv", "_qu")
    )


_FOLDED = ("n", "first_u", "first_v", "last_u", "last_v", "pen_u", "pen_v", "corr", "chg", "x_corr", "x_chg")


def _fold(linked: DataFrame, group: Sequence[str]) -> DataFrame:
    """Merge linked states of neighbouring buckets into one state with the same columns."""
    return linked.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.min("first_u").alias("first_u"), F.min_by("first_v", "first_u").alias("first_v"),
        F.max("last_u").alias("last_u"), F.max_by("last_v", "last_u").alias("last_v"),
        F.max_by("pen_u", "last_u").alias("pen_u"), F.max_by("pen_v", "last_u").alias("pen_v"),
        F.sum("corr").alias("corr"), F.sum("chg").alias("chg"),
        F.min_by("x_corr", "first_u").alias("x_corr"), F.min_by("x_chg", "first_u").alias("x_chg"),
    )


def range_states(
    samples: DataFrame, grid: Grid, window, keys: Sequence[str], value: str = "value", ts: str = "ts", offset=0, chunk="5m",
) -> DataFrame:
    """Ordered state of every (series, grid instant).

    Samples are sorted per (series, chunk, bucket); the states are linked per series, folded to
    buckets and merged to windows, all three on one partitioning by series.
    """
    w = micros(window)
    reach = _in_reach(samples, keys, grid, w, value, ts, micros(offset)).withColumn("_x", Cuts(grid.step, w).index(F.col("_u")))
    return window_states(link_states(counter_states(reach, keys, micros(chunk)), keys), micros(chunk), grid, w, keys)


def window_states(linked: DataFrame, fine: int, grid: Grid, w: int, keys: Sequence[str]) -> DataFrame:
    """Linked states merged to one state for each (series, grid instant).

    States without ``_x`` are of width ``fine``, of which step and window are multiples.
    """
    cuts = Cuts(grid.step, w)
    if "_x" not in linked.columns:
        linked = linked.withColumn("_x", cuts.index(F.col("_b") * F.lit(fine)))
    folded = _fold(linked, [*keys, "_x"])
    state = _slide(folded.select(*keys, "_x", *_FOLDED), keys, grid, cuts, _fold)
    # the step into the first sample of the window starts outside of it
    return state.withColumns({"corr": F.col("corr") - F.col("x_corr"), "chg": F.col("chg") - F.col("x_chg")}).select(
        *keys, _instant_column(grid), (F.col("_k") * F.lit(grid.step)).alias("_t"),
        "n", "first_u", "first_v", "last_u", "last_v", "pen_u", "pen_v", "corr", "chg",
    )


def _increase() -> Column:
    return F.col("last_v") - F.col("first_v") + F.col("corr")


def _extrapolation(w: int) -> Column:
    """Factor that stretches the observed span towards the window edges.

    A gap to an edge counts in full when it is shorter than 1.1 average sample distances, else as
    half a distance; a counter is not stretched back past the point where it would be zero.
    """
    observed = (F.col("last_u") - F.col("first_u")) / F.lit(1e6)
    distance = observed / (F.col("n") - 1)
    head = (F.col("first_u") - (F.col("_t") - F.lit(w))) / F.lit(1e6)
    tail = (F.col("_t") - F.col("last_u")) / F.lit(1e6)
    head = F.when(head >= distance * 1.1, distance / 2).otherwise(head)
    tail = F.when(tail >= distance * 1.1, distance / 2).otherwise(tail)
    inc = _increase()
    to_zero = F.when((inc > 0) & (F.col("first_v") >= 0), observed * (F.col("first_v") / inc))
    head = F.least(head, to_zero)  # least() skips NULL
    return (observed + head + tail) / observed


def increase(samples: DataFrame, grid: Grid, window, keys: Sequence[str] = ("series_key",), extrapolate: bool = True, **kw) -> DataFrame:
    """Reset-aware growth of a counter over the window; needs two samples."""
    return increase_of(range_states(samples, grid, window, keys, **kw), micros(window), keys, extrapolate)


def increase_of(states: DataFrame, w: int, keys: Sequence[str], extrapolate: bool = True) -> DataFrame:
    st = states.where((F.col("n") >= 2) & (F.col("last_u") > F.col("first_u")))
    v = _increase() * _extrapolation(w) if extrapolate else _increase()
    return st.select(*keys, "t", v.alias("value"))


def rate(samples: DataFrame, grid: Grid, window, keys: Sequence[str] = ("series_key",), extrapolate: bool = True, **kw) -> DataFrame:
    """``increase`` per second of the window."""
    return increase(samples, grid, window, keys, extrapolate, **kw).withColumn("value", F.col("value") / F.lit(micros(window) / 1e6))


def _last_two(st: DataFrame) -> DataFrame:
    return st.where((F.col("n") >= 2) & (F.col("last_u") > F.col("pen_u")))


def irate(samples: DataFrame, grid: Grid, window, keys: Sequence[str] = ("series_key",), **kw) -> DataFrame:
    """Per-second growth between the last two samples of the window; after a reset the new value counts."""
    return irate_of(range_states(samples, grid, window, keys, **kw), keys)


def irate_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    step = F.when(F.col("last_v") < F.col("pen_v"), F.col("last_v")).otherwise(F.col("last_v") - F.col("pen_v"))
    v = step / ((F.col("last_u") - F.col("pen_u")) / F.lit(1e6))
    return _last_two(states).select(*keys, "t", v.alias("value"))


def idelta(samples: DataFrame, grid: Grid, window, keys: Sequence[str] = ("series_key",), **kw) -> DataFrame:
    """Difference of the last two samples of the window; may be negative."""
    return idelta_of(range_states(samples, grid, window, keys, **kw), keys)


def idelta_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _last_two(states).select(*keys, "t", (F.col("last_v") - F.col("pen_v")).alias("value"))


def changes(samples: DataFrame, grid: Grid, window, keys: Sequence[str] = ("series_key",), **kw) -> DataFrame:
    """How often the value changed between neighbours inside the window."""
    return range_states(samples, grid, window, keys, **kw).select(*keys, "t", F.col("chg").cast("double").alias("value"))


def predict_linear(samples: DataFrame, grid: Grid, window, ahead, keys: Sequence[str] = ("series_key",), value: str = "value", ts: str = "ts") -> DataFrame:
    """Least-squares line through the window, read ``ahead`` after the evaluation instant.

    Bucket moments are taken relative to the bucket end and moved to the instant when merged, so
    the numbers stay small and the samples are read once, however many windows overlap.
    """
    w, s = micros(window), micros(ahead) / 1e6
    cuts = Cuts(grid.step, w)
    before = (F.col("_u") - cuts.end(F.col("_x"))) / F.lit(1e6)
    base = _in_reach(samples, keys, grid, w, value, ts, 0).withColumn("_x", cuts.index(F.col("_u"))).withColumn("_d", before)
    moments = base.groupBy(*keys, "_x").agg(
        F.count("_v").cast("double").alias("n"), F.sum("_d").alias("sx"), F.sum(F.col("_d") * F.col("_d")).alias("sxx"),
        F.sum("_v").alias("sy"), F.sum(F.col("_d") * F.col("_v")).alias("sxy"),
    )

    def shift(df: DataFrame, seconds: Column) -> DataFrame:
        # all columns are taken from the state before the move
        n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
        moved = {"sx": sx - n * seconds, "sxx": F.col("sxx") - 2 * seconds * sx + n * seconds * seconds, "sxy": F.col("sxy") - seconds * sy}
        return df.withColumns(moved)

    def merge(df: DataFrame, group: Sequence[str]) -> DataFrame:
        return df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sy", "sxy")])

    m = _slide(moments, keys, grid, cuts, merge, shift)
    var = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / var
    intercept = (F.col("sy") - slope * F.col("sx")) / F.col("n")
    return m.where((F.col("n") >= 2) & (var > 0)).select(*keys, _instant_column(grid), (intercept + slope * F.lit(s)).alias("value"))
