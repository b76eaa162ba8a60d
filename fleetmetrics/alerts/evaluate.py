"""Rule evaluation on a grid: one plan for each family of rules, not one for each rule.

Input samples carry ``(metric, labels, ts, value)``.  The result has one row for each instant at
which a rule's condition is true: rule columns, ``labels`` (map), ``series_key``, ``t``, ``value``.
The rule list is a literal relation of at most a few hundred rows, so it is broadcast.

Matchers, grouping keys and label maps are worked out once for each series (``operators.series``):
instant and range vectors carry series ids only, and labels return with the rows that hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import label_key, series_key
from ..operators import series as S
from ..operators import windows as W
from ..operators.selectors import compare, divide, largest
from ..timeutil import micros
from .rules import Rule, rule_frame

_GROUPED = ("instant", "age", "ratio_pct", "free_pct", "max_by", "count_by", "odd_count", "and_min", "max_both")


def as_series(samples: DataFrame) -> DataFrame:
    """Replace the label map by its text identity; ``labels_of`` turns it back."""
    return samples.select("metric", label_key(samples).alias("series_key"), "ts", "value")


def labels_of(key: Column) -> Column:
    return F.from_json(key, "map<string,string>")


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a literal relation of known length; leave a long one to the optimizer."""
    return F.broadcast(df) if n <= S.SMALL else df


def _uses(spark: SparkSession, rules: Sequence[tuple[int, Rule]]) -> tuple[DataFrame, bool]:
    """One row for each metric a rule reads, with its matchers and matching labels."""
    return S.rules_of(spark, [(i, r.kind, role, metric, r.matchers, r.by) for i, r in rules for role, metric in (("a", r.metric), ("b", r.metric2)) if metric])


_BY_GROUP = ("max_by", "count_by", "odd_count", "max_both", "and_min", "sum_free_pct", "role_change")


def _sides(series: DataFrame, uses: tuple[DataFrame, bool]) -> DataFrame:
    """Uses with the series they select and ``key``, the labels that tell the rule's alerts apart: sorted
    (name, value) pairs, for rules that group only those named, for ``load`` all but those."""
    x = S.matching(series, *uses)
    pairs, by = S.entries(F.col("labels")), F.col("by")
    named, others = (F.filter(pairs, lambda p: F.array_contains(by, p["key"]) == inside) for inside in (True, False))
    key = F.when(F.col("kind").isin(*_BY_GROUP), named).when(F.col("kind") == "load", others).otherwise(pairs)
    core = F.when((F.col("kind") == "load") & (F.col("role") == "b"), F.col("labels")[F.get(by, 0)])
    return x.select("rule_id", "kind", "role", *S.ID, "label_key", key.alias("key"), core.alias("core"))


def _side(role: str) -> Column:
    return F.when(F.col("role") == role, F.col("value"))


def _grouped(vector: DataFrame, sides: DataFrame) -> DataFrame:
    """All kinds that need at most one grouping of instant values, in a single aggregation."""
    x = vector.join(sides.drop("label_key", "core"), S.ID)
    a = _side("a")
    g = x.groupBy("rule_id", "kind", "key", "t").agg(largest(a).alias("a"), largest(_side("b")).alias("b"), F.count(a).alias("n"))
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    now = F.unix_micros("t") / 1e6
    test = (
        F.when(kind.isin("instant", "max_by"), a).when(kind == "age", now - a)
        .when(kind == "ratio_pct", 100 * divide(a, b)).when(kind == "free_pct", 100 - 100 * divide(a, b))
        .when(kind == "count_by", F.col("n").cast("double")).when(kind == "odd_count", (F.col("n") % 2).cast("double"))
        # matching by group keeps the larger of several right-hand elements
        .when(kind == "and_min", b).when(kind == "max_both", F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))
    )
    return g.select("rule_id", "key", "t", test.alias("test"), test.alias("value"), F.col("a"))


def _sum_free(vector: DataFrame, sides: DataFrame) -> DataFrame:
    pair = vector.join(sides, S.ID).groupBy("rule_id", "key", "label_key", "t").agg(F.max(_side("a")).alias("a"), F.max(_side("b")).alias("b")).where("a is not null and b is not null")
    g = pair.groupBy("rule_id", "key", "t").agg((100 - 100 * F.sum(divide(F.col("a"), F.col("b")))).alias("test"))
    return g.select("rule_id", "key", "t", "test", F.col("test").alias("value"))


def _load(vector: DataFrame, sides: DataFrame) -> DataFrame:
    """Value per distinct inner label: first one row for each core, then a count of them."""
    cores = vector.join(sides, S.ID).groupBy("rule_id", "key", "t", "role", "core").agg(F.max("value").alias("value"))
    g = cores.groupBy("rule_id", "key", "t").agg(F.count_if(F.col("role") == "b").alias("n"), F.max(_side("a")).alias("load"))
    return g.where("n > 0 and load is not null").select("rule_id", "key", "t", (F.col("load") / F.col("n")).alias("test"), F.col("load").alias("value"))


def _pairs(vector: DataFrame, grid: W.Grid, offset: str) -> DataFrame:
    hi = F.timestamp_micros(F.lit(grid.last * grid.step))
    return W.with_offset(vector, grid, offset, S.ID).where(F.col("t") <= hi)


def _changed(vector: DataFrame, sides: DataFrame, grid: W.Grid, offset: str) -> DataFrame:
    x = _pairs(vector, grid, offset).join(sides, S.ID)
    diff = F.col("value") - F.col("before")
    test = F.when(F.col("kind") == "delta", diff).when(diff != 0, F.lit(1.0))
    value = F.when(F.col("kind") == "delta", diff).otherwise(F.col("value"))
    return x.select("rule_id", "key", "t", test.alias("test"), value.alias("value"))


def _role_change(vector: DataFrame, series: DataFrame, uses: tuple[DataFrame, bool], grid: W.Grid, offset: str, ignoring: Sequence[str]) -> DataFrame:
    """Elements that differ from the earlier element with the same remaining labels, counted per group.

    Without the ignored labels an element has to be unique, so the vector is folded to that key first.
    """
    kept = series.withColumn("labels", F.map_filter("labels", lambda k, v: ~k.isin(*ignoring)) if ignoring else F.col("labels")).withColumn("label_key", series_key(F.col("labels")))
    ids = [F.xxhash64("metric", "label_key").alias("series_id"), F.hash("label_key", "metric").alias("series_check")]
    folded = kept.groupBy("metric", "label_key").agg(F.any_value("labels").alias("labels")).select(*ids, "metric", "label_key", "labels")
    move = kept.select(*S.ID, *[c.alias(f"to_{n}") for c, n in zip(ids, S.ID)])
    v = vector.join(move, S.ID).groupBy(*[F.col(f"to_{n}").alias(n) for n in S.ID], "t").agg(F.max("value").alias("value"))
    x = _pairs(v, grid, offset).where(F.col("value") != F.col("before")).join(_sides(folded, uses), S.ID)
    g = x.groupBy("rule_id", "key", "t").agg(F.count("*").cast("double").alias("test"))
    return g.select("rule_id", "key", "t", "test", F.col("test").alias("value"))


def _forecast(samples: DataFrame, vector: DataFrame, sides: DataFrame, spec: DataFrame, grid: W.Grid, window: str, ahead: str) -> DataFrame:
    line = W.predict_linear(samples, grid, window, ahead, S.ID).join(sides.where("role = 'a'"), S.ID).select("rule_id", "key", "t", F.col("value").alias("p"))
    used = vector.join(sides, S.ID).groupBy("rule_id", "key", "t").agg(F.max(_side("a")).alias("a"), F.max(_side("b")).alias("b"))
    used = used.select("rule_id", "key", "t", F.when(F.col("b") != 0, 100 * ((F.col("b") - F.col("a")) / F.col("b"))).alias("used"))
    both = line.join(used, ["rule_id", "key", "t"], "left").join(spec.select("rule_id", "minimum"), "rule_id")
    ok = F.col("minimum").isNull() | (F.col("used") > F.col("minimum"))
    return both.where(ok).select("rule_id", "key", "t", F.col("p").alias("test"), F.col("p").alias("value"))


def _absent(vector: DataFrame, sides: DataFrame, uses: DataFrame, grid: W.Grid) -> DataFrame:
    """Rule and instant pairs without any matching element; equality matchers become labels."""
    seen = vector.join(sides, S.ID).select("rule_id", "t").distinct()
    ticks = F.explode(F.sequence(F.lit(grid.first).cast("bigint"), F.lit(grid.last).cast("bigint")))
    equal = F.map_from_entries(F.transform(F.filter(F.arrays_zip("m_name", "m_value", "m_op"), lambda m: m["m_op"] == "="), lambda m: F.struct(m["m_name"], m["m_value"])))
    expected = uses.select("rule_id", S.entries(equal).alias("key"), ticks.alias("k"))
    expected = expected.withColumn("t", F.timestamp_micros(F.col("k") * F.lit(grid.step))).drop("k")
    return expected.join(seen, ["rule_id", "t"], "left_anti").select("rule_id", "key", "t", F.lit(1.0).alias("test"), F.lit(1.0).alias("value"))


def _holds() -> Column:
    t, x = F.col("threshold"), F.col("test")
    out = F.when(F.lit(False), F.lit(False))
    for op in (">", ">=", "<", "<=", "==", "!="):
        out = out.when(F.col("op") == op, compare(x, op, t))
    return out.otherwise(x.isNotNull())


def evaluate(samples: DataFrame, rules: Iterable[Rule], grid: W.Grid, lookback="5m", series: DataFrame | None = None) -> DataFrame:
    """All rules over all series on the grid; rows are the instants at which a condition holds.

    ``series`` is the stored dictionary of the samples; without it, it is taken from the samples, which
    costs a second look at them.
    """
    spark = samples.sparkSession
    numbered = list(enumerate(rules))
    spec = rule_frame(spark, numbered)
    known = S.dictionary(samples) if series is None else series
    flat = S.with_ids(samples)

    def of(*kinds: str, window: str | None = None):
        return [(i, r) for i, r in numbered if r.kind in kinds and (window is None or r.window == window)]

    def read(some):
        names = sorted({m for _, r in some for m in (r.metric, r.metric2) if m})
        return flat.where(F.col("metric").isin(names))

    def sides(some):
        return _sides(known, _uses(spark, some))

    # One instant vector for all families that read newest values, from one scan: it begins as much
    # earlier as the longest look at the past needs, and is not filtered by family, which would make
    # a plan of its own for each; a family takes its series when its rules are attached.
    back = max([0, *(micros(r.window) for _, r in of("changed", "delta", "role_change"))])
    latest = of(*_GROUPED, "sum_free_pct", "load", "changed", "delta", "role_change", "forecast", "absent")
    vector = W.instant(read(latest), W.Grid(grid.step, grid.start - back, grid.end), lookback, S.ID) if latest else None

    frames: list[DataFrame] = []
    if some := of(*_GROUPED):
        frame = _grouped(vector, sides(some))
        floor = _small(spec.select("rule_id", F.col("minimum").alias("least")), len(numbered))
        frames.append(frame.join(floor, "rule_id").where(F.col("least").isNull() | (F.col("a") >= F.col("least"))).drop("a", "least"))
    if some := of("sum_free_pct"):
        frames.append(_sum_free(vector, sides(some)))
    if some := of("load"):
        frames.append(_load(vector, sides(some)))
    for window in sorted({r.window for _, r in of("changed", "delta")}):
        frames.append(_changed(vector, sides(of("changed", "delta", window=window)), grid, window))
    for i, r in of("role_change"):
        frames.append(_role_change(vector, known, _uses(spark, [(i, r)]), grid, r.window, r.extra.get("ignoring", ())))
    for window in sorted({r.window for _, r in of("avg_over_time")}):
        some = of("avg_over_time", window=window)
        v = W.over_time(read(some), grid, window, ["avg"], S.ID).withColumnRenamed("avg", "value")
        frames.append(v.join(sides(some), S.ID).select("rule_id", "key", "t", F.col("value").alias("test"), "value"))
    for window in sorted({r.window for _, r in of("changes")}):
        some = of("changes", window=window)
        v = W.changes(read(some), grid, window, S.ID)
        frames.append(v.join(sides(some), S.ID).select("rule_id", "key", "t", F.col("value").alias("test"), "value"))
    for window, ahead in sorted({(r.window, r.ahead) for _, r in of("forecast")}):
        some = [(i, r) for i, r in of("forecast") if (r.window, r.ahead) == (window, ahead)]
        frames.append(_forecast(read(some), vector, sides(some), spec, grid, window, ahead))
    if some := of("absent"):
        frames.append(_absent(vector, sides(some), _uses(spark, some)[0], grid))

    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    first = F.timestamp_micros(F.lit(grid.first * grid.step))
    hits = out.where((F.col("t") >= first) & F.col("test").isNotNull()).join(_small(spec, len(numbered)), "rule_id").where(_holds())
    labels = F.map_from_entries("key")
    return hits.select(
        "rule_id", "alertname", "severity", "severity_num", "service", "hold", "summary", F.to_json(labels).alias("series_key"), labels.alias("labels"), "t", "value"
    )
