"""Series dictionary: selectors and rule matchers by inverted list (SEL1-SEL4, SRC2, AL1-AL7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..session import shared_dir
from ..sources.samples import read_samples, write_samples
from ..sources.tables import table
from .registry import query, r

_LABELLED = """x as (select event_type as metric, concat('h', cast(user_id % 4 as varchar)) as host, concat('u', cast(user_id as varchar)) as usr,
  case when user_id % 3 = 0 then concat('s', cast(user_id % 5 as varchar)) else '' end as shard, value from events)"""


def labelled(spark, sf):
    """Events as samples of one series for each type and user; two users of three have no shard."""
    shard = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string"))).otherwise("")
    host = F.concat(F.lit("h"), F.pmod("user_id", F.lit(4)).cast("string"))
    labels = F.create_map(F.lit("host"), host, F.lit("usr"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("shard"), shard)
    return table(spark, sf, "events").select(F.col("event_type").alias("metric"), labels.alias("labels"), "ts", "value")


# (selector, metric, matchers, the same condition in SQL)
SELECTORS = (
    ("equal", "click", (("host", "=", "h1"),), "metric = 'click' and host = 'h1'"),
    ("unequal", "view", (("shard", "!=", "s0"), ("host", "=~", "h[02]")), "metric = 'view' and shard <> 's0' and regexp_full_match(host, 'h[02]')"),
    ("absent", "error", (("shard", "=", ""),), "metric = 'error' and shard = ''"),
    ("refused", "purchase", (("usr", "!~", "u.*[13579]"), ("shard", "=~", "s.+")), "metric = 'purchase' and not regexp_full_match(usr, 'u.*[13579]') and regexp_full_match(shard, 's.+')"),
    ("maybe", "signup", (("shard", "=~", "|s[0-2]"), ("nowhere", "!=", "x")), "metric = 'signup' and regexp_full_match(shard, '|s[0-2]')"),
    ("everywhere", None, (("usr", "=~", "u1.*"), ("shard", "!~", "s[34]")), "regexp_full_match(usr, 'u1.*') and not regexp_full_match(shard, 's[34]')"),
)


@query(
    "series_lookup",
    "with " + _LABELLED + " " + " union all ".join(f"select '{n}' as selector, metric, count(distinct usr) as series, count(*) as samples, round(sum(value), 4) as total from x where {c} group by metric" for n, _, _, c in SELECTORS),
)
def series_lookup(spark, sf):
    """Samples and their dictionary are stored; selectors find series first, then read those samples only."""
    base = shared_dir(spark, "series")
    samples = labelled(spark, sf)
    write_samples(samples, f"{base}/samples")
    stored = read_samples(spark, f"{base}/samples")
    S.write_series(stored, f"{base}/series")
    known = spark.read.parquet(f"{base}/series")
    flat = S.with_ids(stored)
    out = None
    for name, metric, matchers, _ in SELECTORS:
        found = S.lookup(known, metric, matchers)
        part = S.of_series(flat if metric is None else flat.where(F.col("metric") == metric), found)
        part = part.groupBy("metric").agg(F.count_distinct("series_id", "series_check").alias("series"), F.count("*").alias("samples"), r(F.sum("value"), 4).alias("total")).select(F.lit(name).alias("selector"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "rule_match_ids",
    "with " + _LABELLED + ", d as (select distinct metric, host, usr, shard from x) " + " union all ".join(f"select {i} as rule_id, metric, host, usr, shard from d where {c}" for i, (_, m, _, c) in enumerate(SELECTORS) if m),
)
def rule_match_ids(spark, sf):
    """The series that each rule reads, all rules in one plan; matchers meet distinct label values."""
    known = S.dictionary(labelled(spark, sf))
    uses = S.rules_of(spark, [(i, "instant", "a", m, ms, ()) for i, (_, m, ms, _) in enumerate(SELECTORS) if m])
    names = [F.coalesce(F.col("labels")[n], F.lit("")).alias(n) for n in ("host", "usr", "shard")]
    return S.matching(known, *uses).select("rule_id", "metric", *names)
