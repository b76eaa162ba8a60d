"""Scalar functions (F1-F18) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators.neighbours import with_previous
from ..sources.tables import table
from ..timeutil import seconds_between
from .registry import M, m, query


@query(
    "text_clean",
    r"""select doc_id, trim(replace(left(text, 40), chr(10), ''), ' ') as query, lower(left(trim(replace(left(text, 40), chr(10), ''), ' '), 5)) as head,
    regexp_replace(source, '[0-9]+', '?', 'g') as src, length(text) as chars from documents""",
)
def text_clean(spark, sf):
    q = X.clean_query(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", q.alias("query"), F.lower(F.substring(q, 1, 5)).alias("head"), F.regexp_replace("source", "[0-9]+", "?").alias("src"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query(
    "version_key",
    """with v as (select p_partkey, concat('2.', cast(p_size as varchar), case when p_partkey % 3 = 0 then concat('.', cast(p_partkey % 10 as varchar)) else '' end) as version from part)
    select p_partkey, version, concat(split_part(version, '.', 1), lpad(split_part(version, '.', 2), 2, '0'),
    lpad(coalesce(nullif(split_part(version, '.', 3), ''), '00'), 2, '0')) as key from v""",
)
def version_key(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 10).cast("string"))).otherwise("")
    v = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("2."), F.col("p_size").cast("string"), tail).alias("version"))
    return v.withColumn("key", X.version_key(F.col("version")))


@query(
    "quoted_names",
    """select p_partkey, concat(case when regexp_full_match(p_type, '[a-z_][a-z0-9_$]*') then p_type else concat('"', replace(p_type, '"', '""'), '"') end, '.',
    case when regexp_full_match(p_name, '[a-z_][a-z0-9_$]*') then p_name else concat('"', replace(p_name, '"', '""'), '"') end) as name,
    case when p_size % 2 = 0 then p_name end as seq from part""",
)
def quoted_names(spark, sf):
    expr = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("nextval('"), F.col("p_name"), F.lit("'::regclass)"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.qualified(F.col("p_type"), F.col("p_name")).alias("name"), X.sequence_of_default(expr).alias("seq"))


@query(
    "null_array_join",
    """select p_partkey, case when p_size % 4 = 0 then '<<NULL>>' when p_size % 4 = 1 then p_brand else concat(p_brand, ',', p_type) end as text from part""",
)
def null_array_join(spark, sf):
    two = F.array("p_brand", "p_type")
    one = F.array(F.col("p_brand"), F.lit(None).cast("string"))
    arr = F.when(F.col("p_size") % 4 == 0, F.lit(None).cast("array<string>")).when(F.col("p_size") % 4 == 1, one).otherwise(two)
    return table(spark, sf, "part").select("p_partkey", X.joined_array(arr).alias("text"))


@query(
    "epoch_interval",
    """with d as (select o_custkey, o_orderkey, o_orderdate, epoch(o_orderdate - lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey)) as gap from orders)
    select o_orderkey, cast(gap as double) as gap, coalesce(gap > 5 * 86400.0, false) as late, strftime(o_orderdate + interval 90 minute, '%Y-%m-%d %H:%M:%S') as due from d""",
)
def epoch_interval(spark, sf):
    """Seconds between consecutive orders of a customer; long histories are cut into pieces."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    o = with_previous(o, ["o_custkey"], "o_orderdate", ["o_orderdate"], ["o_orderkey"], chunk="4w")
    gap = seconds_between(F.col("o_orderdate"), F.col("prev_o_orderdate"))
    due = F.timestamp_seconds(F.unix_seconds("o_orderdate")) + F.make_interval(mins=F.lit(90))
    return o.select("o_orderkey", gap.alias("gap"), F.coalesce(gap > 5 * 86400, F.lit(False)).alias("late"), F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(
    "half_even_round",
    """select cast(round_even(100 * o_totalprice / 500000, 0) as bigint) as percent, count(*) as n, max(o_totalprice) as top from orders group by 1""",
)
def half_even_round(spark, sf):
    pct = X.half_even_int(100 * F.col("o_totalprice") / 500000, "bigint")
    return table(spark, sf, "orders").groupBy(pct.alias("percent")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query(
    "lsn_lag",
    """with l as (select o_orderkey, concat(upper(to_hex(o_custkey)), '/', upper(to_hex(o_orderkey * 4096))) as sent, concat(upper(to_hex(o_custkey)), '/', upper(to_hex(o_orderkey * 16))) as replay from orders)
    select o_orderkey, sent, cast(cast(('0x' || split_part(sent, '/', 1)) as ubigint) as bigint) * 4294967296 + cast(cast(('0x' || split_part(sent, '/', 2)) as ubigint) as bigint) as pos,
    cast(cast(('0x' || split_part(sent, '/', 2)) as ubigint) as bigint) - cast(cast(('0x' || split_part(replay, '/', 2)) as ubigint) as bigint) as bytes from l""",
)
def lsn_lag(spark, sf):
    hi = F.hex("o_custkey")
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("/", hi, F.hex(F.col("o_orderkey") * 4096)).alias("sent"), F.concat_ws("/", hi, F.hex(F.col("o_orderkey") * 16)).alias("replay")
    )
    return o.select(
        "o_orderkey", "sent", X.lsn(F.col("sent")).cast("bigint").alias("pos"), X.lsn_diff(F.col("sent"), F.col("replay")).cast("bigint").alias("bytes")
    )


@query(
    "template_text",
    f"""with {M}, d as (select metric, host, strftime(ts, '%Y-%m-%d') as day, max(value) as v from m group by 1, 2, 3)
    select metric, host, day, concat('host ', host, ' of ', metric, ' is at ', cast(v as varchar), ' since ', day, ', pool ') as text from d where v > 90""",
)
def template_text(spark, sf):
    d = m(spark, sf).groupBy("metric", "host", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("v")).where("v > 90")
    labels = F.create_map(*[x for c in ("metric", "host", "day") for x in (F.lit(c), F.col(c))])
    tpl = F.lit("host {{ $labels.host }} of {{ $labels.metric }} is at {{$value}} since {{ $labels.day }}, pool {{ $labels.pool }}")
    return d.select("metric", "host", "day", X.render(tpl, labels, F.col("v")).alias("text"))


@query(
    "bloat_formula",
    """select p_partkey, cast(round_even(p_size * 100 + (p_partkey * 3 - (p_size * 10 - (cast(50 + p_partkey % 51 as double) / 100) * (p_size * 10)) * 8192), 0) as bigint) as wasted from part""",
)
def bloat_formula(spark, sf):
    pages, fill = F.col("p_size") * 10, (50 + F.col("p_partkey") % 51).cast("double")
    return table(spark, sf, "part").select("p_partkey", X.bloat_bytes(F.col("p_size") * 100, F.col("p_partkey") * 3, pages, fill).alias("wasted"))


@query(
    "pct_fallback",
    """select p_partkey, cast(round_even((p_size::double / case when p_size % 5 = 0 then 20 + p_partkey % 7 else p_size % 5 * 40 end::double) * 100, 0) as int) as pct from part""",
)
def pct_fallback(spark, sf):
    limit = (F.col("p_size") % 5) * 40
    return table(spark, sf, "part").select("p_partkey", X.pct_of(F.col("p_size"), limit, 20 + F.col("p_partkey") % 7).alias("pct"))
