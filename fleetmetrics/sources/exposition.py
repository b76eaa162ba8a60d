"""Text exposition lines ``name{label="v",...} value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# format: metric name, optional label block, value, optional millisecond stamp
LINE = r'^\s*([A-Za-z_:][A-Za-z0-9_:]*)\s*(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$'
_SEP = "\u0001"
PAIR = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "raw")


def parse(lines: DataFrame, raw: str = "raw", scraped_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines to samples; comments and malformed lines fall out.

    The line expression runs once per line: it rewrites the line with separators, which is then
    cut into name, label block, value and stamp.
    """
    marked = F.regexp_replace(F.col(raw), LINE, f"$1{_SEP}$3{_SEP}$4{_SEP}$2")
    at = scraped_at if scraped_at is not None else F.lit(None).cast("timestamp")
    cut = lines.select(*keep, at.alias("_at"), F.split(marked, _SEP, 4).alias("_p"))
    part = [F.get("_p", F.lit(i)) for i in range(4)]
    fields = F.struct(part[0].alias("metric"), F.lower(part[1]).alias("_n"), part[2].alias("_t"), part[3].alias("_b"))
    flat = cut.select(*keep, "_at", F.inline_outer(F.array(F.when(F.size("_p") == 4, fields)))).where(F.col("metric").isNotNull())
    n, block = F.col("_n"), F.col("_b")
    value = (
        F.when(n.isin("+inf", "inf"), F.lit(float("inf"))).when(n == "-inf", F.lit(float("-inf")))
        .when(n == "nan", F.lit(float("nan"))).otherwise(n.try_cast("double"))
    )
    names = F.regexp_extract_all(block, F.lit(PAIR), F.lit(1))
    texts = F.regexp_extract_all(block, F.lit(PAIR), F.lit(2))
    # undoing escapes is only paid for where there are any
    texts = F.when(block.contains("\\"), F.transform(texts, _unescape)).otherwise(texts)
    ts = F.coalesce(F.timestamp_millis(F.col("_t").try_cast("bigint")), F.col("_at"))
    # a line that names a label twice is malformed
    labels = F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, texts))
    return flat.select(*keep, "metric", labels.alias("labels"), ts.alias("ts"), value.alias("value")).where(F.col("value").isNotNull() & F.col("labels").isNotNull())


def render(metric: Column, labels: list[tuple[str, Column]], value: Column) -> Column:
    """A sample as an exposition line."""
    pairs = [F.concat(F.lit(f'{n}="'), _escape(v), F.lit('"')) for n, v in labels]
    return F.concat(metric, F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string"))


def _escape(v: Column) -> Column:
    v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(v, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _unescape(v: Column) -> Column:
    # protect escaped backslashes while the other escapes are undone
    v = F.replace(v, F.lit("\\\\"), F.lit("\u0000"))
    v = F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(v, F.lit("\u0000"), F.lit("\\"))
