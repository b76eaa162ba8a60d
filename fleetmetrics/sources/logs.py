"""Server logs: parsing by prefix, selection, per-database reports and their archive."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# fixed value: the line prefix that servers are set up with
DEFAULT_PREFIX = "%t [%r] [%p]: [%l-1] user=%u,db=%d,e=%e "
# prefix escapes: column name and pattern
ESCAPES = {
    "t": ("log_time", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} \w+"),
    "m": ("log_time", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+ \w+"),
    "r": ("remote", r"\S*"), "h": ("remote_host", r"\S*"), "p": ("pid", r"\d+"), "l": ("line_no", r"\d+"),
    "u": ("user_name", r"[^,\s]*"), "d": ("db", r"[^,\s]*"), "e": ("sqlstate", r"\w{5}"), "a": ("application", r".*?"),
}
_SEP = "\u0001"
SYSTEM_DATABASES = ("postgres", "template0", "template1")


def read_day(spark: SparkSession, folder: str, day: str, stem: str = "postgresql-", pattern: str | None = None) -> DataFrame:
    """All records of the log files of one day, picked by file name; other days are not listed.

    A record begins with a line that starts with the day; lines that do not belong to the record
    before them. The reader splits at such beginnings, so large files are still read in parallel.
    """
    reader = spark.read.option("pathGlobFilter", pattern or f"{stem}{day}*").option("lineSep", f"\n{day}")
    text = F.col("value")
    whole = F.when(text.startswith(day), text).otherwise(F.concat(F.lit(day), text))  # the separator took the day
    return reader.text(folder).select(F.regexp_replace(whole, r"\n+\z", "").alias("raw")).where("raw <> ''")


def prefix_regex(prefix: str = DEFAULT_PREFIX) -> tuple[str, list[str]]:
    """One regular expression for prefix, level and message, and the names of its groups."""
    names, out, i = [], "^", 0
    while i < len(prefix):
        if prefix[i] == "%" and i + 1 < len(prefix) and prefix[i + 1] in ESCAPES:
            name, pattern = ESCAPES[prefix[i + 1]]
            names.append(name)
            out += f"({pattern})"
            i += 2
        elif prefix.startswith("%%", i):
            out, i = out + "%", i + 2
        else:
            out, i = out + re.escape(prefix[i]), i + 1
    # (?s): the message may contain line breaks
    return "(?s)" + out.removesuffix("\\ ") + r"\s*([A-Z0-9]+):\s+(.*)$", [*names, "level", "message"]


def parse(lines: DataFrame, prefix: str = DEFAULT_PREFIX, raw: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    """Log lines to columns; lines without the prefix fall out.

    All groups come from one run of the expression over the line: it rewrites the line with
    separators, which is then cut.  The outer generator keeps the optimizer from inferring a
    filter that would run the expression a second time.
    """
    pattern, names = prefix_regex(prefix)
    marked = F.regexp_replace(F.col(raw), pattern, _SEP.join(f"${i + 1}" for i in range(len(names))))
    parts = lines.select(*keep, F.split(marked, _SEP, len(names)).alias("_p"))
    fields = F.struct(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    out = parts.select(*keep, F.inline_outer(F.array(F.when(F.size("_p") == len(names), fields)))).where(F.col("level").isNotNull())
    if "log_time" in names:
        # the zone abbreviation at the end is not part of the stamp
        out = out.withColumn("log_time", F.try_to_timestamp(F.substring_index("log_time", " ", 2)))
    return out


def select(log: DataFrame, day: str | None = None, db: str | None = None, exclude_db: Sequence[str] = (), exclude_query: str | None = None) -> DataFrame:
    """One day, one or all databases, minus excluded databases and statements.

    Every excluded name counts, system databases included.
    """
    if day is not None:
        start = F.lit(day).cast("timestamp")
        log = log.where((F.col("log_time") >= start) & (F.col("log_time") < start + F.make_interval(days=F.lit(1))))
    if db is not None:
        log = log.where(F.col("db") == db)
    log = log.where(~F.col("db").isin([*SYSTEM_DATABASES, *exclude_db]))
    if exclude_query is not None:
        log = log.where(~statement(F.col("message")).rlike(exclude_query))
    return log


def statement(message: Column) -> Column:
    """The SQL text of a logged statement, else ''."""
    return F.regexp_extract(message, r"(?s)(?:statement|execute [^:]*|parse [^:]*|bind [^:]*): (.*)$", 1)


def duration_ms(message: Column) -> Column:
    return F.regexp_extract(message, r"duration: ([0-9.]+) ms", 1).try_cast("double")


def normalize(sql: Column) -> Column:
    """Statement shape: literals and numbers become ?, white space is folded, lower case."""
    x = F.regexp_replace(sql, r"'(?:[^']|'')*'", "?")
    x = F.regexp_replace(x, r"\b\d+(?:\.\d+)?\b", "?")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def report(log: DataFrame) -> DataFrame:
    """Counts per (database, day, user, sqlstate, statement shape); combined on the map side."""
    ms = duration_ms(F.col("message"))
    return (
        log.select(
            "db", F.to_date("log_time").alias("report_date"), "user_name", "sqlstate", "level",
            normalize(statement(F.col("message"))).alias("statement"), ms.alias("ms"),
        )
        .groupBy("db", "report_date", "user_name", "sqlstate", "level", "statement")
        .agg(F.count("*").alias("lines"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    )


def write_report(rep: DataFrame, path: str) -> None:
    """One folder for each (database, day); rerunning a day replaces only that day."""
    (
        rep.hint("rebalance", "db", "report_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("db", "report_date").parquet(path)
    )


def split_by_age(df: DataFrame, when: str, as_of: Column, days: int = 30) -> DataFrame:
    """Mark rows strictly older than ``days`` and name their archive year and month."""
    old = F.col(when) < as_of - F.make_interval(days=F.lit(days))
    return df.withColumns({"archived": old, "year": F.date_format(when, "yyyy"), "month": F.date_format(when, "MM")})


def archive(df: DataFrame, when: str, as_of: Column, out: str, db: str = "db", days: int = 30, folder: str = "archive") -> DataFrame:
    """Move old rows to ``<out>/<folder>`` by (run, db, year, month); return the rows that stay.

    The run is named by its cut-off, and a run replaces only what a run with the same cut-off wrote:
    a repeated job changes nothing, and a later one adds to a month that has rows already.
    """
    marked = split_by_age(df, when, as_of, days)
    run = F.date_format(as_of - F.make_interval(days=F.lit(days)), "yyyyMMdd'T'HHmmss")
    old = marked.where("archived").drop("archived").withColumn("run", run)
    (
        old.hint("rebalance", db, "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", db, "year", "month").parquet(f"{out}/{folder}")
    )
    return marked.where("not archived").drop("archived", "year", "month")


def read_archive(spark: SparkSession, out: str, folder: str = "archive") -> DataFrame:
    """The archived rows of all runs, with the text columns run, db, year and month."""
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{out}/{folder}")


