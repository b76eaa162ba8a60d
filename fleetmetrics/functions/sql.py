"""The scalar helpers as SQL functions, for users who write their jobs in SQL.

They are SQL functions, which the optimizer expands in place; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "lsn(text string) returns decimal(20,0)":
        "cast(conv(split_part(text, '/', 1), 16, 10) as decimal(20,0)) * 4294967296 + cast(conv(split_part(text, '/', 2), 16, 10) as decimal(20,0))",
    "lsn_diff(a string, b string) returns decimal(20,0)": "lsn(a) - lsn(b)",
    "version_key(version string) returns string":
        "concat(split_part(version, '.', 1), lpad(split_part(version, '.', 2), 2, '0'), lpad(coalesce(nullif(split_part(version, '.', 3), ''), '00'), 2, '0'))",
    "clean_query(text string) returns string": "trim(replace(left(text, 40), '\\n', ''))",
    "half_even(v double) returns double": "rint(v)",
    "counter_step(now double, before double) returns double": "case when now < before then now else now - before end",
    "label(labels map<string,string>, name string) returns string": "coalesce(try_element_at(labels, name), '')",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the helpers as temporary functions of the session; returns their names."""
    for signature, body in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    return [s.split("(")[0] for s in _FUNCTIONS]
