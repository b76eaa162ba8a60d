"""Small constant relations that stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def values(spark: SparkSession, rows: Sequence[Sequence[object]], schema: str) -> DataFrame:
    """A VALUES relation; ``schema`` is a DDL string such as ``"name string, n double"``.

    The rows become one local relation in the plan: no Python workers, no job, size known to the
    optimizer.
    """
    fields = [f.strip().split(None, 1) for f in _split(schema)]
    if not rows:
        empty = ", ".join(f"cast(null as {kind}) as {name}" for name, kind in fields)
        return spark.sql(f"select {empty} where false")
    body = ",\n".join("(" + ", ".join(f"cast({_sql(v)} as {kind})" for v, (_, kind) in zip(row, fields)) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"select * from values {body} as t({names})")


def _sql(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
        return f"double('{v}')"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(_sql(x) for x in v)})"
    if isinstance(v, dict):
        return f"map({', '.join(f'{_sql(k)}, {_sql(x)}' for k, x in v.items())})"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{text}'"


def _split(schema: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
