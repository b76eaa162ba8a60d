"""Scalar functions as column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TEXT = "<<NULL>>"


def clean_query(text: Column, width: int = 40) -> Column:
    """Statement label: cut first, then drop line breaks, then trim blanks."""
    return F.trim(F.replace(F.substring(text, 1, width), F.lit("\n"), F.lit("")))


def version_key(version: Column) -> Column:
    """``2.41`` -> ``24100``: sortable text from major, minor and an optional third part."""
    part = [F.split_part(version, F.lit("."), F.lit(i)) for i in (1, 2, 3)]
    return F.concat(part[0], _lpad2(part[1]), _lpad2(F.coalesce(F.nullif(part[2], F.lit("")), F.lit("00"))))


def _lpad2(text: Column) -> Column:
    return F.lpad(text, 2, "0")


def quote_ident(name: Column) -> Column:
    """Quoted unless a plain lower-case identifier."""
    plain = name.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def qualified(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", quote_ident(schema), quote_ident(name))


def sequence_of_default(default_expr: Column) -> Column:
    """The sequence named in a ``nextval('...'::regclass)`` default, else NULL."""
    name = F.regexp_replace(default_expr, r"^nextval\('(.+?)'::regclass\)$", "$1")
    return F.when(default_expr.rlike(r"^nextval\('"), name)


def joined_array(values: Column, sep: str = ",") -> Column:
    """Array as text; a NULL array reads as the NULL marker, NULL elements are left out."""
    return F.array_join(F.coalesce(values, F.array(F.lit(NULL_TEXT))), sep)


def or_null_text(v: Column) -> Column:
    return F.coalesce(v, F.lit(NULL_TEXT))


def half_even(v: Column) -> Column:
    """Float to whole number, ties to even."""
    return F.rint(v.cast("double"))


def half_even_int(v: Column, kind: str = "int") -> Column:
    return half_even(v).cast(kind)


def lsn(text: Column) -> Column:
    """Write-ahead-log position ``16/B374D848`` as bytes."""
    hi = F.conv(F.split_part(text, F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.split_part(text, F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return (hi * F.lit(4294967296).cast("decimal(20,0)") + lo).cast("decimal(20,0)")


def lsn_diff(a: Column, b: Column) -> Column:
    return (lsn(a) - lsn(b)).cast("decimal(20,0)")


def bloat_bytes(dead: Column, free: Column, relpages: Column, fillfactor: Column, block: int = 8192) -> Column:
    """Dead bytes plus the free space beyond what the fill factor reserves."""
    reserved = (relpages - (fillfactor / 100.0) * relpages) * F.lit(block)
    return half_even_int(dead + (free - reserved), "bigint")


def pct_of(used: Column, limit: Column, fallback: Column) -> Column:
    """Percent used, of the limit or (when that is 0) of the fallback; rounded half-even."""
    base = F.when(limit != 0, limit).otherwise(fallback).cast("double")
    return half_even_int(F.when(base != 0, used.cast("double") / base * 100))


def numeric(v: Column) -> Column:
    """Whole number of any size."""
    return v.cast("decimal(20,0)")


def sequence_slots(min_value: Column, max_value: Column, increment: Column) -> Column:
    """ceil((max - min + 1) / increment) in exact arithmetic."""
    return _ceil_ratio(numeric(max_value) - numeric(min_value) + F.lit(1), increment)


def sequence_used(min_value: Column, last_value: Column, increment: Column) -> Column:
    last = F.coalesce(numeric(last_value), numeric(min_value))
    return _ceil_ratio(last - numeric(min_value) + F.lit(1), increment)


def _ceil_ratio(total: Column, increment: Column) -> Column:
    total, inc = total.cast("decimal(22,0)"), numeric(increment)
    rest = F.pmod(total, F.abs(inc))
    whole = ((total - rest) / F.abs(inc)).cast("decimal(22,0)")
    up = F.when(rest > 0, F.lit(1)).otherwise(F.lit(0))
    # a falling sequence (negative step) yields a negative ratio, whose ceiling drops the rest
    return F.when(inc > 0, whole + up).otherwise(-whole).cast("decimal(22,0)")


def percent_used(used: Column, slots: Column) -> Column:
    """round(used / slots * 100), ties away from zero, in decimals."""
    return F.round((used.cast("decimal(22,0)") / slots.cast("decimal(22,0)")).cast("decimal(38,16)") * F.lit(100), 0).cast("int")


def render(template: Column, labels: Column, value: Column) -> Column:
    """Fill ``{{ $labels.x }}`` and ``{{ $value }}``; labels that do not exist become ''."""
    spaced = F.regexp_replace(template, r"\{\{\s*(\$[A-Za-z_.0-9]+)\s*\}\}", "{{$1}}")
    filled = F.aggregate(
        F.map_entries(labels), F.replace(spaced, F.lit("{{$value}}"), value.cast("string")),
        lambda acc, e: F.replace(acc, F.concat(F.lit("{{$labels."), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))),
    )
    return F.regexp_replace(filled, r"\{\{\$labels\.[A-Za-z_0-9]+\}\}", "")


def legend(fmt: str, **parts: Column) -> Column:
    """Legend text such as ``db: {{dbname}}, user: {{role}}`` with constant layout."""
    out = F.lit(fmt)
    for name, col in parts.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(col.cast("string"), F.lit("")))
    return out
