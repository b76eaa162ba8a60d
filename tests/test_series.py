"""The series dictionary: lookups against a plain test of every series."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import functions as F

from fleetmetrics.operators import series as S

from helpers import labelled

SETS = [{"a": a, "b": b} for a in ("", "x", "xy", "z|") for b in ("", "1", "22")] + [{}, {"c": "x"}, {"a": "x", "b": "1", "c": ""}]
MATCHERS = [("a", op, v) for op in ("=", "!=") for v in ("", "x", "z|")] + [("a", op, v) for op in ("=~", "!~") for v in ("", "x.*", "|x", "[a-z]+", "q")] + [("c", "!=", "x"), ("nowhere", "=~", ".*"), ("nowhere", "=~", ".+")]


def holds(labels, matchers):
    def one(name, op, value):
        text = labels.get(name, "")
        same = text == value if op in ("=", "!=") else re.fullmatch(value, text) is not None
        return same == (op in ("=", "=~"))

    return all(one(*m) for m in matchers)


def text(labels):
    return tuple(sorted((k, v) for k, v in labels.items() if v))


def samples(spark):
    return labelled(spark, [(metric, ls, s, 1.0) for metric in ("m", "n") for s, ls in itertools.chain(enumerate(SETS), enumerate(SETS))])


def test_all_rules_in_one_plan(spark):
    known = S.dictionary(samples(spark))
    rules = [(m,) for m in MATCHERS] + [(x, y) for x, y in zip(MATCHERS, reversed(MATCHERS))] + [(("a", "=", "x"), ("a", "=", "x")), ()]
    uses = S.rules_of(spark, [(i, "instant", "a", "m" if i % 2 else "n", ms, ()) for i, ms in enumerate(rules)])
    got = {(r.rule_id, r.metric, text(r.labels)) for r in S.matching(known, *uses).select("rule_id", "metric", "labels").collect()}
    want = {(i, "m" if i % 2 else "n", text(ls)) for i, ms in enumerate(rules) for ls in SETS if holds(ls, ms)}
    assert got == want


def test_lookup_and_samples(spark):
    x = samples(spark)
    known, flat = S.dictionary(x), S.with_ids(x)
    assert known.count() == 2 * len({text(ls) for ls in SETS}) == known.select(*S.ID).distinct().count()
    for ms in [(m,) for m in MATCHERS[::4]] + [(("a", "!=", "x"), ("b", "=~", ".+")), ()]:
        found = S.lookup(known, "m", ms)
        assert sorted(text(r.labels) for r in found.collect()) == sorted({text(ls) for ls in SETS if holds(ls, ms)}), ms
        assert S.of_series(flat, found).count() == 2 * sum(holds(ls, ms) for ls in SETS)


def test_stored_text_gives_the_same_ids_and_only_new_series_are_written(spark, tmp_path):
    from fleetmetrics.sources.samples import read_samples, write_samples

    x = samples(spark)
    write_samples(x, str(tmp_path / "s"))
    stored = read_samples(spark, str(tmp_path / "s"))
    a, b = (d.select(*S.ID, "metric", F.to_json(F.map_from_entries(S.entries(F.col("labels"))))) for d in (S.dictionary(x), S.dictionary(stored)))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    path = str(tmp_path / "d")
    S.write_series(stored.where("metric = 'm'"), path)
    S.write_series(stored, path, spark.read.parquet(path))
    known = spark.read.parquet(path)
    assert known.count() == known.select(*S.ID).distinct().count() == a.count()


def test_series_of_one_hash_are_told_apart_by_the_check(spark, monkeypatch):
    monkeypatch.setattr(S.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    known = S.dictionary(samples(spark))
    assert known.select("series_id").distinct().count() == 1
    found = S.lookup(known, "m", (("a", "=", "x"), ("b", "=", "1"), ("c", "=", "")))
    assert [text(r.labels) for r in found.collect()] == [text({"a": "x", "b": "1"})]
