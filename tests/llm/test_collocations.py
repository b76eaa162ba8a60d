"""Phrase collocations against a plain count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from fleetmetrics.llm import collocations
from fleetmetrics.llm.common import ship

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, inside=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= inside * a for q, b in c.items()):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, le, r, n[lang], s) for i, (s, a, p, le, r) in enumerate(found[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    ship(spark)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"n": F.lit(1), "W1": F.lit("x"), "bucket": F.lit(2)}).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, **kw).collect())


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "é", "ç", "new", "York", "City", "x-y", "中文", "\xa0"]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", "]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "en", "und", None, ""]), text))
    return rows


def test_equals_a_plain_count(spark):
    rows = [*corpus(1), (None, None), ("en", ""), ("en", " .,\n "), ("fr", "one two " * 30), ("de", "same same same " * 5000), *[("en", "new york city is new york city")] * 12]
    want = plain(rows)
    assert run(spark, rows) == want and {x[0] for x in want} >= {"en", "und", "fr", "de"}
    assert run(spark, rows, least=25, inside=90, top=3) == plain(rows, 25, 90, 3)


def test_frequent_pairs_change_nothing(spark, monkeypatch):
    rows = corpus(2, 300)
    for name, value in (("SAMPLED", 1.0), ("PARTS", 3)):
        monkeypatch.setattr(collocations, name, value)
    texts = spark.createDataFrame(rows, "lang string, text string").selectExpr("coalesce(lang, 'und') as lang", "cast(text as binary) as t")
    assert collocations.frequent_pairs(texts)
    assert run(spark, rows) == plain(rows)


def test_a_task_that_empties_its_counts_often_sends_the_same_sums(monkeypatch):
    rows = [(lang or "und", text.encode()) for lang, text in corpus(4, 200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.binary())], ["lang", "t"]) for part in (rows[:90], rows[90:120], rows[120:])]

    def sums(frequent):
        seen, out, packed = collocations.WindowCounts(), Counter(), 0
        for last in (*collocations._counted(iter(batches), seen), True):
            for batch in seen.packed(7, frequent):
                for r in batch.to_pylist():
                    packed += 1
                    for w in zip(*(r[c].split(" ") for c in ("w1", "w2", "w3")), r["n"], strict=True):
                        out[(r["lang"], *w[:3])] += w[3]
                        assert (r["bucket"] >= 7) == ((r["lang"], *w[:2]) in frequent)
        return out, packed

    whole, few = sums(set())
    for name, value in (("HELD", 20), ("PACKED", 3)):
        monkeypatch.setattr(collocations, name, value)
    small, many = sums({("en", "a", "b"), ("und", "new", "york")})
    assert small == whole and many > few
    assert sum(whole.values()) == sum(len(collocations.words_and_breaks(t)) - collocations.words_and_breaks(t).count(b".") for _, t in rows)


def test_very_long_text_and_no_rows(spark):
    rows = [("en", " ".join(f"w{i % 997} v" for i in range(300_000)))]
    got = run(spark, rows)
    assert got == plain(rows) and got
    assert run(spark, []) == [] and run(spark, [("en", None), (None, "")]) == []


def test_sums_of_buckets_are_those_of_all_windows_however_little_a_task_holds(monkeypatch):
    least, rows = 3, [(lang or "und", text.encode()) for lang, text in corpus(6, 200)]
    frequent = {("en", "a", "b"), ("und", "new", "york")}
    batches = []
    for part in (rows[:90], rows[90:]):
        counts = collocations.WindowCounts()
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.binary())], ["lang", "t"])
        for _ in collocations._counted(iter([batch]), counts):
            raise AssertionError
        batches += counts.packed(5, frequent)
    dealt = pa.Table.from_batches(batches).sort_by([("bucket", "ascending")])
    windows = Counter()
    for r in dealt.to_pylist():
        for *w, n in zip(*(r[c].split(" ") for c in ("w1", "w2", "w3")), r["n"], strict=True):
            windows[(r["lang"], *(x or None for x in w))] += n

    def phrases(sums):
        out = Counter()
        for (lang, *w), n in sums.items():
            for size in range(1, 4):
                if w[size - 1]:
                    out[(lang, *w[:size])] += n
        return {p: n for p, n in out.items() if len(p) == 2 or n >= least}

    def sums(most):
        out, rows_out = Counter(), 0
        for batch in collocations.summed(iter(dealt.to_batches(max_chunksize=most)), least, 5):
            for r in batch.to_pylist():
                out[tuple(r[c] for c in ("lang", "w1", "w2", "w3"))] += r["n"]
                rows_out += 1
        return out, rows_out

    whole, few = sums(1000)
    assert phrases(whole) == phrases(windows) and few < len(windows)
    assert all(n >= least for (_, _, _, w3), n in whole.items() if w3)
    for name, value in (("HELD", 40), ("UNPACKED", 1)):
        monkeypatch.setattr(collocations, name, value)
    parts, many = sums(2)
    assert phrases(parts) == phrases(windows) and many > few


def test_windows_are_summed_without_a_row_for_each(spark, monkeypatch):
    plans, real = {}, collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, purpose: plans.setdefault(purpose, df._jdf.queryExecution().toString()) and real(df, purpose))
    rows = corpus(7)
    assert run(spark, rows) == plain(rows)
    assert "MapInArrow" in plans["longest-windows"] and not any(x in plans["longest-windows"] for x in ("Generate", "Aggregate", "Window ["))
