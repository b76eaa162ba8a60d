"""Quality rules and classifier, the pipeline, and the registered queries against their SQL."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from fleetmetrics.llm import quality_model, quality_rules
from fleetmetrics.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    state, _, _, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert state == "ok", f"{state}: {note}"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeats = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeats) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeats), failed


def test_base_figures_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a", "a a a", "a a a a a", "a b c a b c", "x#y <b> 100%\n\nx\nx \nx", "é\xa0ñ  🙂 | &", "a\x0bb\x0cc\rd", "long word " * 30_000]
    texts += [" ".join(rng.choice("abcde") for _ in range(n)) + "\n" + " ".join(rng.choice("pqrstuvwxyz") * 3 for _ in range(n)) for n in range(2, 60, 3)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b c", 1), (3, "a", 1)], "doc_id long, text string, n_words int")
    rows = quality_rules.judge(df).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (i, t and t[:40])
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_rules_use_no_python(spark):
    plan = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_label_model_against_a_plain_one():
    """The patterns' model equals expectation maximisation over single documents."""
    rng = random.Random(8)
    docs = []
    for _ in range(600):
        kind = rng.choice([0] * 8 + [1, 2, 3])
        docs.append(tuple(0 if rng.random() < 0.1 else (-1 if rng.random() < (0.9 if kind == j + 1 else 0.01) else 1) for j in range(3)))
    counted = quality_rules.fit(list(Counter(docs).items()), 3)
    single = quality_rules.fit([(d, 1) for d in docs], 3)
    assert np.allclose(counted.prior, single.prior) and np.allclose(counted.logs, single.logs)

    def good(d):
        at = counted.likelihoods(list(d))
        return 1 / sum(math.exp(x - at[0]) for x in at)

    assert good((1, 1, 1)) > 0.95 and all(good(d) < 0.5 for d in [(-1, 1, 1), (1, -1, 1), (1, 1, -1), (-1, -1, 1)]) and good((0, 0, 0)) > 0.5


def test_the_posterior_decides(spark):
    """On the given table the verdict is not that of all rules passing, and overrules single votes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [f"vote_{i}" for i in range(len(quality_rules.rules()))]
    got = quality_rules.judge(docs, votes_too=True).where("not base_failed").select("doc_id", "kept", *names)
    rows = [(sum(r[n] in (quality_rules.BAD, quality_rules.SUSPECT) for n in names), r.kept) for r in got.collect()]
    overruled = sum(n == 1 and kept for n, kept in rows)
    assert overruled > 0.05 * len(rows) and all(kept for n, kept in rows if n == 0)
    assert sum(kept == (n == 0) for n, kept in rows) < 0.95 * len(rows)
    # against labels the posterior is better than the demand that all rules pass
    both = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in both)
    strict = sum(all(r[n] not in (quality_rules.BAD, quality_rules.SUSPECT) for n in names) == (r.quality == 1) for r in both)
    assert right >= 0.99 * len(both) > strict


def test_accuracies_come_from_the_votes():
    """A rule that suspects good documents often loses its say; two such votes that go together do not.

    (Whether a bad vote that goes with no other is right cannot be told from votes; the pseudo-votes do.)
    """
    rng = random.Random(3)
    bad, ok, sus = quality_rules.BAD, quality_rules.GOOD, quality_rules.SUSPECT
    docs = []
    for _ in range(4000):
        junk = rng.random() < 0.2
        vote = lambda p, v: v if rng.random() < p else ok
        docs.append((vote(0.9 if junk else 0.001, bad), vote(0.8 if junk else 0.02, sus), vote(0.3, sus)))
    model = quality_rules.fit(list(Counter(docs).items()), 3)

    def good(d):
        at = model.likelihoods(list(d))
        return 1 / sum(math.exp(x - at[0]) for x in at)

    assert good((ok, ok, sus)) > 0.9 and good((bad, sus, ok)) < 0.05
    assert 0.2 < math.exp(model.logs[0][2][1]) < 0.4 and math.exp(model.logs[0][1][1]) < 0.06


def test_a_very_long_text_is_judged_whole(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [long, long + " again and again and again and again", "a b c " * 50_000]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == base(t)


def test_junk_goes_and_prose_stays(spark):
    r = QUERIES["op8_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = r.where("not base_failed").select("quality", "kept").collect()
    assert all(x.kept == (x.quality == 1) for x in rows) and {x.quality for x in rows} == {0, 1}


def test_passages_cover_whole_texts():
    texts = [b"", b"  \n", b"one", " ".join(f"Wört{i}" for i in range(1234)).encode(), b"x " * 50]
    x, bags = quality_model.passages(texts)
    assert bags.tolist() == [1, 1, 1, 25, 1] and x.shape == (29, quality_model.N_FEATURES) and np.isfinite(x).all()
    alone = [quality_model.passages([t])[0] for t in texts]
    assert np.allclose(np.concatenate(alone), x)


def test_a_text_is_described_alone():
    """No byte of a neighbour counts, be it white space or not."""
    text = " ".join(f"good words here {i}." for i in range(20)).encode()
    alone = quality_model.passages([text])[0]
    for after in (b"   \n\n x", b"", b" " * 5000, b"\t" * 9, b"!!! ###"):
        for texts, at in (([text, after], 0), ([after, text], 1), ([after, text, after], 1)):
            x, bags = quality_model.passages(texts)
            first = int(bags[:at].sum())
            assert np.array_equal(x[first : first + bags[at]], alone), (after, at)
    assert not np.array_equal(quality_model.passages([text + b"   \n"])[0], alone)  # its own white space counts


def test_training_reads_all_passages_of_unique_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_model, "train", lambda x, bags, y, **kw: seen.append((x.shape, bags, y)))
    long = " ".join(f"w{i}" for i in range(30_000))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(ids[0], long)] + [(i, f"text {i}") for i in ids for _ in range(3)] + [(ids[1], None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] * 2, "doc_id long, quality int")
    quality_model.fit(docs, labels, sample=len(ids))
    shape, bags, y = seen[0]
    assert len(bags) == len(y) == len(ids) and shape[0] == bags.sum() and max(bags) in (1, 600)
    other = next(i for i in ids if i % 2 != ids[0] % 2 and i != ids[1])  # both labels are needed
    quality_model.fit(docs.where(F.length("text") > 1000).union(docs.where(F.col("doc_id") == other)), labels, sample=len(ids))
    assert sorted(seen[1][1]) == [1, 600]


def test_gradient_of_attention():
    """One step on one bag changes the weights along the numeric gradient."""
    rng = np.random.default_rng(0)
    x, bags, y = rng.normal(size=(9, 5)), np.array([4, 5]), np.array([0.0, 1.0])
    model = quality_model.train(x, bags, y, epochs=40, batch=2, code=4, gate=3)
    assert ((model.forward(x, bags)[0] >= 0.5) == (y == 1)).all()
    attention = model.forward(x, bags)[1]["a"]
    assert np.allclose(np.add.reduceat(attention, [0, 4]), 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_quality_model"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit(docs, x) for x in (labels, turned))
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def test_model_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "some text here", "x"), (5, "word " * 40_000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    for labels in (none, spark.createDataFrame([(2, 1), (5, 0), (5, 0), (2, 0)], "doc_id long, quality int")):
        out = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality_model.score(docs.limit(0), quality_model.fit(docs.limit(0), none)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string, hits string, id long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """sf0.001 with odd rows, in another number of files, with further columns."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"text2": F.lit("x"), "hits": F.lit("y"), "id": F.lit(1).cast("long")})
    first = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    prose = " ".join(w for r in docs.where("lang = 'en'").orderBy("doc_id").limit(12).collect() for w in r.text.split()[5:20])
    rows = [(None, None, None, None, None, None, None, None), (9001, "", "en", "s", 0, "x", "y", 1), (9002, first.text, "en", "s", first.n_chars, "x", "y", 1), (9002, first.text, "en", "s", first.n_chars, "x", "y", 1),
            (9003, f"{prose} {item.text} {prose}", "en", "s", 1, "x", "y", 1), (9004, prose, "en", "s", 1, "x", "y", 1), (None, prose + " and more", None, None, None, None, None, None), (9006, "word and " * 30_000, "en", "s", 1, "x", "y", 1)]
    docs.unionByName(spark.createDataFrame(rows, DOCS)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_stages_in_order(spark, planted):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{planted}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{planted}/labels.parquet").collect()}
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns, name
        before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in out.collect())
        assert not after - before
        kept[k] = after
        docs = out.cache()
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in kept[0] for i in good]) > 0.97 and np.mean([i not in kept[0] for i, q in labels.items() if q == 0]) > 0.9
    assert 9003 in kept[0] and 9004 in kept[0]
    assert 9002 not in kept[1]  # an exact copy of an earlier document
    assert all(n == 1 for n in kept[2].values())
    assert 9003 not in kept[3] and 9004 in kept[3]


def test_run_packs_what_is_left(spark, planted):
    rows = corpus_pipeline.run(spark, planted).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 1024
    by_doc = Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in rows if r.doc_id is not None) and 9003 not in by_doc


def test_pipeline_of_an_empty_table(spark, planted, tmp_path):
    folder = str(tmp_path / "none")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
