"""Line, substring and SimHash dedup, and decontamination: against brute force on small corpora."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetmetrics.llm import decontaminate, line_dedup, simhash, substring_dedup
from fleetmetrics.llm.components import components

SF = "/root/testdata/sf0.001"


def frame(spark, rows, extra="key"):
    return spark.createDataFrame([(*r, "x") for r in rows], f"doc_id long, text string, `{extra}` string")


def lines_corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(1, 9))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.7 else f"only here {i} {k} and nowhere else in the corpus" for k in range(rng.randint(0, 12))]
        if docs and rng.random() < 0.4:  # a run of an earlier document
            other = rng.choice(docs).split("\n")
            a = rng.randrange(len(other))
            lines[1:1] = other[a : a + rng.randint(1, 8)]
        docs.append("\n".join(x if rng.random() < 0.9 else f"  {x}\t\n" for x in lines))
    return docs


def brute_lines(docs, least):
    """Number of lines in runs of at least ``least`` words that begin earlier as well."""
    seen, out = set(), []
    for t in docs:
        _, h, w = line_dedup.line_hashes(t.encode())
        gone, own = set(), set()
        for a in range(len(h)):
            for b in range(a + 1, len(h) + 1):
                if sum(w[a:b]) >= least:
                    k = tuple(h[a:b])
                    if k in seen or k in own:
                        gone.update(range(a, b))
                    own.add(k)
        seen |= own
        out.append(len(gone))
    return out


@pytest.mark.parametrize("least", [1, 8, 20])
def test_line_runs_against_brute_force(spark, least):
    docs = lines_corpus(least)
    df = frame(spark, list(enumerate(docs)), "runs").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=least).collect()}
    assert [got[i].n_removed_lines for i in range(len(docs))] == brute_lines(docs, least)
    assert any(got[i].n_removed_lines for i in got) and all(got[i]["runs"] == "x" for i in got)


def test_every_common_run_shares_a_fingerprint():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randint(1, 6) for _ in range(rng.randint(1, 12))]
        common = [rng.getrandbits(64) for _ in words]
        if sum(words) < 8:
            continue

        def prints(before, after):
            h = [rng.getrandbits(64) for _ in range(before)] + common + [rng.getrandbits(64) for _ in range(after)]
            w = [rng.randint(1, 6) for _ in range(before)] + words + [rng.randint(1, 6) for _ in range(after)]
            return set(line_dedup.fingerprints(h, line_dedup.windows(w, 8)[0]).values())

        assert prints(4, 5) & prints(7, 0) & set(common)


def test_line_dedup_cases(spark):
    run = "one two three four five\nsix seven eight nine"
    rows = [(1, run), (2, f"x\n\n{run}\ny"), (2, f"x\n\n{run}\ny"), (3, None), (4, ""), (5, " \n\t\n"), (None, run), (None, run), (0, "six seven eight nine"), (7, "a b c d e f g h\n" * 5_000)]
    out = line_dedup.dedup_lines(frame(spark, rows)).select("doc_id", "text", "n_removed_lines", "key").collect()
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.text, r.n_removed_lines) for r in out), key=str)
    assert got == sorted([(1, run, 0), (2, "x\n\ny", 2), (2, "x\n\ny", 2), (3, None, 0), (4, "", 0), (5, " \n\t\n", 0), (99, "", 2), (99, "", 2), (0, "six seven eight nine", 0), (7, "a b c d e f g h\n", 4_999)], key=str)
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_rows_without_id_are_not_gathered(spark, monkeypatch):
    """A row meets its own shared lines only, and equal rows are worked on once."""
    made = {}
    plain = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, purpose: made.setdefault(purpose, plain(df, purpose)))
    shared = [" ".join(f"s{k}x{i}" for i in range(9)) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(shared)] + [(None, f"row {k}\n{t}") for k, t in enumerate(shared)] + [(None, f"row 0\n{shared[0]}")] * 30
    out = line_dedup.dedup_lines(frame(spark, rows).repartition(4)).where("doc_id is null").collect()
    assert sorted(r.text for r in out) == sorted([f"row {k}" for k in range(20)] + ["row 0"] * 30)
    near = made["near-lines"].where("id > 1000").collect()
    assert len(near) == 20 and all(len(r.near) == 1 for r in near)
    windows = made["line-windows"].where("id > 1000")
    assert windows.count() == windows.distinct().count()


def brute_words(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 49):
            if tuple(w[s : s + 50]) in seen and seen[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = True
        for s in range(len(w) - 49):
            seen.setdefault(tuple(w[s : s + 50]), i)
        kept = " ".join(w[j] for j in np.flatnonzero(~gone))
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(4 if i % 9 == 0 else 5000)}" for _ in range(rng.choice([0, 30, 49, 50, 51, 120, 400]))]
        for _ in range(rng.randint(0, 3)):
            if docs:
                other = rng.choice(docs)
                a = rng.randrange(len(other) + 1)
                at = rng.randrange(len(w) + 1)
                w[at:at] = other[a : a + rng.choice([20, 49, 50, 51, 60, 90, 300])]
        if docs and rng.random() < 0.3:  # a near copy
            w = list(rng.choice(docs))
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = "changed"
        docs.append(w)
    rows = [(i, rng.choice([" ", "\n"]).join(w)) for i, w in enumerate(docs)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, rows, "places").repartition(5)).collect()}
    assert got == brute_words(rows)
    assert any(v[1] for v in got.values())


def test_cover_meets_every_pair_of_positions():
    shifts = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert shifts == set(range(substring_dedup.PERIOD)) and substring_dedup.ANCHOR + substring_dedup.PERIOD - 1 == substring_dedup.WINDOW


def test_substring_cases(spark):
    text = " ".join(f"v{i}" for i in range(60))
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(5, text), (9, text), (9, text), (None, text), (None, text + " more"), (2, None), (3, ""), (4, " \n"), (6, " ".join(f"v{i}" for i in range(49))), (7, "other text " * 30), (7, text), (10, long), (11, long)]
    out = substring_dedup.dedup_substrings(frame(spark, rows, "id")).collect()
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in out)
    assert got == sorted([(5, 60, 0), (9, 60, 60), (9, 60, 60), (99, 60, 60), (99, 61, 60), (2, 0, 0), (3, 0, 0), (4, 0, 0), (6, 49, 0), (7, 60, 0), (7, 60, 60), (10, 60_000, 0), (11, 60_000, 60_000)])
    assert substring_dedup.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def brute_components(prints):
    of = list(range(len(prints)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                of[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("crowd", [48, 1])
def test_links_against_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", crowd)
    rng = random.Random(11)
    prints = {0}
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            prints.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "fp long")
    links = simhash.close_pairs(df)
    rows = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in rows)
    roots = {r.node: r.root for r in components(links).collect()}
    want = brute_components(prints)
    groups, got = {}, {}
    for f, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(f)
        got.setdefault(roots.get(int(np.uint64(f).view(np.int64)), f"alone {f}"), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))
    if crowd == 48:
        pairs = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2}
        assert {tuple(sorted(p)) for p in rows} == pairs


def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    keys = simhash.codeword_indices(words)
    for bit in range(23):
        near = simhash.codeword_indices(words ^ (1 << bit))
        assert (keys[:, :, None] == near[:, None, :]).any((1, 2)).all()
    f = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for a, b in [(0, 1), (5, 40), (22, 23), (45, 46), (62, 63), (10, 63), (30, 31)]:
        g = f ^ np.uint64(1 << a) ^ np.uint64(1 << b)
        assert all(len(np.intersect1d(x, y)) for x, y in zip(simhash.fuzzy_keys(f.view(np.int64)), simhash.fuzzy_keys(g.view(np.int64)), strict=True))


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_query(spark):
    rng = random.Random(2)
    base = " ".join(f"t{rng.randrange(900)}" for _ in range(600))
    rows = [(9, base), (4, base), (7, base.replace("t1 ", "T1 ", 1)), (3, base.rsplit(" ", 1)[0]), (20, None), (21, ""), (None, " \n"), (30, "one"), (31, "ONE"), (32, "one two"), (40, "Ä b c d"), (41, "ä b c d"), (None, "lonely text of no id"), (50, "x y z " * 30_000)]
    out = simhash.near_duplicates(frame(spark, rows, "fp")).collect()
    assert sorted((r.doc_id or -1, r.fingerprint) for r in out) == sorted((i or -1, f"{plain_fingerprint(t or ''):016x}") for i, t in rows)
    ids = [r[0] for r in rows]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    roots = brute_components(prints)
    want = {}
    for i, r in zip(ids, roots, strict=True):
        want.setdefault(r, []).append(i)
    least = {r: min((i for i in m if i is not None), default=None) for r, m in want.items()}
    assert sorted(((r.doc_id or -1, r.component_id or -1) for r in out)) == sorted((i or -1, least[r] or -1) for i, r in zip(ids, roots, strict=True))
    kept = simhash.drop_near_duplicates(frame(spark, [*rows, rows[0], rows[3], rows[3]], "fp"))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(v or -1 for v in least.values())
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_rows_without_id_are_told_apart(spark):
    """Many rows without doc_id: each loses what it shares with rows that have one, and nothing else."""
    shared = [" ".join(f"s{k}x{i}" for i in range(50)) for k in range(4)]
    rows = [(k, t) for k, t in enumerate(shared)] + [(None, f"row {i} " + (shared[i % 8] if i % 8 < 4 else "alone")) for i in range(400)]
    words = substring_dedup.dedup_substrings(frame(spark, rows)).where("doc_id is null").collect()
    assert sorted(r.kept_text for r in words) == sorted(f"row {i}" if i % 8 < 4 else f"row {i} alone" for i in range(400))
    lines = line_dedup.dedup_lines(frame(spark, [(i, t.replace(" ", "\n", 2) if i is None else t) for i, t in rows])).where("doc_id is null").collect()
    assert sorted(r.text for r in lines) == sorted(f"row\n{i}" if i % 8 < 4 else f"row\n{i}\nalone" for i in range(400))


@pytest.mark.parametrize("linked", [False, True])
def test_every_component_keeps_a_row(spark, linked):
    unlike = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(8)]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (None, unlike[2]), (5, unlike[3]), (5, unlike[4]), (5, unlike[4]), (6, unlike[5]), (None, unlike[5]), (5, unlike[6]), (4, unlike[6])]
    want = [(4, unlike[6]), (5, unlike[3]), (5, unlike[4]), (6, unlike[5]), *[(None, t) for t in unlike[:3]]]
    if linked:  # two near texts without doc_id are one component, of which one stays
        long = " ".join(f"w{j}" for j in range(4_000))
        near = next(x for x in (f"{long} x{k}" for k in range(200)) if 0 < (simhash.fingerprint(x.encode()) ^ simhash.fingerprint(long.encode())).bit_count() <= 2)
        rows += [(None, long), (None, near)]
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(frame(spark, rows).repartition(3)).collect()]
    if linked:
        assert sum(t in (long, near) for _, t in kept) == 1
        kept = [x for x in kept if x[1] not in (long, near)]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and all((v == 0) == (k <= 200) for k, v in got.items()) and len(got) == 501


def brute_hits(docs, items):
    out = set()
    for i, t in docs:
        own = decontaminate.shingles((t or "").encode().lower().split(), 5)
        for j, u in items:
            s = decontaminate.shingles((u or "").encode().lower().split(), 5)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                out.add((i, j, len(s), len(s & own)))
    return out


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_hits_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(j, " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 9, 15, 40, 90])))) for j in range(40)] + [(100, None), (None, "a b c d e f"), (101, "A b c d e f"), (102, "w1 " * 30)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rng.choice([0, 3, 50, 600]))]
        for _ in range(rng.randint(0, 2)):
            passage = (rng.choice(items)[1] or "").upper().split() if rng.random() < 0.2 else (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if passage:
                    passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(200, None), (200, "x a B c d e F y"), (None, "z a b c d e f"), (201, " ".join(["pad"] * 40_000) + " a b c d e f")]
    bench = spark.createDataFrame([(j, t, "x") for j, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(frame(spark, docs, "hits").repartition(3), bench)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "n_shingles", "n_shared").collect()} == brute_hits(docs, items)
    named = decontaminate.with_hits(frame(spark, docs, "Hits").repartition(3), bench)
    assert named.columns == ["doc_id", "text", "hits"]
    assert {(r.doc_id, h.item_id, h.n_shingles, h.n_shared) for r in named.collect() for h in r.hits} == brute_hits(docs, items)
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame(spark, docs).limit(0), bench).count() == 0


def test_hits_keep_the_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    out = decontaminate.with_hits(df, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert out.columns == [*df.columns, "hits"] and out.count() == df.count() and out.where(F.size("hits") > 0).count() > 0
