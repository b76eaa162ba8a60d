"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetmetrics.llm import merkle
from fleetmetrics.llm.common import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def part(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """All levels from the leaves to the root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def beside(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def plain(rows):
    groups = {}
    for d, s, la, n, t in rows:
        bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        leaf, other = (h("".join(map(part, (d, s, la, n, x)))) for x in (t, t.translate(LOWER) if t is not None else None))
        groups.setdefault(s, []).append(((d is None, d or 0, leaf), d, leaf, other if bad else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[0])]) for s in order}
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, d, leaf, now) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            way = [*beside(trees[s], i), *beside(top, k)]
            for left, right in way:
                now = h("".join([*left, now, *right]))
            out.append((d, leaf, trees[s][-1][0], top[-1][0], h("".join(x for a, b in way for x in (*a, *b))), now, now == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    ship(spark)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("x") for c in ("g", "leaf", "n", "uid", "way")}).repartition(3)
    got = merkle.manifest(docs, F.crc32(docs["doc_id"].cast("string")) % 5 == 0, F.translate("text", UPPER, UPPER.lower()))
    return sorted((tuple(r)[:7] for r in got.collect()), key=repr)


def test_equals_a_plain_tree(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot", "hot", "b", "é", "", None, f"s{i % 40}"]), rnd.choice(["en", None]), rnd.choice([i, None]), rnd.choice(["Some Text", "no capitals", "", None, "ÉÀ Z"])) for i in range(1500)]
    rows += [(None, "hot", None, None, "X"), (None, "hot", None, None, "X"), (7, "hot", "en", 1, "Twice"), (7, "hot", "en", 1, "Twice"), (9_000, "alone", "en", 1, "Long " * 200_000)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert any(not r[6] for r in got)


@pytest.mark.parametrize("n", [1, 16, 17, 4096, 4097, 8200])
def test_sizes_around_blocks(spark, n):
    rows = [(i, "one", "en", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_versions_share_what_they_do_not_change():
    leaves = [h(str(i)) for i in range(300)]
    tree = merkle.PersistentTree(leaves)
    before, size = list(tree.digests), len(tree.digests)
    v = tree.put(37, h("x"))
    assert tree.digests[:size] == before and len(tree.digests) == size + 1 + tree.height
    assert tree.digests[tree.roots[v]] == climb([*leaves[:37], h("x"), *leaves[38:]])[-1][0]
    assert tree.digests[tree.roots[0]] == climb(leaves)[-1][0]
    old, new = tree.children[tree.roots[0]], tree.children[tree.roots[v]]
    assert sum(a != b for a, b in zip(old, new, strict=True)) == 1
