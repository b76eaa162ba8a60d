"""A Merkle manifest of a dataset as a persistent tree with path copying.

Rows are leaves; in each group (a source) every 16 consecutive nodes become one, until one is left, and
the groups' roots become the root in the same way.

1. Leaves are hashed where the rows are and their texts dropped. They are stored in order of group and
   doc_id; a leaf's place is its row number in the stored table less the first one of its group, so no
   group is ever sorted in one task.
2. Aligned blocks of 4096 leaves are built in one task each. What lies above the blocks is far smaller
   and is built a level at a time by aggregations over the whole table.
3. The siblings on the way from each block to the root are handed down level by level.
4. Every tampered leaf makes a version of its block's tree: the nodes of ``PersistentTree`` are never
   changed, a version copies the ancestors of its leaf and shares all other nodes with the untouched
   tree. The version goes on above the block with the siblings that were handed down, in the task of
   its block, so the versions of the whole tree are as distributed as the blocks are.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_key, stored

FAN = 16
#: Levels inside a block; a block has FAN ** LEVELS leaves.
LEVELS = 3
BLOCK_BITS = 4 * LEVELS


def combine(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class PersistentTree:
    """Nodes of all versions of one tree, each a digest with the numbers of its children.

    Nodes are only ever added. ``roots[0]`` is the first version's root; ``put`` gives a new version
    that differs in one leaf. Heights are those that consecutive runs of 16 need, ``height`` at least,
    so that a full block ends at its own top even where it holds few leaves.
    """

    def __init__(self, leaves: list[str], height: int = 0):
        self.digests: list[str] = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        level, self.height = list(range(len(leaves))), 0
        while len(level) > 1 or self.height < height:
            level = [self._node(tuple(level[i : i + FAN])) for i in range(0, len(level), FAN)]
            self.height += 1
        self.roots = level

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(combine(self.digests[c] for c in children))
        self.children.append(children)
        return len(self.digests) - 1

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """(node, which child is next) from the first version's root down to the leaf's parent."""
        node, out = self.roots[0], []
        for level in reversed(range(self.height)):
            child = (leaf >> 4 * level) % FAN
            out.append((node, child))
            node = self.children[node][child]
        return out

    def put(self, leaf: int, digest: str) -> int:
        """A version with another digest at ``leaf``; copies the leaf's ancestors and nothing else."""
        self.digests.append(digest)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, child in reversed(self.path(leaf)):
            kids = self.children[parent]
            node = self._node((*kids[:child], node, *kids[child + 1 :]))
        self.roots.append(node)
        return len(self.roots) - 1

    def siblings(self, leaf: int) -> Iterator[str]:
        """The digests beside the leaf's path, from the leaf's level up, left to right."""
        for parent, child in reversed(self.path(leaf)):
            for i, c in enumerate(self.children[parent]):
                if i != child:
                    yield self.digests[c]


def _part(value: Column) -> Column:
    """``-`` for null, else the value behind its number of UTF-8 bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(docs: DataFrame, text: Column) -> Column:
    columns = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text]
    return F.sha2(F.concat(*map(_part, columns)), 256)


def _placed(nodes: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """Number the rows of every group ``g`` from 0 by ``order``: columns ``at`` and ``n`` (rows of the group)."""
    ranged = nodes.withColumn("uid", F.monotonically_increasing_id()).repartitionByRange("g", *order, "uid")
    row = stored(ranged.sortWithinPartitions("g", *order, "uid").drop("uid").withColumn("row", F.monotonically_increasing_id()), purpose)
    task = F.shiftright("row", 33)
    spans = row.groupBy("g", task.alias("task")).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select("g", "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")), "spans")
    return row.withColumn("task", task).join(spans, ["g", "task"]).withColumn("at", F.col("row") + F.col("shift")).drop("row", "task", "shift")


def _grouped(level: DataFrame) -> DataFrame:
    """Parents of a level (g, at, digest, n): 16 consecutive nodes each, where a group has several."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
    open_ = level.where("n > 1").groupBy("g", F.shiftright("at", 4).alias("at"), "n").agg(kids.alias("kids"))
    n = F.ceil(F.col("n") / FAN).cast("long")
    return open_.select("g", "at", n.alias("n"), F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids")


def _tree(bottom: DataFrame, purpose: str) -> list[DataFrame]:
    """The levels of all groups from ``bottom`` (g, at, n, digest) up, stored; a group ends where n is 1."""
    levels = [bottom.select("g", "at", "n", "digest")]
    while (levels[-1].agg(F.max("n").alias("n")).first().n or 1) > 1:
        levels.append(stored(_grouped(levels[-1]), purpose))
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(g, digest) of every group."""
    return functools.reduce(DataFrame.union, [x.where("n = 1").select("g", "digest") for x in levels])


def _ways(levels: list[DataFrame]) -> DataFrame:
    """(g, at, way) of every node of the lowest level: way has, level by level up to the root of the
    group, the digests left and right of the node's ancestor. Built from the top down."""
    step = "array<struct<left:string,right:string>>"

    def tops(level: DataFrame) -> DataFrame:
        return level.where("n = 1").select("g", "at", F.array().cast(step).alias("way"))

    ways = tops(levels[-1])
    for level, parents in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        down = parents.select("g", "at", "kids").join(ways, ["g", "at"]).select("g", "at", "way", "kids", F.posexplode("kids").alias("i", "kid"))
        own = F.struct(F.array_join(F.slice("kids", F.lit(1), F.col("i")), "").alias("left"), F.array_join(F.slice("kids", F.col("i") + 2, F.lit(FAN)), "").alias("right"))
        down = down.select("g", (F.col("at") * FAN + F.col("i")).alias("at"), F.concat(F.array(own).cast(step), "way").alias("way"))
        ways = stored(down.union(tops(level)), "ways")
    return ways


def _block_root(key: tuple, leaves: pa.Table) -> pa.Table:
    """The digest of one block: of a lone block as high as its leaves need, else of the full height."""
    leaves = leaves.sort_by("at")
    n = leaves.column("n")[0].as_py()
    tree = PersistentTree(leaves.column("leaf").to_pylist(), LEVELS if n > FAN**LEVELS else 0)
    blocks = -(-n // FAN**LEVELS)
    return pa.table({"g": [key[0].as_py()], "at": [key[1].as_py()], "n": [blocks], "digest": [tree.digests[tree.roots[0]]]}, pa.schema([("g", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied long"


def _prove(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Proofs of one block's leaves, and the root of the version that each tampered leaf makes."""
    leaves = leaves.sort_by("at")
    n = leaves.column("n")[0].as_py()
    digests, tampered = leaves.column("leaf").to_pylist(), leaves.column("tampered").to_pylist()
    tree = PersistentTree(digests, LEVELS if n > FAN**LEVELS else 0)
    way = above.column("way")[0].as_py()
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    rest = "".join(s["left"] + s["right"] for s in way).encode()
    proofs, folded, copied = [], [], []
    for i, t in enumerate(tampered):
        h = hashlib.sha256("".join(tree.siblings(i)).encode())
        h.update(rest)
        proofs.append(h.hexdigest())
        if t is None or t == digests[i]:
            folded.append(root)
            copied.append(0)
            continue
        now = tree.digests[tree.roots[tree.put(i, t)]]
        for s in way:
            now = combine((s["left"], now, s["right"]))
        folded.append(now)
        copied.append(tree.height + len(way))
    k = len(digests)
    return pa.table({
        "doc_id": leaves.column("doc_id"), "leaf": pa.array(digests, pa.string()), "subroot": pa.array([subroot] * k, pa.string()), "root": pa.array([root] * k, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()), "n_copied": pa.array(copied, pa.int64()),
    })


def manifest(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, source, lang, n_chars, text): its leaf, the roots of its
    source and of the dataset, the digest of its proof, the root that its own leaf folds to, whether that
    is the root, and how many nodes its version copied.

    Where ``tampered`` holds, the leaf is checked with the text ``changed``; others fold the leaf itself.
    Each null field is ``-``; null sources are a group that comes first. Rows of a source go by doc_id,
    null last, then by leaf; equal rows are leaves each, and which comes first changes nothing. A very
    long text is hashed where it is read. Further columns are ignored; an empty table gives no row.
    """
    text = docs["text"]
    hashed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), doc_key("doc_id").alias("id"),
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("")).alias("g"),
        leaf_digest(docs, text).alias("leaf"), F.when(tampered, leaf_digest(docs, changed)).alias("tampered"),
    )
    leaves = _placed(stored(hashed, "leaves"), ["id", "leaf"], "ordered-leaves").withColumn("block", F.shiftright("at", BLOCK_BITS))
    blocks = stored(leaves.select("g", "block", "at", "n", "leaf").groupBy("g", "block").applyInArrow(_block_root, "g string, at long, n long, digest string"), "blocks")
    levels = _tree(blocks, "block-levels")
    # the groups' roots are the leaves of one more tree, whose only group is ""
    tops = _roots(levels).select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    top = stored(_placed(tops, ["source"], "ordered-sources"), "sources")
    top_levels = _tree(top, "source-levels")
    root = _roots(top_levels).first()
    source_ways = top.join(_ways(top_levels), ["g", "at"]).select(F.col("source").alias("g"), F.col("digest").alias("subroot"), F.col("way").alias("source_way"))
    above = _ways(levels).join(stored(source_ways, "source-ways"), "g")
    above = stored(above.select("g", F.col("at").alias("block"), F.concat("way", "source_way").alias("way"), "subroot", F.lit(root.digest if root else None).cast("string").alias("root")), "above-blocks")
    own = leaves.select("g", "block", "at", "n", "doc_id", "leaf", "tampered")
    return own.groupBy("g", "block").cogroup(above.groupBy("g", "block")).applyInArrow(_prove, _PROOFS)
