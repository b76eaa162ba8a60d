"""SimHash near-duplicates with Golay-code fuzzy hashing.

Documents with equal fingerprints are one group from the start (pre-aggregated); the search runs on
distinct fingerprints. A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two
fingerprints differ in at most two bits, then in one of the three cyclic pairs of segments the first
segment is equal and the second differs in at most one bit: two errors in one segment leave the pair
of the others, errors in two segments leave the pair that starts at the third.

The second segment is read as a word of the perfect (23, 12) Golay code and decoded to all codewords
within distance 4: one, or six if the nearest is at distance 3. The nearest codeword of a word is at
most 3 away, so at most 4 from a neighbour: words one bit apart share a codeword. The key is the
pair, the exact segment and the 12-bit index of the codeword; about 16 keys a fingerprint.

Fingerprints that share a key are compared. A key with many fingerprints is not expanded into pairs:
its members are put under all 65 words within one bit of them instead. Two words differ in at most
two bits exactly if they have such a middle word in common, and all under a middle word (65 at most)
are linked, so a star there loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, doc_key, free_names, stored, text_bytes
from .components import components

# fixed values: generator polynomial of the (23, 12) Golay code, and the hash seed of the contract
GENERATOR, HASH_SEED = 0b110001110101, 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A key with more distinct fingerprints than this goes by middle words.
PAIRWISE = 48


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash over word shingles, repeats included: a bit is set if over half the hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, into: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a long; null and empty texts and texts without words have zero."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(into, run(text_bytes(text)))


@lru_cache(maxsize=1)
def _code() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each 23-bit word's halves, and the errors of weight 4 or less by syndrome."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[remainder(e)].append(e)
    width = max(map(len, found))
    return np.concatenate([low, high]), np.array([e + [e[0]] * (width - len(e)) for e in found], np.int64)


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords within distance 4 (the nearest repeated
    where there is but one)."""
    halves, errors = _code()
    syndrome = halves[words & 0xFFF] ^ halves[(1 << 12) + (words >> 12)]
    return (words[:, None] ^ errors[syndrome]) >> 11


def fuzzy_keys(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The distinct keys of each fingerprint."""
    f = fingerprints.view(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys = np.concatenate([((p << 35) | (parts[p] << 12))[:, None] | codeword_indices(parts[(p + 1) % 3]) for p in range(3)], axis=1)
    return [np.unique(k) for k in keys]


def close_pairs(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, that join every two distinct fingerprints ``fp`` of at most ``bits`` (2 or
    fewer) differing bits, directly or, under a crowded key, over the smallest under a middle word."""
    if not 0 <= bits <= 2:
        raise ValueError("the keys are made for up to two differing bits")

    @F.pandas_udf("array<long>")
    def keys(f: pd.Series) -> pd.Series:
        return pd.Series(fuzzy_keys(f.to_numpy()))

    keyed = prints.select("fp", F.explode(keys("fp")).alias("key"))
    # stored, so that a join that meets a hot key has two plain sides and can be split
    crowd = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-crowds")
    shared = stored(keyed.join(crowd, "key"), "simhash-keys")
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    groups = shared.where(F.col("n") <= PAIRWISE).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("g"))
    pairs = groups.select(F.explode(F.flatten(F.transform("g", lambda x: F.transform(F.filter("g", lambda y: (y > x) & (apart(x, y) <= bits)), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    crowded = shared.where(F.col("n") > PAIRWISE).select("fp").distinct()
    if bits == 2:
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
        under = crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("middle"))
        stars = under.groupBy("middle").agg(F.collect_list("fp").alias("g")).where(F.size("g") > 1)
        links = stars.select(F.array_min("g").alias("a"), F.explode("g").alias("b"))
    else:
        flips = F.array(F.lit(0).cast("long"), *([F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)] if bits else []))
        links = crowded.select(F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("b"), F.col("fp").alias("a")).join(crowded.select(F.col("fp").alias("b")), "b").select("a", "b")
    return pairs.union(links.where("a < b")).distinct()


def _grouped(docs: DataFrame, text: str, doc_id: str, shingle: int, bits: int) -> DataFrame:
    """(id, tie, fp, component, root) of every row, with NO_ID for null; tie tells rows of one doc_id apart.

    The component is named by its smallest id, which others may have too; ``root``, one of its
    fingerprints, is its own."""
    ids = docs.select(doc_key(doc_id).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("t"))
    marked = stored(with_fingerprint(ids, "t", shingle, "fp").select("id", "tie", "fp"), "simhash-prints")
    prints = marked.groupBy("fp").agg(F.min("id").alias("first"))
    links = stored(close_pairs(prints.select("fp"), bits), "simhash-links")
    if links.isEmpty():
        named = prints.select("fp", F.col("first").alias("component"), F.col("fp").alias("root"))
    else:
        roots = components(links)
        # stored, so that a component that holds very many fingerprints can be split in the join
        rooted = stored(prints.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
        least = stored(rooted.groupBy("root").agg(F.min("first").alias("component")), "simhash-components")
        named = rooted.join(least, "root").select("fp", "component", "root")
    return marked.join(stored(named, "simhash-names"), "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable
    over links of at most ``bits`` differing bits.

    Rows with null or empty text have the fingerprint zero and link as any other; a null doc_id stays
    null and names a component only if it has no other; repeated rows each give a row; further
    columns are ignored; an empty table gives no row.
    """

    def real(c: str) -> Column:
        return F.when(F.col(c) != NO_ID, F.col(c))

    out = _grouped(docs, text, doc_id, shingle, bits)
    return out.select(real("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, bits: int = 2) -> DataFrame:
    """The one row of each component that has its smallest doc_id, with all its columns.

    Of several rows of a component with that doc_id the one with the smallest hash of the text stays,
    and one of equal rows. Components that share a doc_id, or have none, keep a row each. Cases are as
    in ``near_duplicates``.
    """
    rows = stored(_grouped(docs, text, doc_id, shingle, bits).select("id", "tie", "component", "root"), "simhash-groups")
    best = rows.where("id = component").groupBy("root", "id").agg(F.min("tie").alias("tie"))
    id_, tie = free_names(docs, "id", "tie")
    keyed = docs.withColumns({id_: doc_key(doc_id), tie: F.xxhash64(text)})
    kept = keyed.join(best.select(F.col("id").alias(id_), F.col("tie").alias(tie)), [id_, tie], "left_semi")
    if not rows.groupBy("id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_, tie])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
