"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: every word with the two after it in its piece, padded where the
piece ends. The shorter counts are sums over them, because each occurrence of a prefix leads exactly
one window: Spark's ROLLUP over the window's columns gives those of two words, one word and all words,
so no text is taken apart a second time.

1. A task lines the words of its texts up, takes the columns led by one and by two, and counts equal
   windows in numpy. Counted windows leave it packed by bucket, many to a row.
2. A bucket holds all windows of its pairs, so sums of windows and of pairs are complete in it. Spark
   deals the buckets out and a task sums them one after the other in numpy. A window too rare to be a
   candidate gives up its third word, a pair too rare its second: they still count in their prefixes,
   and what is stored shrinks to words and frequent phrases. Pairs that a sample shows to be very
   frequent are dealt by all three words instead and keep their second word; the sample decides where
   windows are summed, never what is counted. A bucket of more windows than a task holds is handed on
   in parts, and none of its windows gives a word up.
3. ROLLUP sums the prefixes over all buckets. Both parts of any cut are at least as frequent as the
   phrase, so rows below the smallest count are of no further use.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, mixed, pieces, stored, text_bytes

# fixed values: what ends a piece, and the letters that are lower-cased
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(BREAKS))
NO_LANG = "und"
#: Bits of one word's number in a window, and windows a task holds before it hands them on.
BITS, HELD = 21, 3_000_000
#: Windows in a packed row, packed rows that a task unpacks at once, and buckets for each shuffle partition.
PACKED, UNPACKED, BUCKETS = 4096, 64, 3
#: Share of the documents in which very frequent pairs are looked for, the share of windows that makes
#: a pair one, and how many there may be.
SAMPLED, FREQUENT, MOST_FREQUENT = 0.01, 0.001, 1000
#: Parts in which a language is ranked before the ranks of its parts are merged.
PARTS = 64


def words_and_breaks(text: bytes) -> list[bytes]:
    """The words of a text; ``.``, which no word holds, stands where a piece ends."""
    return text.translate(_TABLE).replace(b".", b" . ").split()


class WindowCounts:
    """Counts of padded three-word windows by language; number 0 is the padding."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {b".": 0}
        self.counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        numbers = self.numbers
        flat: list[bytes] = []
        for t in texts:
            flat += words_and_breaks(t)
            flat.append(b".")
        for w in set(flat):
            numbers.setdefault(w, len(numbers))
        lead = np.zeros((3, len(flat)), np.int64)
        lead[0] = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        lead[1, :-1] = lead[0, 1:]
        lead[2, :-2] = np.where(lead[1, :-2] > 0, lead[0, 2:], 0)
        one, two, three = lead[:, lead[0] > 0]
        keys, n = np.unique((one << 2 * BITS) | (two << BITS) | three, return_counts=True)
        self.counts.setdefault(lang, []).append((keys, n))
        self.held += len(keys)

    def add_packed(self, lang: str, rows: pa.RecordBatch) -> None:
        """Add the windows of at most ``UNPACKED`` packed rows of one language."""
        numbers = self.numbers
        columns = [pc.list_flatten(pc.split_pattern(rows.column(c), " ")) for c in ("w1", "w2", "w3")]
        coded = pa.concat_arrays(columns).cast(pa.binary()).dictionary_encode()
        own = np.array([numbers.setdefault(w, len(numbers)) if w else 0 for w in coded.dictionary.to_pylist()], np.int64)
        one, two, three = own[coded.indices.to_numpy()].reshape(3, -1)
        n = pc.list_flatten(rows.column("n")).to_numpy()
        self.counts.setdefault(lang, []).append(((one << 2 * BITS) | (two << BITS) | three, n))
        self.held += len(n)

    def full(self) -> bool:
        return self.held >= HELD or len(self.numbers) >= 1 << (BITS - 1)

    def merge(self) -> None:
        """Sum equal windows of the pieces seen so far."""
        for lang, parts in self.counts.items():
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            self.counts[lang] = [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]
        self.held = sum(len(parts[0][0]) for parts in self.counts.values())

    def frequent_pairs(self) -> Iterator[pa.RecordBatch]:
        """(lang, w1, w2, n): pairs with at least half the wanted share of this task's windows."""
        self.merge()
        words = list(self.numbers)
        total = sum(int(n.sum()) for [(_, n)] in self.counts.values())
        rows = []
        for lang, [(keys, n)] in self.counts.items():
            pairs, at = np.unique(keys >> BITS, return_inverse=True)
            sums = np.bincount(at, n, len(pairs)).astype(np.int64)
            for i in np.flatnonzero(sums >= max(2, total * FREQUENT / 2)):
                rows.append((lang, words[pairs[i] >> BITS].decode(), words[pairs[i] & ((1 << BITS) - 1)].decode(), int(sums[i])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "w1", "w2", "n"])

    def packed(self, buckets: int, frequent: set[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
        """(bucket, lang, w1, w2, w3, n): words joined by spaces, the padding as the empty text; then
        starts anew. Windows of frequent pairs go to the second half of the buckets."""
        self.merge()
        words = list(self.numbers)
        marks = mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1))
        strings = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
        mask = (1 << BITS) - 1
        for lang, [(keys, n)] in self.counts.items():
            hot = np.array(sorted({self.numbers.get(a.encode(), -1) << BITS | self.numbers.get(b.encode(), 0) for x, a, b in frequent if x == lang}), np.int64)
            spread = np.isin(keys >> BITS, hot)
            one, two, three = keys >> 2 * BITS, (keys >> BITS) & mask, keys & mask
            h = marks[one] * np.uint64(31) + marks[two]
            h = mixed(np.where(spread, h * np.uint64(31) + marks[three], h))
            bucket = (h % np.uint64(buckets)).astype(np.int64) + np.where(spread, buckets, 0)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(first[1:], len(bucket))
            starts = np.concatenate([np.arange(a, b, PACKED) for a, b in zip(first, ends, strict=True)]) if len(first) else first
            for i in range(0, len(starts), 64):
                s = starts[i : i + 64]
                end = int(starts[i + 64]) if i + 64 < len(starts) else len(bucket)
                part = order[s[0] : end]
                offsets = pa.array(np.append(s - s[0], end - s[0]).astype(np.int32))
                joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(strings, pa.array(x[part]))), " ") for x in (one, two, three)]
                numbers = pa.ListArray.from_arrays(offsets, pa.array(n[part]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[s]), pa.array([lang] * len(s), pa.string()), *joined, numbers], ["bucket", "lang", "w1", "w2", "w3", "n"])
        self.clear()

    def shrunk(self, least: int, whole_pairs: bool, whole: bool) -> Iterator[pa.RecordBatch]:
        """(lang, w1, w2, w3, n): sums without the words that are too rare, null in their place; then
        starts anew. ``whole_pairs``: all windows of a pair are here; ``whole``: all of a window are."""
        self.merge()
        strings = pa.array([None, *list(self.numbers)[1:]], pa.binary()).cast(pa.string())
        mask = (1 << BITS) - 1
        for lang, [(keys, n)] in self.counts.items():
            if whole:
                short = np.where(n >= least, keys, keys & ~mask)
                if whole_pairs:
                    first = np.flatnonzero(np.diff(keys >> BITS, prepend=-1))
                    pair = np.repeat(np.add.reduceat(n, first), np.diff(first, append=len(keys)))
                    short = np.where(pair >= least, short, short & mask << 2 * BITS)
                keys, at = np.unique(short, return_inverse=True)
                n = np.bincount(at, n, len(keys)).astype(np.int64)
            for i in range(0, len(keys), 16 * PACKED):
                part = keys[i : i + 16 * PACKED]
                words = [pc.take(strings, pa.array(x)) for x in (part >> 2 * BITS, (part >> BITS) & mask, part & mask)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), *words, pa.array(n[i : i + 16 * PACKED])], ["lang", "w1", "w2", "w3", "n"])
        self.clear()


def summed(batches: Iterator[pa.RecordBatch], least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sums of packed rows that come bucket by bucket; the second half of the buckets has parts of pairs."""
    seen, at, whole = WindowCounts(), None, True
    for batch in batches:
        groups = list(zip(batch.column("bucket").to_pylist(), batch.column("lang").to_pylist(), strict=True))
        start = 0
        while start < len(groups):
            end = start + 1
            while end < min(len(groups), start + UNPACKED) and groups[end] == groups[start]:
                end += 1
            bucket, lang = groups[start]
            if bucket != at:
                yield from seen.shrunk(least, at is not None and at < buckets, whole)
                at, whole = bucket, True
            if seen.full():
                before = seen.held
                seen.merge()
                if seen.full() or seen.held > before // 2:
                    whole = False
                    yield from seen.shrunk(least, False, whole)
            seen.add_packed(lang, batch.slice(start, end - start))
            start = end
    yield from seen.shrunk(least, at is not None and at < buckets, whole)


def _counted(batches: Iterator[pa.RecordBatch], seen: WindowCounts) -> Iterator[None]:
    """Count all batches; stops where ``seen`` should be emptied."""
    for batch in batches:
        for piece in pieces(batch, "t"):
            langs = np.asarray(piece.column("lang").to_pylist(), object)
            texts = np.asarray(piece.column("t").to_pylist(), object)
            for lang in dict.fromkeys(langs):
                seen.add(lang, list(texts[langs == lang]))
            if seen.full():
                before = seen.held
                seen.merge()
                if seen.full() or seen.held > before // 2:
                    yield


def frequent_pairs(texts: DataFrame) -> set[tuple[str, str, str]]:
    """(lang, w1, w2) of pairs that lead a large share of the windows of a sample; a bounded list."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WindowCounts()
        for _ in _counted(batches, seen):
            yield from seen.frequent_pairs()
            seen.clear()
        yield from seen.frequent_pairs()

    found = texts.sample(SAMPLED, seed=11).mapInArrow(rows, "lang string, w1 string, w2 string, n long")
    return {(r.lang, r.w1, r.w2) for r in found.groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(MOST_FREQUENT).collect()}


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10) -> DataFrame:
    """(lang, size, w1, w2, w3, n): every phrase of one to three words found ``least`` times or more, and
    the number of all words of a language as size 0; unused words are null. The table is stored."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), text_bytes(text).alias("t"))
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_pairs(texts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WindowCounts()
        for _ in _counted(batches, seen):
            yield from seen.packed(buckets, frequent)
        yield from seen.packed(buckets, frequent)

    packed = texts.mapInArrow(windows, "bucket long, lang string, w1 string, w2 string, w3 string, n array<long>")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    tops = stored(dealt.mapInArrow(lambda batches: summed(batches, least, buckets), "lang string, w1 string, w2 string, w3 string, n long"), "longest-windows")
    levels = tops.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    size = F.when(F.col("g") == 7, 0).when(F.col("g") == 3, 1).when((F.col("g") == 1) & F.col("w2").isNotNull(), 2).when((F.col("g") == 0) & F.col("w3").isNotNull(), 3)
    levels = levels.select("lang", size.alias("size"), "w1", "w2", "w3", "n").where("size is not null")
    return stored(levels.where((F.col("size") == 0) | (F.col("n") >= least)), "phrase-counts")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 * a * a / (left * right)); decimals of 38 digits hold the products."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, left * right)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    A phrase of two or three words found ``least`` times or more is scored at its weakest cut; one
    inside a longer candidate that has ``inside`` per cent of its occurrences is left out. Null texts
    are empty, a null language is ``und``; repeated rows count each; ties go to the larger count, then
    to the phrase in byte order; a text of any length is counted whole; further columns are ignored,
    whatever their names; an empty table gives no row.
    """
    counts = phrase_counts(docs, text, lang, least)

    def of(size: int, words: dict[str, str], n: str) -> DataFrame:
        return counts.where(F.col("size") == size).select("lang", *[F.col(c).alias(name) for c, name in words.items()], F.col("n").alias(n))

    pairs, triples = of(2, {"w1": "x", "w2": "y"}, "a"), of(3, {"w1": "x", "w2": "y", "w3": "z"}, "a")
    two = pairs.join(of(1, {"w1": "x"}, "l"), ["lang", "x"]).join(of(1, {"w1": "y"}, "r"), ["lang", "y"])
    longer = triples.select("lang", "x", "y", "a").union(triples.select("lang", "y", "z", "a")).groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    two = two.join(longer, ["lang", "x", "y"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = triples.join(of(1, {"w1": "x"}, "l1"), ["lang", "x"]).join(of(2, {"w1": "y", "w2": "z"}, "r1"), ["lang", "y", "z"])
    three = three.join(of(2, {"w1": "x", "w2": "y"}, "l2"), ["lang", "x", "y"]).join(of(1, {"w1": "z"}, "r2"), ["lang", "z"])
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("cut", F.least(*cuts)).select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    scored = stored(two.union(three), "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return _ranked(scored, order, top).join(of(0, {}, "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(scored: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first rows of each language: of its parts first, so that no task sorts a whole language."""
    part, rank = free_names(scored, "part", "rank")
    parts = scored.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    heads = parts.withColumn(rank, F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col(rank) <= top)
    return heads.withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col(rank) <= top).drop(part)
