"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good, suspect or bad on a document, or abstains. The two thresholds of a measure are one
rule with graded votes, not two rules that always agree. Votes are counted by pattern: at most
4 ** rules rows whatever the corpus holds, and the only thing the driver sees. Expectation maximisation
over these counts estimates how often each rule votes which way on good documents and on each kind of
bad ones. The posterior of being good replaces the demand that all rules pass: a vote that turns up on
good documents as often as on others says little, however bad it sounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once: as a lambda variable it is not copied into the body."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    one = F.translate(text, SPACE, " " * len(SPACE))
    return F.filter(F.split(one, " "), lambda w: w != "")


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in an n-word window that occurs twice or more in the text.

    Most texts have no such window, which a distinct count tells. Else windows are sorted by hash,
    equal neighbours give the starts of repeated windows, and each start in text order covers n words
    or as many as there are up to the next start.
    """

    def hashes(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        return F.when(F.size(w) >= n, each).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda p, k: F.coalesce(F.least(F.lit(n), F.get(a, k + 1) - p), F.lit(n))), F.lit(0).cast("long"), lambda t, x: t + x))

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ranked, covered))

    return let(words, lambda w: let(hashes(w), count))


def measures(text: Column) -> dict[str, Column]:
    """The base figures of a text and a few more that the rules read; a null text has no word."""
    whole = F.coalesce(text, F.lit(""))
    words = words_of(whole)
    kinds = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_kinds"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    lines = let(F.filter(F.split(whole, "\n"), lambda x: F.translate(x, SPACE, "") != ""), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    length = F.length(whole)
    return {
        "kinds": kinds,
        "lines": lines,
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_shouts": (length - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long"),
        "n_upper": (length - F.length(F.regexp_replace(whole, r"\p{Lu}+", ""))).cast("long"),
    }


#: Votes are codes without an order; ``LEVELS`` are the ones that say something.
BAD, NONE, GOOD, SUSPECT = -1, 0, 1, 2
LEVELS = (BAD, SUSPECT, GOOD)


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else suspect where ``suspect`` holds, else good where ``good`` holds."""

    name: str
    bad: Column
    suspect: Column
    good: Column


def rules() -> list[Rule]:
    """Shares are of words or of the characters in words; a text without words gets no good vote.

    What depends on one another by construction is one rule: a repeated line repeats its words too. A
    short text has its first words' capitals in a larger share, so a few are free.
    """
    words, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    some, kinds, length = words >= 20, F.col("n_kinds"), chars / F.greatest(words, F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") > 0.03 * chars, F.col("n_symbols") > 0.005 * chars, some),
        Rule("shouting", F.col("n_shouts") > 0.1 * F.greatest(words, F.lit(1)), F.col("n_shouts") > 0.02 * words, some),
        Rule("capitals", F.col("n_upper") > 0.3 * chars, F.col("n_upper") > 0.03 * chars + 6, some),
        Rule("repetition", (F.col("n_repeat_words") > 0.5 * words) | ((F.col("n_lines") > 4) & (F.col("n_dup_lines") > 0.5 * F.col("n_lines"))), (F.col("n_repeat_words") > 0.02 * words) | (F.col("n_dup_lines") > 0), some),
        Rule("variety", (words >= 50) & (kinds < 0.1 * F.least(words, F.lit(2000))), (words >= 50) & (kinds < 0.5 * F.least(words, F.lit(400))), some),
        Rule("word length", (words >= 10) & ((length < 2) | (length > 15)), some & ((length < 4.3) | (length > 6.5)), some),
        Rule("shortness", words < 10, words < 100, some),
    ]


def votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"vote_{i}": F.when(r.bad, F.lit(BAD)).when(r.suspect, F.lit(SUSPECT)).when(r.good, F.lit(GOOD)).otherwise(F.lit(NONE)) for i, r in enumerate(rules())})


@dataclass(frozen=True)
class LabelModel:
    """Class 0 is good; class c is bad in the way that rule c - 1 looks for, with whatever else goes with it.

    ``prior`` has the log share of each class, ``logs`` for each class and rule the log probabilities of
    a bad, a suspect and a good vote, given that the rule votes.
    """

    prior: tuple[float, ...]
    logs: tuple[tuple[tuple[float, ...], ...], ...]

    def likelihoods(self, votes: list) -> list:
        """log(share x likelihood) of each class; an abstention says nothing."""
        return [p + sum(at[LEVELS.index(v)] for at, v in zip(c, votes, strict=True) if v != NONE) for p, c in zip(self.prior, self.logs, strict=True)]

    def posterior(self) -> Column:
        """The probability of class 0 as an expression over the vote columns."""

        def score(c: int) -> Column:
            out = F.lit(self.prior[c])
            for i, at in enumerate(self.logs[c]):
                vote = F.col(f"vote_{i}")
                out = out + F.when(vote == GOOD, at[2]).when(vote == BAD, at[0]).when(vote == SUSPECT, at[1]).otherwise(0.0)
            return out

        rest = F.lit(0.0)
        for c in range(1, len(self.prior)):
            rest = rest + F.exp(score(c) - score(0))
        return 1 / (1 + rest)


#: Pseudo-votes (bad, suspect, good) that each estimate starts from and keeps: of any rule on good
#: documents, of a rule on the bad documents it looks for, and of other rules on those. They are a few
#: dozen votes against all of the corpus, and settle only what the corpus cannot tell, such as whether
#: documents with a bad vote that goes with no other vote are bad.
GOOD_VOTES, OWN_VOTES, OTHER_VOTES = (0.1, 5.0, 44.9), (8.0, 1.5, 0.5), (0.5, 1.5, 8.0)
#: The share of bad documents at the start.
BAD_SHARE = 0.1


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 100) -> LabelModel:
    """Expectation maximisation over counted vote patterns.

    Rules are dependent among bad documents (what shouts also repeats), so the bad are a mixture: each
    rule starts a class, in which all rules may come to vote any way; within a class votes are taken as
    independent. No estimate is bounded. An empty table gives the model of the pseudo-votes.
    """
    classes = range(n_rules + 1)
    start = [[GOOD_VOTES if c == 0 else OWN_VOTES if c == i + 1 else OTHER_VOTES for i in range(n_rules)] for c in classes]
    share = [1.0 - BAD_SHARE] + [BAD_SHARE / n_rules] * n_rules
    coded = [([LEVELS.index(v) if v != NONE else -1 for v in p], n) for p, n in sorted(patterns)]

    def model(weight: list[float], seen: list[list[list[float]]]) -> LabelModel:
        total = sum(weight)
        return LabelModel(tuple(math.log(w / total) for w in weight), tuple(tuple(tuple(math.log(x / sum(s)) for x in s) for s in c) for c in seen))

    now = model(share, [[list(x) for x in c] for c in start])
    for _ in range(rounds):
        weight, seen = list(share), [[list(x) for x in c] for c in start]
        for pattern, n in coded:
            at = [p + sum(r[v] for r, v in zip(c, pattern, strict=True) if v >= 0) for p, c in zip(now.prior, now.logs, strict=True)]
            most = max(at)
            odds = [math.exp(x - most) for x in at]
            total = sum(odds)
            for c in classes:
                part = n * odds[c] / total
                weight[c] += part
                for i, v in enumerate(pattern):
                    if v >= 0:
                        seen[c][i][v] += part
        now = model(weight, seen)
    return now


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5, votes_too: bool = False) -> DataFrame:
    """doc_id, the base figures, whether the base rules fail, the posterior and the verdict, and the
    votes if wanted.

    Null and empty texts have no word and fail the base rules; a very long text is measured whole.
    Repeated rows are judged each, a null doc_id stays null, further columns are ignored whatever their
    names, an empty table gives no row.
    """
    m = measures(F.col("t"))
    measured = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("t")).select("doc_id", *[c.alias(n) for n, c in m.items()])
    measured = measured.select("doc_id", "kinds.*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), *[n for n in m if n not in ("kinds", "lines")])
    voted = stored(votes(measured), "quality-rules")
    names = [f"vote_{i}" for i in range(len(rules()))]
    counted = [(tuple(r[n] for n in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    model = fit(counted, len(names))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (model.posterior() >= threshold)).alias("kept"), model.posterior().alias("posterior"), *(names if votes_too else []),
    )
