"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (50 words each, the whole text). Every passage is described by
shares of character kinds, word statistics and hashed words, and encoded by one dense layer. Gated
attention weighs the passages of a bag; the weighted sum of their codes is scored by a logistic
unit. All weights are learnt together from document labels only, on a bounded sample of labelled
documents; scoring is one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_bytes

PASSAGE_WORDS, WORD_BUCKETS = 50, 24
KINDS = ["other", "space", "line", "lower", "upper", "digit", "stop", "shout", "symbol", "quote", "bracket", "wide", "mark"]


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for kind, chars in (("space", b" \t\x0b\x0c\r"), ("line", b"\n"), ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"),
                        ("stop", b".,;:"), ("shout", b"!?"), ("symbol", b"#*$%&|<>=+~^_@\\"), ("quote", b"'\"`"), ("bracket", b"()[]{}/-"), ("wide", bytes(range(0xC0, 256))), ("mark", bytes(range(0x80, 0xC0)))):
        out[np.frombuffer(chars, np.uint8)] = KINDS.index(kind)
    return out


KIND_OF = _kinds()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
N_FEATURES = len(KINDS) + 6 + WORD_BUCKETS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the number of passages of each text (one at least)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = KIND_OF[data]
    space = (kind == 1) | (kind == 2)
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stop = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=len(texts))
    bags = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_word, first_bag = np.cumsum(words) - words, np.cumsum(bags) - bags
    passage = first_bag[doc] + (np.arange(len(start)) - first_word[doc]) // PASSAGE_WORDS
    n = int(bags.sum())
    count = np.bincount(passage, minlength=n).astype(np.float64)
    out = np.zeros((n, N_FEATURES), np.float32)
    if len(start):
        # bytes belong to the passage of the word before them, up to the end of its own text; those before
        # a text's first word, and the byte between two texts, to none
        stops = np.minimum(np.append(start[1:], len(data)), ends[doc] - 1)
        spans = stops - start
        of_byte = np.repeat(passage, spans)
        body = kind[np.repeat(start - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))]
        shares = np.bincount(of_byte * len(KINDS) + body, minlength=n * len(KINDS)).reshape(n, -1)
        size = np.maximum(1, shares.sum(1))
        out[:, : len(KINDS)] = shares / size[:, None]
        length = stop - start
        power = np.empty(int(length.max()) + 1, np.uint64)
        power[0] = 1
        power[1:] = _BASE
        power = np.cumprod(power)
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        letters = data[np.repeat(start, length) + within].astype(np.uint64) | np.uint64(0x20)
        h = np.add.reduceat(letters * power[within], np.cumsum(length) - length)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        some = np.maximum(1, count)
        j = len(KINDS)
        out[:, j] = np.bincount(passage, length, n) / some / 10
        out[:, j + 1] = np.sqrt(np.bincount(passage, length.astype(float) ** 2, n) / some) / 10
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])])
        out[:, j + 2] = np.bincount(passage, same, n) / some
        kinds = np.unique((passage.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
        out[:, j + 3] = np.bincount((kinds >> np.uint64(32)).astype(np.int64), minlength=n) / some
        capital = KIND_OF[data[start]] == KINDS.index("upper")
        out[:, j + 4] = np.bincount(passage, capital, n) / some
        out[:, j + 6 :] = np.sqrt(np.bincount(passage * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, -1) / some[:, None])
    out[:, len(KINDS) + 5] = np.log1p(np.repeat(words, bags)) / 8
    return out, bags


@dataclass
class Model:
    """Weights: scaling, encoder, both gates of the attention, their query, and the final unit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.weights
        first = np.cumsum(bags) - bags
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        code = np.tanh(x @ w["enc"] + w["enc_b"])
        t, g = np.tanh(code @ w["v"]), 1 / (1 + np.exp(-(code @ w["u"])))
        e = (t * g) @ w["q"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        a = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(a[:, None] * code, first)
        score = 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out_b"], -30, 30)))
        return score, {"x": x, "code": code, "t": t, "g": g, "a": a, "z": z}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*passages(texts))[0].astype(np.float64)


def train(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, epochs: int = 30, batch: int = 64, code: int = 24, gate: int = 16, seed: int = 7) -> Model:
    """Adam on the cross entropy; the rarer label weighs more, by the root of the ratio."""
    rng = np.random.default_rng(seed)
    model = Model(x.mean(0), x.std(0) + 1e-3, {
        "enc": rng.normal(0, 0.3, (x.shape[1], code)) / np.sqrt(x.shape[1]) * 3, "enc_b": np.zeros(code), "v": rng.normal(0, 0.3, (code, gate)), "u": rng.normal(0, 0.3, (code, gate)),
        "q": rng.normal(0, 0.3, gate), "out": rng.normal(0, 0.3, code), "out_b": np.zeros(()),
    })
    w = model.weights
    share = np.clip(labels.mean(), 0.01, 0.99)
    cost = np.where(labels == 1, np.sqrt((1 - share) / share), np.sqrt(share / (1 - share)))
    m, v, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    first = np.cumsum(bags) - bags
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            b = bags[chosen]
            rows = np.repeat(first[chosen] - (np.cumsum(b) - b), b) + np.arange(b.sum())
            score, f = model.forward(x[rows], b)
            d = (score - labels[chosen]) * cost[chosen] / len(chosen)
            start = np.cumsum(b) - b
            dz = np.repeat(d[:, None] * w["out"], b, axis=0)
            da = (dz * f["code"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, start), b))
            dt, dg = de[:, None] * w["q"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["q"] * f["t"] * f["g"] * (1 - f["g"])
            dc = (f["a"][:, None] * dz + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["code"] ** 2)
            grad = {"enc": f["x"].T @ dc, "enc_b": dc.sum(0), "v": f["code"].T @ dt, "u": f["code"].T @ dg, "q": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d, "out_b": d.sum()}
            step += 1
            rate = 0.01 * 0.5 ** (epoch / 10)
            for k in w:
                g = grad[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learnt from; a row without doc_id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = 6000) -> Model:
    """Learn from all passages of at most ``sample`` labelled documents that are not held out (those with
    the smallest hash of doc_id). Null labels are left out; of several labels of a document the mean
    decides, a half being good, and of several rows with its doc_id the one with the smallest hash of
    its text counts. Without both labels in the sample every document gets the same score."""
    known = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out("i"))
    chosen = known.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    few = docs.select(F.col(doc_id).cast("long").alias("i"), text_bytes(text).alias("t")).join(F.broadcast(chosen), "i")
    # all features of a document, however many rows have its doc_id; only the sample is shuffled
    few = few.groupBy("i", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("one")).select("i", "y", "one.t")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "t", 512 << 10):
                x, bags = passages(piece.column("t").to_pylist())
                cut = np.cumsum(bags)
                own = [x[e - b : e].astype(np.float32).tobytes() for e, b in zip(cut, bags, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("i"), piece.column("y"), pa.array(own, pa.binary())], ["i", "y", "x"])

    rows = sorted((r.i, r.y, bytes(r.x)) for r in few.mapInArrow(describe, "i long, y int, x binary").collect())
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y)) < 2:
        x = np.zeros((1, N_FEATURES))
        return train(x, np.array([1]), np.array([y[0] if len(y) else 1.0]), epochs=1)
    each = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return train(np.concatenate(each).astype(np.float64), np.array([len(e) for e in each]), y)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text. Null and empty texts are a bag of one
    passage without words, a very long text is a bag of all its passages; repeated rows get equal
    scores, whatever other rows are scored with them; a column named as ``into`` is replaced, others
    stay; an empty table stays empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, texts, size = [np.zeros(0)], [], 0
            for t in batch:
                texts.append(t)
                size += len(t)
                if size > 512 << 10:
                    out.append(model.scores(texts))
                    texts, size = [], 0
            if texts:
                out.append(model.scores(texts))
            yield pd.Series(np.concatenate(out))

    return docs.withColumn(into, run(text_bytes(text)))
