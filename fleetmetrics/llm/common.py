"""Helpers shared by the operators: texts, word hashes, and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id: such rows sort last, and one of them is never earlier than another.
NO_ID = 2**63 - 1
#: The bytes that separate words; ``bytes.split()`` splits on exactly these.
SPACE = "\x20\t\n\x0b\x0c\r"
#: Arrow batches are worked on in pieces of about this many bytes of text.
PIECE_BYTES = 2 << 20
#: Entries a worker keeps in a cache before it starts anew.
CACHE_ENTRIES = 200_000


_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch. Texts are long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, which may run where it is not installed, and keep the
    session's Arrow batches small."""
    for name, most in BATCH.items():
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="code-")), "corpus_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for name in ("__init__.py", *(f"llm/{f}" for f in sorted(os.listdir(os.path.join(top, "llm"))) if f.endswith(".py"))):
            z.write(os.path.join(top, name), f"{os.path.basename(top)}/{name}")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null becomes the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


#: Folders of local sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="corpus-"))
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: a later loss of an executor recomputes nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes in ``column``, one row at least."""
    sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]) if batch.num_rows and pa.types.is_binary(batch.schema.field(column).type) else None
    if sizes is None:
        if batch.num_rows:
            yield batch
        return
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; starts anew when full, which changes no result."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, n)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of a hash sequence, by prefix sums of h[k] * base**k modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = getattr(self, name)
                setattr(self, name, np.concatenate([p, p * np.uint64(pow(b, len(p), 2**64))]))

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
