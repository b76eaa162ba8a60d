"""Session helpers: required settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on (all are runtime SQL settings)."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(app: str = "fleetmetrics", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Runtime settings for the body only; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def state_partitions(spark: SparkSession) -> str:
    """Partitions for streaming state, as configured: the number stays with the checkpoint for ever, so
    it must not follow the size of the cluster that happens to start the stream."""
    return spark.conf.get("spark.sql.shuffle.partitions")


#: Scratch folders of local sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    A local session that leaves the setting empty gets a folder of its own for it; any other master is
    refused, because executors could not see a folder on the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="fleetmetrics-"))
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored; one that is not there is none of our business."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
