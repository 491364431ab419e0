"""What the corpus operators share: sessions, the shared folder, lineage cuts, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch at most, so that whole texts pass to Python workers in small pieces.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, bounds the session's Arrow batches by bytes, and gives it a checkpoint folder where none is set."""
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if REPO not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, path) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session, whose only
    process is this one, gets a folder of its own; any other is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc._jsc.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or "file://" + tempfile.mkdtemp(prefix="gridledger-")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of fresh_dir() that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder; its lineage ends there, and a lost executor costs nothing."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def crc32_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives a worker's free memory back to the system; workers outlive their tasks, and other stages run beside what they keep."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the links a-b connect."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the least node of its component.

    Alternating large and small stars: each round is two grouped minima, which combine before the shuffle, and two
    joins, whose hot keys adaptive execution splits. Each round's edges are checkpointed. Edges never grow in number.
    Rounds end when one changes nothing.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def set_aside(df: DataFrame, needed: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but the needed ones under a name that no operator uses, and those names with the old ones."""
    aside = {f"__aside_{i}": n for i, n in enumerate(df.columns) if n not in needed}
    return df.withColumnsRenamed({n: k for k, n in aside.items()}), aside
