"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks that rows of one text are dealt to.
COPIES = 4


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, beside what is shipped to them."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small text file, in any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(body, "utf-8"))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    """A table or folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt by ``keys`` over all cores before costly Python; by size alone few bytes of text would meet in one task.

    A key wrapped in a hash deals rows anew even where they already lie by that key.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; one is made only where none is set and driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="groundwork-"))


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut."""
    importable(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return kept(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into Parquet in the shared checkpoint folder: smaller than a checkpoint, and the planner knows its size.

    What no plan refers to any more is removed when the next one is stored.
    """
    spark = df.sparkSession
    importable(spark)
    path = shared_folder(spark)
    with _without_constraints(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    app = spark.sparkContext.applicationId
    with _LOCK:
        gone = [(ref, old) for ref, old, of in _STORED if of == app and ref.get() is None]
        _STORED[:] = [x for x in _STORED if x[2] == app and (x[0], x[1]) not in gone]
        _STORED.append((spark._jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation()), path, app))
    for _, old in gone:
        remove(spark, old)
    return out


def by_key(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two large sides. Sizes after text is made or exploded are guessed far too low, and a broadcast would go through the driver."""
    return left.join(right.hint("merge"), on, how)


def alike(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Rows spread with equal texts beside one another, so that Python works each out once for a batch; a very common text still meets several tasks."""
    salt = F.pmod(F.xxhash64(*keys), F.lit(COPIES))
    return spread(df.withColumn("__alike", F.xxhash64(text)), F.col("__alike"), salt).sortWithinPartitions("__alike").drop("__alike")


_LOCK = threading.Lock()
_STORED: list[tuple] = []
_OFF: dict[str, list] = {}


@contextmanager
def _without_constraints(spark: SparkSession) -> Iterator[None]:
    """Constraints off while anyone in the session needs that, and as they were after the last one is done."""
    name, session = "spark.sql.constraintPropagation.enabled", spark._jsparkSession.sessionUUID()
    with _LOCK:
        users = _OFF.setdefault(session, [0, None])
        if not users[0]:
            users[1] = spark.conf.get(name)
            spark.conf.set(name, "false")
        users[0] += 1
    try:
        yield
    finally:
        with _LOCK:
            users[0] -= 1
            if not users[0]:
                spark.conf.set(name, users[1])
                del _OFF[session]


def kept(df: DataFrame) -> DataFrame:
    """An eager checkpoint; carrying constraints over fails on some plans with renamed columns, so they are off meanwhile."""
    with _without_constraints(df.sparkSession):
        return df.checkpoint(eager=True)
