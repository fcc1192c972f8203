"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir, kept, shared_folder


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for a table that later stages read."""
    return shared_folder(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return kept(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, of which later stages read only the columns they need."""
    path = checkpoint_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Have the driver forget what nothing refers to, upon which Spark deletes the shuffle files of steps that are kept elsewhere.

    The driver's own collections may be far apart, and files of steps long done would fill the executors' disks meanwhile.
    """
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured shuffle width, which operators grow with the cluster's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body): the id as it is and the text as UTF-8 bytes, null kept; no other column travels."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))


def values(*columns: pa.Array, rows: int = 512) -> Iterator:
    """The values of a column, or tuples of those of several, a few hundred held as Python objects at a time."""
    for at in range(0, len(columns[0]), rows):
        held = [c.slice(at, rows).to_pylist() for c in columns]
        yield from held[0] if len(held) == 1 else zip(*held, strict=True)
    give_back()


def give_back() -> None:
    """Return what this worker freed to the machine; workers live on from stage to stage, and allocators keep freed memory for themselves."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc alone has it
except (AttributeError, OSError):
    _TRIM = None


def word_spans(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Words joined by one space, and where each word starts in that; one more start ends the last word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return b" ".join(words), np.concatenate(([0], np.cumsum(lengths)))


