"""Audits of answers as they arrive: each micro-batch is one dataset, written once however often it is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans import audit as plan


def audit_stream(answers: DataFrame, items: DataFrame, out: str, **options) -> DataStreamWriter:
    """A writer that audits the stream ``answers(audit, pkg, answer)`` against ``items`` and puts reports under ``out``.

    A batch overwrites its own folder ``batch=<id>``, so that a batch run again after a failure adds nothing twice.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        plan.audit(batch, items, **options).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return answers.writeStream.foreachBatch(one)


def distinct_answers(answers: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """Answers without repeats of the same text for the same package within ``late``: equal inputs give equal reports."""
    keyed = answers.withColumn("__key", F.sha2(F.concat_ws("\n", F.col("pkg").cast("string"), "answer"), 256))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def pooled_by_window(rows: DataFrame, at: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Grounded share over all tokens of each window; ``rows`` has the counts grounded_tokens and floating_tokens."""
    sums = rows.withWatermark(at, late).groupBy(F.window(at, width).alias("window")).agg(F.sum("grounded_tokens").alias("grounded"), F.sum("floating_tokens").alias("floating"))
    return sums.select("window.start", "window.end", "grounded", "floating", F.try_divide(F.col("grounded"), F.col("grounded") + F.col("floating")).alias("grounded_share"))
