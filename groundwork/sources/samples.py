"""Evidence from plain samples: one answer and its contexts in a row, under any of the usual column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWERS = ("answer", "response", "actual_output", "output")
CONTEXTS = ("contexts", "retrieved_contexts", "retrieval_context", "context")
QUESTIONS = ("question", "user_input", "input", "query")

ITEM_COLUMNS = ("pkg", "item", "item_id", "document_id", "source_path", "section", "start", "end", "layer", "producer", "text")


def _first(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    """The first of the columns that isn't null; a lone context counts as a list of one."""
    found = []
    for name in (n for n in names if n in df.columns):
        one = isinstance(df.schema[name].dataType, T.StringType)
        found.append(F.when(F.col(name).isNotNull(), F.array(name)) if one and kind != "string" else F.col(name).cast(kind))
    return F.coalesce(*found) if found else F.lit(None).cast(kind)


def resolve(samples: DataFrame, key: str = "audit") -> DataFrame:
    """(audit, pkg, answer, question, contexts, refused): samples read by their aliases; ``refused`` says why one can't be audited."""
    rows = samples.select(
        F.col(key).alias("audit"), F.col(key).alias("pkg"), _first(samples, ANSWERS, "string").alias("answer"),
        _first(samples, QUESTIONS, "string").alias("question"), _first(samples, CONTEXTS, "array<string>").alias("raw"),
    )
    kept = F.filter(F.coalesce("raw", F.array().cast("array<string>")), lambda c: c.isNotNull() & (F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) != ""))
    named = rows.withColumn("contexts", kept)
    refused = F.when(F.col("answer").isNull(), "the sample has no answer").when(F.trim(F.regexp_replace("answer", r"(?U)\s+", " ")) == "", "the answer is blank").when(
        F.col("raw").isNull(), "the sample has no contexts"
    ).when(F.size("contexts") == 0, "the contexts hold no text")
    return named.withColumn("refused", refused).drop("raw")


def items_of(resolved: DataFrame) -> DataFrame:
    """One evidence item for each context that isn't blank; offsets index the string itself."""
    rows = resolved.select("pkg", F.posexplode("contexts").alias("item", "text"))
    number = F.col("item") + 1
    return rows.select(
        "pkg", "item", F.format_string("itm_%02d", number).alias("item_id"), F.concat(F.lit("context "), number.cast("string")).alias("document_id"),
        F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("start"),
        F.length("text").alias("end"), F.lit(None).cast("string").alias("layer"), F.lit("").alias("producer"), "text",
    )
