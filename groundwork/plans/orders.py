"""Answers and evidence made from the order tables, so that what an audit must find follows from the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import table

CLASSES = 10


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with ``item``, their place in the order; line numbers repeat, so the other columns decide ties."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("item", F.row_number().over(order))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package for each order, one item for each of its lines."""
    lines = numbered_lines(spark, sf_dir)
    price = F.col("l_extendedprice").cast("decimal(15,2)").cast("string")
    text = F.concat(
        F.lit("The parcel weighs "), F.col("l_quantity").cast("int").cast("string"), F.lit(" kg and left on "), F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.lit(". Its price was $"), price, F.lit("."),
    )
    return lines.select(
        F.col("l_orderkey").alias("pkg"), "item", F.concat(F.lit("line-"), F.col("item").cast("string")).alias("item_id"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("item").cast("string")).alias("document_id"),
        F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("start"), F.length(text).alias("end"),
        F.when(F.col("item") % 3 == 0, "interpretation").otherwise("fact").alias("layer"), F.lit("orders").alias("producer"), text.alias("text"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each order, of a kind chosen by the key, about the order's first line."""
    lines = numbered_lines(spark, sf_dir)
    first = lines.groupBy("l_orderkey").agg(F.min_by(F.struct(F.col("l_quantity").cast("int").alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string").alias("p")), "item").alias("f"))
    q, d, p, k = F.col("f.q"), F.col("f.d"), F.col("f.p"), F.col("l_orderkey") % CLASSES
    s = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    text = (
        F.when(k == 0, s("The parcel weighs ", q, " kg."))
        .when(k == 1, s("The parcel weighs ", q + 700, " kg."))
        .when(k == 2, s("The parcel weighs ", q, " mg."))
        .when(k == 3, s("It left on ", d, " and cost $", p, "."))
        .when(k == 4, s("It left on 1901-02-03 in a rush."))
        .when(k == 5, s("The parcel went out as planned."))
        .when(k == 6, s("The parcel weighs ", q, " kg. It left on ", d, ". It holds 98765 bolts."))
        .when(k == 7, s("```\nweight = ", q, "\n```"))
        .when(k == 8, s("# Weight ", q, " kg\n- left on ", d, "\n- cost $", p))
        .otherwise(s("The parcel weighs ", q + 900, " kg and left on ", d, ". Nothing else is known."))
    )
    return first.select(F.col("l_orderkey").alias("audit"), F.col("l_orderkey").alias("pkg"), text.alias("answer"))
