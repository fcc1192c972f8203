"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let_go

#: A vertex of more edges than this is a hub, unless there would be more than HUBS of them: their least ends are broadcast.
DEGREE, HUBS = 256, 50_000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """(u, v, m): ``edges`` with the least vertex among ``u`` and its listed neighbours.

    Hubs would bring all their edges to one task; of ``count`` edges at most HUBS vertices are hubs, so what is
    broadcast for them has that bound, and only the edges of other vertices are shuffled.
    """
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    degree = max(DEGREE, -(-count // HUBS))
    hubs = F.broadcast(least.where(F.col("n") > degree).select("u", "m"))
    rest = edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= degree).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * count).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, count)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of ``edges(u, v)``; root is the least vertex reachable from u.

    Large-star and small-star steps alternate until no edge changes. Each round is kept in the shared
    checkpoint folder, so neither lineage nor the driver grows with the graph. Null ends and loops are
    ignored, repeated edges count once, an empty edge list gives no rows.
    """
    now = checkpointed(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == before:
            break
        before = mark
        let_go(now.sparkSession)
        now = checkpointed(_small_star(_large_star(now, mark[0]).where("u <> v").distinct(), mark[0]).where("u <> v").distinct())
    roots = now.select("u", F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
