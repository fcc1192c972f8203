"""Exact top-k inner-product search: norm buckets, local cosine thresholds and pruned verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions

#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)
_FOCUS = 3
#: Length levels at most; a level has as many buckets as its rows ask for.
_LEVELS = 64
_LOWEST = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as floor(scale * x), x as double; null for vectors that are null or hold a null, NaN or infinity."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


class Bucket:
    """Candidates of about one length, longest first, with the coordinates of their directions sorted as they are asked for."""

    def __init__(self, ids: np.ndarray, nameless: np.ndarray, vectors: np.ndarray) -> None:
        exact = vectors.astype(float)
        norms = np.sqrt((exact**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        self.ids, self.nameless, self.vectors, self.norms = ids[order], nameless[order], vectors[order], norms[order]
        self.floats = exact[order]
        self.longest, self.largest = float(self.norms[0]) * (1 + 1e-12), float(np.abs(vectors).max(initial=0))
        self.ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.ranked:
            values = self.floats[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(values, kind="stable")
            self.ranked[f] = values[order], order
        return self.ranked[f]

    def candidates(self, query: np.ndarray, norm: float, least: float) -> np.ndarray | slice | None:
        """Row numbers that may reach a score of ``least``; None if the whole bucket can't.

        The local threshold is the cosine that a vector of the bucket's greatest length would need. Above 1 the
        bucket is passed over. If it is low, length alone prunes: shorter ones than least / |query| go. If it
        is high, the query's largest coordinates prune: a direction within the threshold has each of its coordinates
        in a narrow range around the query's, so only rows in the range of all focus coordinates remain.
        """
        if least <= 0 or norm == 0:
            return slice(None) if least <= 0 else None
        local = least / (norm * self.longest) if self.longest else np.inf
        if local > 1 + 1e-9:
            return None
        keep = int(np.searchsorted(-self.norms, -(least / norm) * (1 - 1e-9), side="right"))
        if local < 0.5:
            return slice(keep)
        unit = query / norm
        hits = np.zeros(len(self.ids), np.int8)
        slack = np.sqrt(max(0.0, 1 - min(local, 1.0) ** 2))
        focus = np.argsort(-np.abs(unit), kind="stable")[:_FOCUS]
        for f in focus.tolist():
            across = np.sqrt(max(0.0, 1 - unit[f] ** 2))
            low = -1.0 if -unit[f] >= local else unit[f] * local - across * slack
            high = 1.0 if unit[f] >= local else unit[f] * local + across * slack
            values, order = self.coordinate(f)
            hits[order[np.searchsorted(values, low - 1e-9) : np.searchsorted(values, high + 1e-9, side="right")]] += 1
        return np.flatnonzero(hits[:keep] == len(focus))

    def scores(self, query: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact integer inner products; through doubles where those are exact."""
        if self.largest * float(np.abs(query).max(initial=0)) * len(query) < _EXACT:
            return (self.floats[rows] @ query.astype(float)).astype(np.int64)
        return self.vectors[rows] @ query


def _best(ids: np.ndarray, nameless: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of rows by score, ties to the smaller id, rows without an id last."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = np.flatnonzero(scores >= cut)
        return few[np.lexsort((ids[few], nameless[few], -scores[few]))[:k]]
    return np.lexsort((ids, nameless, -scores))[:k]


def _search(q_ids: np.ndarray, q_vectors: np.ndarray, bucket: Bucket, least: np.ndarray, k: int) -> list[tuple[int, int | None, int]]:
    out: list[tuple[int, int | None, int]] = []
    norms = np.sqrt((q_vectors.astype(float) ** 2).sum(1))
    for at, own in enumerate(q_ids.tolist()):
        rows = bucket.candidates(q_vectors[at], norms[at], float(least[at]))
        if rows is None:
            continue
        ids, nameless, scores = bucket.ids[rows], bucket.nameless[rows], bucket.scores(q_vectors[at], rows)
        mine = np.flatnonzero(((ids != own) | nameless) & (scores >= least[at]))
        if len(mine):
            top = mine[_best(ids[mine], nameless[mine], scores[mine], k)]
            named = [None if none else i for i, none in zip(ids[top].tolist(), nameless[top].tolist(), strict=True)]
            out += zip([own] * len(top), named, scores[top].tolist(), strict=True)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _pairs(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) from each (bucket, block) of candidates and the block's queries with their ``least``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["query_id", "vec_id", "score"], [pa.int64()] * 3
        rows: list = []
        if left.num_rows and right.num_rows:
            ids, vectors = left["id"].combine_chunks(), _matrix(left["v"].combine_chunks())
            bucket = Bucket(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), vectors)
            rows = _search(right["id"].to_numpy(), _matrix(right["v"].combine_chunks()), bucket, right["least"].to_numpy(), k)
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    renewed = [df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("bucket", "block") for df in (candidates, queries)]
    return renewed[0].cogroup(renewed[1]).applyInArrow(run, "query_id long, vec_id long, score long")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best scores of every query, exactly; ties to the smaller id, a null id last.

    Vectors are ranked by length and cut into buckets, queries into blocks, either of at most ``bucket_bytes`` of
    vectors, which is what one task holds of each. The bucket of the longest vectors gives every query a first k-th
    score; no better than k-th results elsewhere can lie under it, so it is every other bucket's threshold. Only k
    rows a query come out of a pair of bucket and block. A vector goes to every block and a query to every bucket that is
    long enough, as in a blocked matrix product: how often follows from the memory of a task alone.

    Every row is a candidate of every query but those of the query's own id: repeated rows count each, rows of null id
    are candidates and no queries; several query rows of one id are ranked together. Vectors that are null or
    hold a null or non-finite component take no part; only vectors of equally many components, any number of them, are
    compared. Scores must fit in a long. An empty table gives no rows; other columns don't matter.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    used = checkpointed(rows.where(F.col("v").isNotNull()).withColumns({"norm": norm, "dim": F.size("v"), "asks": F.col("asks") & F.col("id").isNotNull()}))
    sizes = {r["dim"]: (r["n"], r["asked"]) for r in used.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asked")).collect()}
    found = None
    for dim, (n, asked) in sorted(sizes.items()):
        if asked:
            part = _top_k_of_dim(used.where(F.col("dim") == dim), n, asked, k, max(1, bucket_bytes // (8 * max(1, dim))))
            found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _top_k_of_dim(used: DataFrame, n: int, asked: int, k: int, most: int) -> DataFrame:
    """(query_id, vec_id, score) among the vectors of one length, buckets and blocks of about ``most`` rows at most."""
    bucket_rows = min(most, max(1024, -(-n // (2 * shuffle_partitions(used.sparkSession)))))  # fewer where that gives every core one
    blocks = max(1, -(-asked // most))
    wanted = min(_LEVELS, max(1, -(-n // bucket_rows)))
    cuts = used.stat.approxQuantile("norm", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    level = F.lit(0)
    for edge in sorted(set(cuts), reverse=True):
        level = level + (F.col("norm") < F.lit(edge)).cast("int")
    leveled = used.withColumn("level", level)
    held = leveled.groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("level").collect()
    # A level that holds more rows than a bucket, as when many lengths are equal, is cut by a hash of the row.
    parts = [max(1, -(-r["n"] // bucket_rows)) for r in held]
    first = [sum(parts[:i]) for i in range(len(parts))]
    levels = F.array(
        *[
            F.struct(F.lit(r["level"]).alias("level"), F.lit(a).alias("a"), F.lit(p).alias("p"), F.lit(r["longest"]).alias("longest"))
            for r, a, p in zip(held, first, parts, strict=True)
        ]
    )
    mine = F.filter(levels, lambda x: x["level"] == F.col("level"))[0]
    # Equal rows are dealt apart: a row number, fixed by the checkpoint, is hashed with the id.
    place = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), mine["p"].cast("long"))
    bucketed = checkpointed(leveled.withColumn("bucket", (mine["a"] + place).cast("int")).select("id", "v", "bucket"))
    lowest = F.lit(_LOWEST).cast("long")
    queries = used.where("asks").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("id", "v", "norm", "block")

    def spread(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        """Candidates go to every block of queries; queries to the buckets that are long enough for them."""
        every = F.sequence(F.lit(0), F.lit(blocks - 1))
        return _pairs(candidates.select("id", "v", "bucket", F.explode(every).alias("block")), asking.select("id", "v", "least", "block", "bucket"), k)

    opening = checkpointed(_ranked(spread(bucketed.where("bucket = 0"), queries.withColumns({"bucket": F.lit(0), "least": lowest})), k).drop("rank"))
    if sum(parts) == 1:
        return opening
    least = opening.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = queries.join(least, queries["id"] == least["q"], "left").withColumn("least", F.coalesce("least", lowest))
    reach = F.sqrt("norm") * (1 + 1e-9)
    open_to = F.filter(levels, lambda x: (F.col("least") <= 0) | (reach * F.sqrt(x["longest"]) >= F.col("least")))
    sent = bounded.withColumn("to", F.explode(open_to)).withColumn(
        "bucket", F.explode(F.sequence(F.col("to.a"), F.col("to.a") + F.col("to.p") - 1))
    )
    return opening.union(spread(bucketed.where("bucket > 0"), sent.where("bucket > 0")))
