"""Line deduplication: range-partitioned hashes in secondary order, and per-document keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_partitions, values

_SPACE = b" \t\n\v\f\r"
_DROP, _OPEN, _EDGE = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lower-cased; None if it is too short to count."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, body): ``row`` tells rows of one id but different texts apart; equal rows share it."""
    text = F.col(text_col).cast("string")
    return df.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), text.cast("binary").alias("body")
    )


def _line_rows(source: DataFrame, min_chars: int) -> DataFrame:
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, digests = [], [], []
            for k, body in enumerate(values(batch.column(2))):
                for at, line in enumerate((body or b"").split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        owner.append(k)
                        place.append(at)
                        digests.append(xxhash.xxh3_128_digest(key))
            if owner:
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                own = pa.array(owner, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column(0).take(own), batch.column(1).take(own), pa.array(place, pa.int32())],
                    ["h1", "h2", "id", "row", "pos"],
                )

    return source.mapInArrow(run, f"h1 long, h2 long, id {kind}, row long, pos int")


class _Runs:
    """Streams rows sorted by (h1, h2, id descending): what each run of one hash drops.

    In a run, rows of its first document stay. Those of the second wait until a third document shows, so at
    most two documents' rows of one hash are held. Runs at either edge of the partition may go on in another
    one: what hangs on that is passed on as open, with the edge run's count and first document.
    """

    def __init__(self, min_docs: int) -> None:
        self.min_docs, self.out, self.opening, self.hash = min_docs, [], True, None

    def put(self, kind: int, rows: Iterable[tuple]) -> None:
        self.out.extend((kind, *self.hash, i, r, p, 0) for i, r, p in rows)

    def start(self, key: tuple) -> None:
        self.hash, self.count, self.head, self.last, self.held, self.lead = key, 0, None, None, [], []

    def add(self, ids: list, rows: list, places: list) -> None:
        """More rows of the present run."""
        at = 0
        while at < len(ids):
            if not self.count or ids[at] != self.last:
                self.count, self.last = self.count + 1, ids[at]
                self.head = ids[at] if self.count == 1 else self.head
                if self.count == self.min_docs:
                    self.put(_DROP, self.held)
                    self.held = []
            end = at + 1
            while end < len(ids) and ids[end] == self.last:
                end += 1
            part = list(zip(ids[at:end], rows[at:end], places[at:end], strict=True))
            if self.count == 1:
                if self.opening:
                    self.lead += part
            elif self.count < self.min_docs:
                self.held += part
            else:
                self.put(_DROP, part)
            at = end

    def close(self, final: bool) -> None:
        if self.hash is None:
            return
        if self.opening or final:
            self.put(_OPEN, self.lead + self.held)
            self.out.append((_EDGE, *self.hash, self.head, 0, 0, self.count))
        self.opening = False


def _decide(rows: DataFrame, min_docs: int) -> DataFrame:
    schema = f"kind int, h1 long, h2 long, id {dict(rows.dtypes)['id']}, row long, pos int, docs long"
    id_type = rows.schema["id"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["kind", "h1", "h2", "id", "row", "pos", "docs"]
        types = [pa.int32(), pa.int64(), pa.int64(), to_arrow_type(id_type), pa.int64(), pa.int32(), pa.int64()]

        def flush() -> Iterator[pa.RecordBatch]:
            if state.out:
                cols = zip(*state.out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
                state.out = []

        state = _Runs(min_docs)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, own, pos = (batch.column(k).to_pylist() for k in (2, 3, 4))
            cuts = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            begins, ends = np.concatenate(([0], cuts)).tolist(), np.append(cuts, len(h1)).tolist()
            for b, e in zip(begins, ends, strict=True):
                inner = b > 0 and e < len(h1)
                if inner and e - b < min_docs:  # whole and too few rows to matter
                    if state.hash is not None:
                        state.close(False)
                        state.hash = None
                    continue
                key = (int(h1[b]), int(h2[b]))
                if state.hash != key:
                    state.close(False)
                    state.start(key)
                state.add(ids[b:e], own[b:e], pos[b:e])
            yield from flush()
        state.close(True)
        yield from flush()

    return rows.mapInArrow(run, schema)


def _pack(places: pa.Array) -> pa.Array:
    out = []
    for at in values(places):
        stays = np.ones(max(at) // 8 * 8 + 8, bool)
        stays[at] = False
        out.append(zlib.compress(np.packbits(stays).tobytes()))
    return pa.array(out, pa.binary())


def keep_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """(id, row, keep): for each row that loses lines, a zlib-compressed bitmap; bit k (high first) says that
    line k stays, lines past its end stay. Rows that lose nothing have no bitmap.

    Lines are dealt by ranges of (hash, document descending), so a line that half the corpus holds spreads
    over as many tasks as it needs; hashes have 128 bits. Only runs at the edges of a partition, two a
    partition at most, are settled afterwards, by a broadcast of that size.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    rows = checkpointed(_line_rows(_keyed(df, id_col, text_col), min_chars))  # the ranges are sampled from it before it is dealt
    order = ["h1", "h2", F.col("id").desc(), "row", "pos"]
    dealt = rows.repartitionByRange(shuffle_partitions(df.sparkSession), *order[:3]).sortWithinPartitions(*order)
    found = checkpointed(_decide(dealt, min_docs))
    edges = found.where(f"kind = {_EDGE}").groupBy("h1", "h2").agg(F.sum("docs").alias("total"), F.max("id").alias("top"))
    late = (
        found.where(f"kind = {_OPEN}").drop("docs")
        .join(F.broadcast(edges.where(F.col("total") >= min_docs)), ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("top")))
    )
    drops = found.where(f"kind = {_DROP}").select("id", "row", "pos").union(late.select("id", "row", "pos"))
    pack = F.arrow_udf(_pack, "binary")
    return drops.groupBy("id", "row").agg(F.collect_list("pos").alias("at")).select("id", "row", pack("at").alias("keep"))


def _apply(bodies: pa.Array, keeps: pa.Array) -> pa.Array:
    lines, gone, kept = [], [], []
    for body, keep in values(bodies, keeps):
        body = body or b""
        n = body.count(b"\n") + 1
        if keep is not None:
            stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
            parts = body.split(b"\n")
            left = [parts[k] for k in np.flatnonzero(stays).tolist()] + parts[len(stays) :]
            gone.append(n - len(left))
            body = b"\n".join(left)
        else:
            gone.append(0)
        lines.append(n)
        kept.append(body)
    return pa.StructArray.from_arrays(
        [pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
        ["n_lines", "n_dropped", "kept"],
    )


def _judged(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """The columns of ``df`` as c0, c1, ... and ``lines``, a struct of n_lines, n_dropped and the kept text as bytes."""
    # Kept, so that no task has a worker for packing bitmaps and another for applying them.
    maps = checkpointed(keep_bitmaps(df, id_col, text_col, min_chars, min_docs)).select(F.col("id").alias("__id"), F.col("row").alias("__row"), "keep")
    renamed = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(df.columns)))
    key, text = F.col(f"c{df.columns.index(id_col)}"), F.col(f"c{df.columns.index(text_col)}").cast("string")
    joined = renamed.withColumn("row", F.xxhash64(key, text)).join(maps, (F.col("row") == F.col("__row")) & key.eqNullSafe(F.col("__id")), "left")
    # As nondeterministic it is evaluated once, and a filter on its result isn't pushed below it.
    apply = F.arrow_udf(_apply, "struct<n_lines:long,n_dropped:long,kept:binary>").asNondeterministic()
    return joined.select(*renamed.columns, apply(text.cast("binary"), F.col("keep")).alias("lines"))


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, name: str = "lines"
) -> DataFrame:
    """``df`` with struct column ``name`` (n_lines, n_dropped, kept text as bytes) added, one row per row.

    A key held by ``min_docs`` or more ids loses all its lines except those of the largest id that holds it.
    Null and empty texts are one empty line; null ids count as one document, smaller than any; rows of one id
    are one document; an empty table gives an empty one. Other columns, whatever their names, pass through; a table
    that has a column ``name`` already is refused.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name!r} already")
    judged = _judged(df, id_col, text_col, min_chars, min_docs)
    return judged.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(df.columns)), F.col("lines").alias(name))


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``df`` with the text that ``line_dedup`` leaves; rows that lost lines and have nothing left but white space go.

    Other columns pass through as they are, whatever their names; a null text that loses nothing becomes empty.
    """
    judged = _judged(df, id_col, text_col, min_chars, min_docs)
    left = judged.where((F.col("lines.n_dropped") == 0) | (F.trim(F.col("lines.kept").cast("string"), F.lit(" \t\n\u000b\f\r")) != ""))
    text = F.col("lines.kept").cast("string")
    return left.select(*((text if c == text_col else F.col(f"c{k}")).alias(c) for k, c in enumerate(df.columns)))
