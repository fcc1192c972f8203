"""Substring deduplication: difference-cover anchors, then exact windows around the anchors that match."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, values, word_spans

#: Perfect difference sets: for all i, j some shift below the period puts i and j both on the cover.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 19
_MAIL = 1 << 25
#: Bytes of text whose anchors make up a bucket, which a task holds whole, and a partition, which it reads one bucket after another.
BUCKET_BYTES, PARTITION_BYTES = 16 << 20, 128 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least two fifths of the window."""
    fit = [v for v in COVERS if window - v + 1 >= max(2, 0.4 * window)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def anchor_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions on the cover, 64-bit hashes of the anchors that start there)."""
    period, cover = cover_for(window)
    size = window - period + 1
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)))
    at = np.arange(n - size + 1)
    at = at[np.isin(at[: period] % period, cover)[at % period]] if period > 1 else at
    got = (sums[at + size] - sums[at]) * _powers(_BACK, n)[at]
    got ^= got >> np.uint64(29)
    got *= np.uint64(0xBF58476D1CE4E5B9)
    return at, got ^ (got >> np.uint64(32))


def _packed(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(a.tobytes() for a in arrays), 1)


class _Outbox:
    """Gathers (digest, document, position) of a chunk of documents and packs it by bucket.

    A digest that occurs twice in the chunk is settled at once and goes out as one record that says so, so a
    passage that a third of the corpus holds reaches its bucket once a chunk, not once a document.
    """

    def __init__(self, buckets: int, width: int) -> None:
        self.buckets, self.width = buckets, width
        self.clear()

    def clear(self) -> None:
        self.docs, self.places, self.digests, self.size = [], [], [], 0

    def put(self, doc: tuple, places: np.ndarray, digests: np.ndarray) -> None:
        self.docs.append(doc)
        self.places.append(places)
        self.digests.append(digests)
        self.size += len(places)

    def flush(self) -> Iterator[tuple]:
        """(bucket, settled, load, ids, rows): packed digests for the buckets, and places that are settled."""
        if not self.size:
            self.clear()
            return
        owner = np.repeat(np.arange(len(self.docs)), [len(p) for p in self.places]).astype(np.uint32)
        place, digest = np.concatenate(self.places).astype(np.uint32), np.concatenate(self.digests)
        order, same = _ranked(digest)
        begins = np.concatenate(([True], ~same))
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        settled = np.sort(order[twice])
        mail = _Mail(self.buckets)
        mail.add_runs(owner[settled], place[settled], self.docs)
        yield from mail.flush()
        rep, known = order[begins], twice[begins]
        keep = np.argsort(rep)
        rep, known = rep[keep], known[keep]
        bucket = (digest[rep, 0] % np.uint64(self.buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
            who, which = np.unique(owner[rep[part]], return_inverse=True)
            raw = digest[rep[part]].view(np.uint8).reshape(len(part), -1)[:, -self.width :]
            steps = np.diff(which, prepend=0).astype(np.uint32)
            body = _packed(steps, place[rep[part]], known[part].astype(np.uint8))
            ids, rows = zip(*(self.docs[k] for k in who.tolist()), strict=True)
            yield int(bucket[part[0]]), False, np.uint32(len(part)).tobytes() + raw.tobytes() + body, ids, rows
        self.clear()


def _ranked(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of digests of one or two words each, and which neighbours in it are equal."""
    order = np.argsort(digest[:, 0], kind="stable") if digest.shape[1] == 1 else np.lexsort(tuple(digest.T))
    ranked = digest[order]
    return order, (ranked[1:] == ranked[:-1]).all(axis=1)


def _unpack(load: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(load, np.uint32, 1)[0])
    raw = np.zeros((n, -(-width // 8) * 8), np.uint8)
    raw[:, :width] = np.frombuffer(load, np.uint8, n * width, 4).reshape(n, width)
    body = zlib.decompress(load[4 + n * width :])
    which = np.cumsum(np.frombuffer(body, np.uint32, n), dtype=np.uint32)
    known = np.frombuffer(body, np.uint8, n, 8 * n).astype(bool)
    return raw.view(np.uint64).reshape(n, -1), known, which, np.frombuffer(body, np.uint32, n, 4 * n)


class _Mail:
    """Places of documents, gathered and packed by a bucket of documents."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.by: dict[int, list[tuple]] = {}

    def add(self, doc: tuple, places: bytes) -> None:
        self.by.setdefault(xxhash.xxh3_64_intdigest(repr(doc)) % self.buckets, []).append((*doc, places))
        self.size += len(places) + 32

    def add_runs(self, owner: np.ndarray, place: np.ndarray, docs: list[tuple]) -> None:
        """``owner`` ascends; ``docs`` are what it numbers."""
        if len(owner):
            begins = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            raw = np.ascontiguousarray(place, np.uint32).tobytes()
            ends = np.append(begins[1:], len(owner)) * 4
            for o, b, e in zip(owner[begins].tolist(), (begins * 4).tolist(), ends.tolist(), strict=True):
                self.add(docs[o], raw[b:e])

    def add_load(self, load: bytes, ids: list, rows: list) -> None:
        for doc, places in _opened(load, ids, rows):
            self.add(doc, places)

    def flush(self) -> Iterator[tuple]:
        for bucket, held in self.by.items():
            ids, rows, places = zip(*held, strict=True)
            counts = np.array([len(p) // 4 for p in places], np.uint32)
            yield bucket, True, zlib.compress(counts.tobytes() + b"".join(places), 1), ids, rows
        self.by, self.size = {}, 0


def _opened(load: bytes, ids: list, rows: list) -> Iterator[tuple]:
    """((id, row), places) of a packed load."""
    body, at = zlib.decompress(load), 4 * len(ids)
    for i, r, n in zip(ids, rows, np.frombuffer(body, np.uint32, len(ids)).tolist(), strict=True):
        yield (i, r), body[at : at + 4 * n]
        at += 4 * n


_SCHEMA = "bucket int, settled boolean, load binary, ids array<{0}>, rows array<long>"


def _batches(rows: Iterable[tuple], kind: pa.DataType, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most a few MB."""
    types, held, size = (pa.int32(), pa.bool_(), pa.binary(), pa.list_(kind), pa.list_(pa.int64())), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)],
            ["bucket", "settled", "load", "ids", "rows"],
        )

    for row in rows:
        held.append(row)
        size += len(row[2]) + 16 * len(row[3])
        if size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _repeated(packed: DataFrame, width: int, buckets: int, partitions: int, kind: str) -> DataFrame:
    """(id, row, load): the places of each document whose digest occurs twice."""
    id_type = packed.schema["ids"].dataType.elementType

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def settle(loads: list, mail: _Mail) -> None:
            parts = [_unpack(load, width) for load, _, _ in loads]
            digest, known = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order, same = _ranked(digest)
            hit = np.zeros(len(digest), bool)
            hit[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hit &= ~known
            sizes = [len(ids) for _, ids, _ in loads]
            shift = np.repeat(np.cumsum([0, *sizes[:-1]]), [len(p[2]) for p in parts])
            owner = np.concatenate([p[2] for p in parts]) + shift
            docs = [d for _, ids, rows in loads for d in zip(ids, rows, strict=True)]
            mail.add_runs(owner[hit], np.concatenate([p[3] for p in parts])[hit], docs)

        def results() -> Iterator[tuple]:
            held, now, mail = [], None, _Mail(buckets)
            for batch in batches:
                for bucket, settled, load, ids, rows in values(*batch.columns):
                    if settled:
                        mail.add_load(load, ids, rows)
                    else:
                        if bucket != now and held:
                            settle(held, mail)
                            held = []
                        now = bucket
                        held.append((load, ids, rows))
                    if mail.size >= _MAIL:
                        yield from mail.flush()
            if held:
                settle(held, mail)
            yield from mail.flush()

        yield from _batches(results(), to_arrow_type(id_type))

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = (to_arrow_type(id_type), pa.int64(), pa.binary())

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                cols = *zip(*held, strict=True), map(b"".join, held.values())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "row", "load"])

        held: dict = {}
        now = None
        for batch in batches:
            for bucket, _, load, ids, rows in values(*batch.columns):
                if bucket != now:
                    yield from done()
                    held, now = {}, bucket
                for doc, places in _opened(load, ids, rows):
                    held.setdefault(doc, []).append(places)
        yield from done()

    by = lambda df: df.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    mailed = by(packed).mapInArrow(match, _SCHEMA.format(kind))
    return by(mailed).mapInArrow(gather, f"id {kind}, row long, load binary")


def _with_places(source: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    """Documents with their places; both joins of a query deal the texts alike, so that is done once."""
    same = (F.col("s.row") == F.col("h.row")) & F.col("s.id").eqNullSafe(F.col("h.id"))
    return source.alias("s").join(hits.alias("h"), same, how).select("s.id", "s.row", "s.body", "h.load")


def _marks(load: bytes, n: int) -> np.ndarray:
    """Which of a document's ``n`` words are places."""
    out = np.zeros(n, bool)
    out[np.frombuffer(load, np.uint32)] = True
    return out


def repeated_windows(source: DataFrame, window: int) -> DataFrame:
    """(id, row, load) of ``source(id, row, body)``: where windows start that start elsewhere too.

    Buckets and partitions are as many as the text asks for, and at least as the cluster is set to.
    """
    kind, id_type = dict(source.dtypes)["id"], source.schema["id"].dataType
    size = source.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    partitions = max(shuffle_partitions(source.sparkSession), -(-size // PARTITION_BYTES))
    buckets = max(2 * partitions, -(-size // BUCKET_BYTES))
    period, _ = cover_for(window)

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def results() -> Iterator[tuple]:
            box = _Outbox(buckets, 6)
            for batch in batches:
                for i, r, body in values(*batch.columns):
                    at, digest = anchor_hashes((body or b"").split(), window)
                    if len(at):
                        box.put((i, r), at, digest[:, None])
                    if box.size >= _CHUNK:
                        yield from box.flush()
            yield from box.flush()

        yield from _batches(results(), to_arrow_type(id_type))

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        def results() -> Iterator[tuple]:
            box = _Outbox(buckets, 10)
            for batch in batches:
                for i, r, body, load in values(*batch.columns):
                    words = (body or b"").split()
                    n = len(words) - window + 1
                    if n < 1:
                        continue
                    text, starts = word_spans(words)
                    sums = np.concatenate(([0], np.cumsum(_marks(load, len(words)))))
                    at = np.flatnonzero(sums[np.arange(n) + period] > sums[:n])
                    ends = (starts[at + window] - 1).tolist()
                    got = [xxhash.xxh3_128_digest(text[b:e]) for b, e in zip(starts[at].tolist(), ends, strict=True)]
                    digest = np.frombuffer(b"".join(got), np.uint64).reshape(-1, 2)
                    for k in range(0, len(at), _CHUNK):
                        box.put((i, r), at[k : k + _CHUNK], digest[k : k + _CHUNK])
                        if box.size >= _CHUNK // 2:
                            yield from box.flush()
            yield from box.flush()

        yield from _batches(results(), to_arrow_type(id_type))

    hits = _repeated(source.mapInArrow(anchors, _SCHEMA.format(kind)), 6, buckets, partitions, kind)
    near = _with_places(source, hits, "inner")
    return _repeated(near.mapInArrow(windows, _SCHEMA.format(kind)), 10, buckets, partitions, kind)


def _strip(window: int):
    def run(bodies: pa.Array, loads: pa.Array) -> pa.Array:
        total, gone, kept = [], [], []
        for body, load in values(bodies, loads):
            words = (body or b"").split()
            n = len(words)
            if load:
                sums = np.concatenate((np.zeros(window, np.int64), np.cumsum(_marks(load, n))))
                stays = np.flatnonzero(sums[window:] == sums[:-window])
                words = [words[k] for k in stays.tolist()]
            total.append(n)
            gone.append(n - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays(
            [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
            ["n_words", "n_removed", "kept"],
        )

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id, words struct<n_words, n_removed, kept>), one row per row of ``df``.

    A word goes if a window of ``window`` words over it has a sequence that also starts anywhere else. Anchors
    are hashed only at cover positions modulo a period: two equal windows share an anchor at the same inner
    place, wherever they start. Windows over an anchor that occurs twice are then compared whole, by 80 bits
    of hash and the bucket; anchors alone decide nothing. Null texts have no words; texts shorter than a window keep all;
    rows that are equal in id and text are each other's copies; null ids are kept; an empty table gives none.
    """
    if window < 2:
        raise ValueError("window must be 2 words or more")
    text = F.col(text_col).cast("string")
    source = df.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), text.cast("binary").alias("body")
    )
    joined = _with_places(source, repeated_windows(source, window), "left")
    strip = F.arrow_udf(_strip(window), "struct<n_words:long,n_removed:long,kept:binary>")
    return joined.select("id", strip("body", "load").alias("words"))
