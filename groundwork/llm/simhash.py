"""SimHash near-duplicates: meet-in-the-middle ball hashing over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_and_bytes, let_go, shuffle_partitions, values, written
from .components import connected_components

BITS = 64
_STEP = 1 << 16


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many rows of an (n, words) uint64 array have each bit set."""
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    out = np.zeros(raw.shape[1] * 8, np.int64)
    for at in range(0, len(raw), 255):  # sums of 255 bits fit in a byte, which keeps the additions wide
        out += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return out


def fingerprint(body: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the XXH64 of all word shingles; bit set if set in over half of them.

    A-Z are lower-cased; words are runs of anything but space and 0x09-0x0D. Fewer words than a shingle:
    the whole sequence is the one shingle. No words, or null: 0.
    """
    words = body.lower().split() if body else []
    if not words:
        return 0
    n, hashed = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return hashed(b" ".join(words), seed)
    ones = np.zeros(BITS, np.int64)
    total = n - shingle + 1
    for at in range(0, total, _STEP):  # very long texts stay within bounded memory
        part = words[at : min(at + _STEP, total) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False)
        ones += bit_sums(np.array([hashed(b" ".join(g), seed) for g in grams], np.uint64)[:, None])
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per input row, the fingerprint as a signed long. Other columns don't matter."""
    source = id_and_bytes(df, id_col, text_col)
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b, shingle) for b in values(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["id", "fp"])

    return source.mapInArrow(run, f"id {kind}, fp long")


def _masks(half: int) -> list[int]:
    found = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in found]


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each member of a run of one variant to the run's first member; rows come sorted."""
    last, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.empty(len(variant), bool)
        new[0] = variant[0] != last
        new[1:] = variant[1:] != variant[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(variant)), -1))
        heads = np.where(first >= 0, fp[np.maximum(first, 0)], head if head is not None else 0)
        last, head = variant[-1], heads[-1]
        yield pa.RecordBatch.from_arrays([pa.array(fp[~new]), pa.array(heads[~new])], ["u", "v"])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v) edges over distinct fingerprints that connect all those at ``radius`` or fewer bits.

    Every fingerprint emits all variants within half the radius; two fingerprints within the radius share
    one. All that share a variant are within the radius of each other, so a star to the least of them loses
    no connection, and a group is never larger than one ball. Verification of the bits is kept as a filter.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be an even number of bits, 0 or more")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius // 2)])
    variants = fps.select(F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"), "fp")
    dealt = variants.repartition(shuffle_partitions(fps.sparkSession), "variant").sortWithinPartitions("variant", "fp")
    edges = dealt.mapInArrow(_stars, "u long, v long").distinct()
    return edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component): each row's fingerprint and the least id reachable over links of ``radius`` bits.

    Copies share a fingerprint and are folded to one vertex before anything is linked, so the size of a group
    of copies doesn't matter. Null or blank texts have fingerprint 0 and are linked like any other; null ids
    are kept and never become a component's id unless it has no other; repeated rows stay rows.
    """
    docs = checkpointed(fingerprints(df, id_col, text_col, shingle))
    vertices = docs.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(vertices.select("fp"), radius))
    rooted = vertices.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return docs.join(rooted.select("fp", "root").join(named, "root"), "fp").select("id", "fp", "component")


#: Bands of the candidate search, minima in each, and the most members of a band's key that are compared as one unit.
BANDS, ROWS, BLOCK = 20, 4, 256
_FACTORS, _SHIFTS = np.random.default_rng(42).integers(1, 1 << 63, (2, 1, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word shingles; a shorter sequence is one shingle, no words are none."""
    total = max(1, len(words) - shingle + 1) if words else 0
    parts = [np.zeros(0, np.uint32)]
    for at in range(0, total, _STEP):
        part = words[at : min(at + _STEP, total) + shingle - 1]
        grams = zip(*(part[k:] for k in range(min(shingle, len(part)))), strict=False)
        parts.append(np.fromiter((xxhash.xxh32_intdigest(b" ".join(g)) for g in grams), np.uint32))
    return np.unique(np.concatenate(parts))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of a shingle set: two sets agree in a band with the ROWS-th power of their Jaccard similarity."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(np.uint64)[:, None]
        least = np.minimum(least, ((part * _FACTORS + _SHIFTS) >> np.uint64(32)).min(0))
    rows = least.astype(np.uint32).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _keyed(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, row, digest, fp, keys): a hash of the text as it stands, the digest of its words, their fingerprint (null: no words) and band keys."""
    source = id_and_bytes(df, id_col, text_col).withColumn("row", F.xxhash64("body"))
    kind = dict(source.dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, fps, keys = [], [], []
            for body in values(batch.column(1)):  # one text's words at a time
                words = (body or b"").lower().split()
                digests.append(_digest(words))
                fps.append(fingerprint(body, shingle) if words else None)
                keys.append(band_keys(shingle_set(words, shingle)))
            fp = pa.array(fps, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), fp, pa.array(keys, pa.list_(pa.int64()))], ["id", "row", "digest", "fp", "keys"]
            )

    return source.mapInArrow(run, f"id {kind}, row long, digest binary, fp long, keys array<long>")


def _with_balls(vertices: DataFrame, radius: int) -> DataFrame:
    """``vertices(fp, keys)`` with a key ahead of the others that names the star component of the fingerprint's ball."""
    fps = vertices.where("fp is not null").select("fp").distinct()
    roots = connected_components(links(fps, radius)).withColumnRenamed("u", "fp")
    ball = F.array(F.xxhash64(F.lit("ball"), F.coalesce("root", "fp")))
    return vertices.join(roots, "fp", "left").withColumn("keys", F.when(F.col("fp").isNull(), F.col("keys")).otherwise(F.concat(ball, "keys"))).drop("root")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(digest, hashes): the shingle set of each ``body``, four bytes a shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sets = [], []
            for body in values(batch.column(0)):
                words = (body or b"").lower().split()
                digests.append(_digest(words))
                sets.append(shingle_set(words, shingle).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "hashes"])

    return texts.select("body").mapInArrow(run, "digest binary, hashes binary").dropDuplicates(["digest"])


def _blocks(most: int, named: bool = False):
    """(unit, key, members) of the (key, digest) rows that share a key; rows come sorted by key.

    Keys of more than ``most`` members, and those at either end of the partition, which may go on in another one, are
    cut into several units, which then have the key; others have null, and one member makes no unit. A unit is named by
    its members, so that bands which bring the same texts together make one unit. With ``named`` all keys are as if cut.
    """

    def unit(key: int | None, held: list[bytes], cut: bool) -> list[tuple]:
        if not held or (len(held) < 2 and not cut):
            return []
        members = sorted(held)
        return [(xxhash.xxh3_64_intdigest(b"".join(members), int(cut)) - (1 << 63), key if cut else None, members)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, cut = None, [], True  # the first key may have begun in another partition
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            key, digest = batch.column(0).to_numpy(), batch.column(1)
            begins = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            ends = np.append(begins[1:], len(key))
            shared = (ends - begins > 1) | (begins == 0) | (ends == len(key)) | named
            for b, e in zip(begins[shared].tolist(), ends[shared].tolist(), strict=True):
                if now is None or int(key[b]) != now:
                    out += unit(now, held, cut)
                    now, held, cut = int(key[b]), [], named or now is None
                for d in digest.slice(b, e - b).to_pylist():
                    if len(held) == most:
                        cut = True
                        out += unit(now, held, cut)
                        held = []
                    held.append(d)
            yield _unit_rows(out)
        yield _unit_rows(unit(now, held, True))

    return run


def _unit_rows(rows: list[tuple]) -> pa.RecordBatch:
    units, keys, members = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(units, pa.int64()), pa.array(keys, pa.int64()), pa.array(members, pa.list_(pa.binary()))], ["unit", "key", "members"]
    )


def _shared_counts(sets: list[np.ndarray], limit: int = 1 << 22) -> np.ndarray:
    """How many elements every two of some sorted sets have in common; looked at in ranges of about ``limit`` elements."""
    out = np.zeros((len(sets), len(sets)), np.float64)
    edges = np.linspace(0, 1 << 32, max(1, -(-sum(map(len, sets)) // limit)) + 1)
    for low, high in zip(edges, edges[1:], strict=False):
        parts = [s[slice(*np.searchsorted(s, (low, high)))] for s in sets] if len(edges) > 2 else sets
        values_, where = np.unique(np.concatenate(parts), return_inverse=True)
        owner = np.repeat(np.arange(len(parts)), [len(s) for s in parts])
        often = np.bincount(where, minlength=len(values_)) > 1
        used, total = often[where], int(often.sum())
        column, owner = (np.cumsum(often) - 1)[where[used]], owner[used]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for at in range(0, total, 8192):
            b, e = np.searchsorted(column, (at, at + 8192))
            part = np.zeros((len(sets), min(8192, total - at)), np.float32)
            part[owner[b:e], column[b:e] - at] = 1
            out += part @ part.T
    return out


def _alike_in(sets: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(edges, heads): pairs of ``similarity`` or more that connect all such pairs; of each component the set with the most alike ones, and how many.

    Every two sets are compared whole. Edges make trees around the heads; a set that is like no other is its own head.
    """
    size = np.array([len(s) for s in sets])
    both = _shared_counts(sets)
    alike = (both > 0) & (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9)
    np.fill_diagonal(alike, False)
    degree = alike.sum(1)
    seen, edges, heads = np.zeros(len(sets), bool), [], []
    for start in np.argsort(-degree, kind="stable").tolist():
        if seen[start]:
            continue
        heads.append((start, int(degree[start])))
        seen[start], queue = True, [start]
        for at in queue:
            fresh = np.flatnonzero(alike[at] & ~seen)
            seen[fresh] = True
            fresh = fresh[np.argsort(-degree[fresh], kind="stable")].tolist()
            edges += [(at, k) for k in fresh]
            queue += fresh
    return edges, heads


def _verified(similarity: float):
    """(unit, u, v, n) of (unit, cut, digest, hashes) rows, which come sorted by unit: edges with null n, and the heads of cut units with their number of links."""

    def told(unit: int, cut: bool, held: list[tuple]) -> list[tuple]:
        edges, heads = _alike_in([np.frombuffer(h, np.uint32) for _, h in held], similarity)
        rows = [(unit, held[a][0], held[b][0], None) for a, b in edges]
        return rows + ([(unit, held[k][0], held[k][0], n) for k, n in heads] if cut else [])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["unit", "u", "v", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cut, held = None, False, []
        for part in batches:
            for unit, of_cut, digest, hashes in values(*part.columns):
                if unit != now:
                    yield batch(told(now, cut, held) if held else [])
                    now, cut, held = unit, of_cut, []
                held.append((digest, hashes))
        yield batch(told(now, cut, held) if held else [])

    return run


#: Heads of a key, those with the most links, that all other heads of the key are compared with.
LEADERS = 128


def _led(units: DataFrame, heads: DataFrame) -> DataFrame:
    """``units(unit, key, members)`` of a key's heads, each with the key's leaders added; ``heads(key, digest, n)``."""
    order = Window.partitionBy("key").orderBy(F.col("n").desc(), "digest")
    leading = heads.where("n > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)
    leaders = leading.groupBy("key").agg(F.collect_list("digest").alias("leaders"))
    both = units.join(leaders, "key", "left").withColumn("members", F.array_union("members", F.coalesce("leaders", F.array().cast("array<binary>"))))
    return both.select(F.xxhash64(F.lit("led"), "unit", "key").alias("unit"), F.lit(None).cast("long").alias("key"), "members")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows(key, digest)`` with the root of each digest."""
    return rows.join(roots.withColumnRenamed("u", "digest"), "digest", "left").select("key", "digest", F.coalesce("root", "digest").alias("root"))


def _several_roots(rooted: DataFrame) -> DataFrame:
    """(key): keys whose members aren't all connected."""
    return rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")


#: A member's next cut keys, in the order of its bands, that each of its cut keys is paired with.
STEPS = 2


def _finer_keys(vertices: DataFrame, cut: DataFrame) -> DataFrame:
    """(key, digest): for members of the cut keys, each of their cut keys paired with the next ones."""
    held = cut.select("key", F.explode("members").alias("digest")).groupBy("digest").agg(F.collect_set("key").alias("cut"))
    own = held.join(vertices.select("digest", "keys"), "digest").select("digest", F.filter("keys", lambda k: F.array_contains("cut", k)).alias("keys"))
    pairs = F.flatten(F.transform("keys", lambda a, i: F.transform(F.slice("keys", i + 2, F.lit(STEPS)), lambda b: F.xxhash64(a, b))))
    return own.select(F.explode(pairs).alias("key"), "digest").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """(root, id, row): what names each row's group, and a hash of its text."""
    spark = df.sparkSession
    docs = checkpointed(_keyed(df, id_col, text_col, shingle))
    real = docs.where(F.col("id").isNotNull())
    vertices = real.groupBy("digest").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = _with_balls(vertices, radius)

    def units_of(rows: DataFrame, named: bool = False) -> DataFrame:
        # Ranges of (key, hash) spread a key that many texts share over as many tasks as it needs.
        order = ["key", F.xxhash64("key", "digest")]
        dealt = rows.select("key", "digest").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
        return dealt.mapInArrow(_blocks(BLOCK, named), "unit long, key long, members array<binary>")

    def members_of(units: DataFrame) -> DataFrame:
        whole = units.groupBy("unit").agg(F.bool_or(F.col("key").isNotNull()).alias("cut"), F.first("members").alias("members"))
        return whole.where("cut or size(members) > 1").select("unit", "cut", F.explode("members").alias("digest"))

    units = checkpointed(units_of(keyed.select(F.explode("keys").alias("key"), "digest")))
    members = members_of(units)
    # A table, so that its true size says whether it is broadcast or the texts are shuffled.
    wanted = written(vertices.join(members, "digest", "left_semi").select(F.col("row").alias("__row")).distinct())
    texts = df.select(F.col(text_col).cast("string").cast("binary").alias("body")).withColumn("__row", F.xxhash64("body"))
    sets = checkpointed(_shingle_sets(texts.join(wanted, "__row", "left_semi"), shingle))

    def verified(rows: DataFrame) -> DataFrame:
        full = rows.join(sets, "digest").select("unit", "cut", "digest", "hashes")
        dealt = full.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "digest")
        return checkpointed(dealt.mapInArrow(_verified(similarity), "unit long, u binary, v binary, n long"))

    def edges(found: DataFrame) -> DataFrame:
        return found.where("n is null").select("u", "v")

    let_go(spark)
    found = verified(members)
    # Units of a cut key hold only some of its pairs: the heads of its units meet one another and its leaders.
    cut = units.where("key is not null")
    heads = found.where("n is not null").select("unit", F.col("u").alias("digest"), "n").join(cut.select("unit", "key").distinct(), "unit")
    heads = heads.groupBy("key", "digest").agg(F.max("n").alias("n"))
    several = heads.groupBy("key").agg(F.count("*").alias("heads")).where("heads > 1").select("key")
    heads = checkpointed(heads.join(several, "key", "left_semi"))
    links = edges(found).union(edges(verified(members_of(_led(units_of(heads, named=True), heads)))))
    roots = connected_components(links)
    # Keys whose members still aren't one group are made finer.
    open_keys = _several_roots(_rooted(cut.select("key", F.explode("members").alias("digest")), roots))
    left = checkpointed(cut.join(open_keys, "key", "left_semi"))
    if not left.isEmpty():
        finer = checkpointed(_rooted(_finer_keys(keyed, left), roots))
        asked = finer.join(_several_roots(finer), "key", "left_semi")
        roots = connected_components(links.union(edges(verified(members_of(units_of(asked))))))
    named = docs.select("id", "row", "digest").join(roots.withColumnRenamed("u", "digest"), "digest", "left")
    return named.select(F.coalesce("root", "digest").alias("root"), "id", "row")


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2
) -> DataFrame:
    """(id, component), one row per row of ``df``: groups linked by ``similarity`` or more on sets of word shingles.

    Candidates are, first, texts whose 64-bit fingerprints balls of ``radius`` bits connect: ball hashing and star
    components as in ``near_duplicates``, a component being one key. At 0.8 fingerprints lie some ten bits apart, too
    far for a ball, so texts outside each other's balls also meet where they share one of BANDS keys, each of ROWS minima over hashes of the shingle set: whether a pair meets in one depends on its
    similarity alone, not on where or how the copy was changed, and a pair at 0.8 misses all bands once in 37,000
    times. All members of a key are compared with each other on the whole sets, so links don't depend on which member
    has the least id, and none is below ``similarity``. A key of more than BLOCK members is cut into units, dealt by
    hash and so otherwise for every key, that are compared whole; then the heads of a key's units are compared in units with its
    LEADERS heads of the most links; members of keys that still aren't one group meet those with which they share two cut keys of
    neighbouring bands. So no key's pairs are multiplied out; tests hold what such groups lose against brute force. Equal texts, A-Z and white space aside, are one vertex, all
    texts without words another. Null ids are kept and link nothing, repeated rows stay, and rows of one id but
    different texts are told apart; an empty table gives none.
    """
    named = checkpointed(_grouped(df, id_col, text_col, shingle, similarity, radius))
    return named.join(named.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: of every group of ``near_copies`` one row stays, that of the least id.

    Rows are told apart by id and text: of a group's rows of the least id the one with the least hash of its text
    stays, once if it stands there more than once; another text under the same id that is no near copy stays too.
    Rows of null id stay. All columns pass through, whatever their names; an empty table gives an empty one.
    """
    columns = df.columns
    groups = checkpointed(_grouped(df, id_col, text_col, **options).where("id is not null").groupBy("root", "id", "row").agg(F.count("*").alias("n")))
    best = groups.groupBy("root").agg(F.min(F.struct("id", "row")).alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    told = written(groups.join(best, "root").select("id", "row", "n", (F.struct("id", "row") == F.col("best")).alias("stays")).where("not stays or n > 1"))
    let_go(df.sparkSession)
    renamed = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    key, text = f"c{columns.index(id_col)}", F.col(f"c{columns.index(text_col)}").cast("string").cast("binary")
    tagged = renamed.withColumn("row", F.xxhash64(text))
    mine = (F.col(key) == F.col("id")) & (F.col("row") == F.col("its"))
    its = told.select("id", F.col("row").alias("its"), "stays")
    single = tagged.join(its.drop("stays"), mine, "left_anti")
    several = tagged.join(its.where("stays"), mine, "left_semi").dropDuplicates([key, "row"])
    left = single.unionByName(several)
    return left.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
