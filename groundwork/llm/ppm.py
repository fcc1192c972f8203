"""Language identification by prediction by partial matching over byte context trees."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

#: Bytes of the longest context.
ORDER = 4
#: The stretch of text, about three words, that a score speaks of.
STRETCH = 16
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_PIECE = 1 << 19
_PAD = b"\0" * ORDER


def has_letter(body: bytes) -> bool:
    """Whether a text has any letter, in any script."""
    return bool(_ASCII_LETTER.search(body)) or any(c.isalpha() for c in body.decode("utf-8", "replace"))


def _codes(raw: np.ndarray) -> np.ndarray:
    """For each byte after the first ORDER ones, it and the ORDER bytes before it as one number, the byte last."""
    wide, n = raw.astype(np.int64), len(raw) - ORDER
    out = wide[:n].copy()
    for k in range(1, ORDER + 1):
        out = out << 8 | wide[k : k + n]
    return out


def _grams(bodies: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of texts, and how often each occurs."""
    got = [
        np.unique(_codes(np.frombuffer((body[at - ORDER : at] if at else _PAD) + body[at : at + _PIECE], np.uint8)), return_counts=True)
        for body in bodies for at in range(0, len(body), _PIECE)
    ]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, where = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in got]).astype(float), len(codes)).astype(np.int64)


def training_counts(labelled: DataFrame, words: bool = False) -> DataFrame:
    """(label, gram, n) over ``labelled(label, body)``, or what ``words_alone`` leaves of it, summed before and after one shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for label, body in values(*batch.columns):
                by.setdefault(label, []).append(words_alone(body) if words else body)
            for label, bodies in by.items():
                codes, n = _grams(bodies)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["label", "gram", "n"])

    counted = labelled.mapInArrow(run, "label string, gram long, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen code lengths of every label's context tree, all contexts of up to ORDER bytes that its text holds.

    A byte is coded at the longest context that the label's text holds: with probability n/(t+d) if it followed
    there (n of t occurrences, d distinct successors), else by an escape of d/(t+d) and the next shorter context,
    in which the successors that the longer one excludes are left out; last by one of 256 equal chances. Trees are
    kept as two tables for each order: bits of a context with the byte that follows, and bits of its escape.
    """

    def __init__(self, labels: list[str], base: np.ndarray, grams: list[tuple], escapes: list[tuple]) -> None:
        self.labels, self.base, self.grams, self.escapes = labels, base, grams, escapes

    @classmethod
    def fit(cls, counts: pa.Table) -> Model:
        """From the columns label, gram (a code) and n (how often)."""
        named = counts["label"].combine_chunks().dictionary_encode()
        labels, place = np.unique(np.array(named.dictionary.to_pylist(), object), return_inverse=True)
        who, gram, n = place[named.indices.to_numpy()], counts["gram"].to_numpy(), counts["n"].to_numpy()
        size = len(labels)
        base = np.full((256, size), 1 / 256)
        mine = [who == k for k in range(size)]
        for k in range(size):
            seen = np.bincount(gram[mine[k]] & 255, n[mine[k]], 256)
            left = base[seen == 0, k].sum()
            escape = (seen > 0).sum() if left > 0 else 0
            base[:, k] = np.where(seen > 0, seen, escape * base[:, k] / max(left, 1e-300)) / max(seen.sum() + escape, 1)
        with np.errstate(divide="ignore"):
            below, codes_below = -np.log2(base), np.arange(256)
        base_bits, grams, escapes = below.astype(np.float32), [], []
        for order in range(1, ORDER + 1):
            code = gram & (1 << 8 * (order + 1)) - 1
            codes = np.unique(code)
            contexts, of = np.unique(codes >> 8, return_inverse=True)
            shorter = np.searchsorted(codes_below, codes & (1 << 8 * order) - 1)
            bits, away = np.empty((len(codes), size)), np.zeros((len(contexts), size))
            for k in range(size):
                seen = np.bincount(np.searchsorted(codes, code[mine[k]]), n[mine[k]], len(codes))
                total, kinds = np.bincount(of, seen, len(contexts)), np.bincount(of, seen > 0, len(contexts))
                rest = 1 - np.bincount(of, np.where(seen > 0, np.exp2(-below[shorter, k]), 0), len(contexts))
                kinds = np.where(rest > 1e-12, kinds, 0)
                known = total > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    away[:, k] = np.where(known & (kinds > 0), -np.log2(kinds / (total + kinds) / rest), np.where(known, 1000.0, 0.0))
                    straight = -np.log2(seen / (total + kinds)[of])
                bits[:, k] = np.where(seen > 0, straight, away[of, k] + below[shorter, k])
            grams.append((codes, bits.astype(np.float32)))
            escapes.append((contexts, away.astype(np.float32)))
            below, codes_below = bits, codes
        return cls([str(x) for x in labels], base_bits, grams, escapes)

    def ready(self) -> list[tuple]:
        """For each order, hash indexes of both tables, as a worker builds them."""
        import pandas as pd

        return [(pd.Index(g[0]), g[1], pd.Index(e[0]), e[1]) for g, e in zip(self.grams, self.escapes, strict=True)]

    def costs(self, codes: np.ndarray, tables: list[tuple]) -> np.ndarray:
        """(bytes, labels): what each byte costs after its context."""
        out = np.zeros((len(codes), len(self.labels)), np.float32)
        rest = np.arange(len(codes))
        for order in range(ORDER, 0, -1):
            grams, bits, contexts, away = tables[order - 1]
            code = codes[rest] & (1 << 8 * (order + 1)) - 1
            at = grams.get_indexer(code)
            hit = at >= 0
            out[rest[hit]] += bits[at[hit]]
            rest, code = rest[~hit], code[~hit]
            at = contexts.get_indexer(code >> 8)
            known = at >= 0
            out[rest[known]] += away[at[known]]
        out[rest] += self.base[codes[rest] & 255]
        return out

    def lengths(self, bodies: list[bytes], tables: list[tuple]) -> np.ndarray:
        """Bits of each text under each label, over every byte."""
        out = np.zeros((len(bodies), len(self.labels)))
        for owner, begins, ends, blob in _pieces(bodies):
            cost = self.costs(_codes(np.frombuffer(blob, np.uint8)), tables)
            cost = np.concatenate((cost, np.zeros((1, cost.shape[1]), cost.dtype)))
            np.add.at(out, owner, np.add.reduceat(cost, np.stack((begins, ends), axis=1).ravel(), axis=0, dtype=np.float64)[::2])
        return out


def _pieces(bodies: list[bytes]) -> Iterator[tuple]:
    """(text numbers, begins, ends, blob) of pieces of bounded size; long texts are cut, none is left out."""
    parts, owner, begins, ends, size = [], [], [], [], 0
    for k, body in enumerate(bodies):
        for at in range(0, len(body), _PIECE):
            part = body[at : at + _PIECE]
            parts += [body[at - ORDER : at] if at else _PAD, part]
            owner.append(k)
            begins.append(size)
            ends.append(size + len(part))
            size += len(part) + ORDER
            if size >= _PIECE:
                yield np.array(owner), np.array(begins), np.array(ends), b"".join(parts)
                parts, owner, begins, ends, size = [], [], [], [], 0
    if owner:
        yield np.array(owner), np.array(begins), np.array(ends), b"".join(parts)


def sample(df: DataFrame, label_col: str, text_col: str, docs_per_label: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(label, text): about ``docs_per_label`` distinct texts of each label, whole, chosen by a hash of the text alone.

    However the table is dealt the same texts are taken. With ``parts``, a sample is at most that share of a label's
    texts and its parts don't overlap. Null labels and texts don't count.
    """
    label, text = F.col(label_col).cast("string"), F.col(text_col).cast("string")
    rows = df.where(label.isNotNull() & text.isNotNull()).select(label.alias("label"), text.alias("text"), F.xxhash64(text).alias("h"))
    share = {r[0]: min(1.0 / parts, docs_per_label / r[1]) for r in rows.groupBy("label").agg(F.approx_count_distinct("h", 0.02)).collect()}
    if not share:
        return rows.select("label", "text").where("false")
    size = F.coalesce(*[F.when(F.col("label") == k, F.lit(s)) for k, s in share.items()])
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    return rows.where((place >= size * part) & (place < size * (part + 1))).dropDuplicates(["label", "h"]).select("label", "text")


def fit(df: DataFrame, label_col: str, text_col: str, docs_per_label: int = 600, words: bool = False, parts: int = 1) -> Model:
    """A model from a ``sample`` of ``df``'s labelled rows; with ``words``, of what ``words_alone`` leaves of the texts.

    ``docs_per_label`` is the only bound; counts are summed on the cluster, and no context of theirs is left out.
    """
    taken = sample(df, label_col, text_col, docs_per_label, parts=parts).select("label", F.col("text").cast("binary").alias("body"))
    return Model.fit(training_counts(taken, words).toArrow())


_READY: dict = {}
_FIELDS = ("label", "score", "bits", "bytes")


def _judged(ppm: Model, raw: Iterable[bytes | None]) -> list[pa.Array]:
    """label, score, bits and bytes of texts."""
    if _READY.get("of") is not ppm:
        _READY.update(of=ppm, tables=ppm.ready())
    names, scores, lengths, sizes = [], [], [], []

    def some(bodies: list[bytes]) -> None:
        known = [bool(ppm.labels) and has_letter(b) for b in bodies]
        size = np.array([len(b) for b in bodies], np.int64)
        best, score, bits = np.zeros(len(bodies), int), np.zeros(len(bodies)), np.zeros(len(bodies))
        if any(known):
            got = ppm.lengths([b if k else b"" for b, k in zip(bodies, known, strict=True)], _READY["tables"])
            best, bits = got.argmin(1), got.min(1)
            ahead = (bits[:, None] - got) * (np.minimum(size, STRETCH) / np.maximum(size, 1))[:, None]
            score = np.where(known, 1 / np.exp2(np.maximum(ahead, -1000)).sum(1), 0)
        names.extend(ppm.labels[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known, strict=True))
        scores.append(score)
        lengths.append(bits)
        sizes.append(size)

    held: list[bytes] = []
    total = 0
    for body in raw:
        held.append(body or b"")
        total += len(held[-1])
        if total >= _PIECE:
            some(held)
            held, total = [], 0
    some(held)
    return [pa.array(names, pa.string()), *(pa.array(np.concatenate(x)) for x in (scores, lengths, sizes))]


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, score, bits, bytes), one row per row of ``df``, repeated rows included.

    Every byte of every text is coded under every label. ``label`` is the one with the least bits, ties to the
    first by name, ``und`` where the text is null or has no letters or nothing was learned; ``bits`` is its code
    length and ``score`` its share of the labels' probabilities for an average stretch of STRETCH bytes (of the whole
    text, if shorter), so that it tells how clear a text is and not how long; 0 for ``und``. Texts of any length are
    coded whole, in pieces. Only id and text are read; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(shared.value, values(batch.column(1)))], ["id", *_FIELDS])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    return source.mapInArrow(run, f"id {kind}, label string, score double, bits double, bytes long")


_WITH_DIGIT = re.compile(rb"(?<!\S)[^\s0-9]*[0-9]\S*")


def words_alone(body: bytes | None) -> bytes | None:
    """Lower-cased text without words that hold digits, of which keys and numbers consist; the text if that leaves no letter."""
    left = b" ".join(_WITH_DIGIT.sub(b"", body or b"").split()).decode("utf-8", "replace").lower().encode()
    return left if has_letter(left) else body


def with_language(df: DataFrame, model: Model, text_col: str = "text", name: str = "language", words: bool = False) -> DataFrame:
    """``df`` with a struct column of what ``predict`` gives; all other columns pass through.

    With ``words``, it speaks of what ``words_alone`` leaves of the text.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(bodies: pa.Array) -> pa.Array:
        raw = values(bodies)
        return pa.StructArray.from_arrays(_judged(shared.value, map(words_alone, raw) if words else raw), list(_FIELDS))

    # As nondeterministic it is evaluated once, and a filter on its result isn't pushed below it.
    judge = F.arrow_udf(run, "struct<label:string,score:double,bits:double,bytes:long>").asNondeterministic()
    return df.withColumn(name, judge(F.col(text_col).cast("string").cast("binary")))
