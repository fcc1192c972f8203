"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH and exact edit verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values

#: ASCII punctuation and control bytes part words, A-Z are lower-cased, all other bytes stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64(63)
_PIECE = 1 << 20


def words_of(body: bytes | None) -> list[bytes]:
    """Words of a text: lower-cased runs of ASCII letters, digits and any non-ASCII characters."""
    return (body or b"").translate(_FOLD).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            row = np.full(n, base, np.uint64)
            row[:1] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _piece_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, where it starts) of folded bytes that end no word in the middle; never 0, which is the blank."""
    raw = np.frombuffer(folded, np.uint8)
    inside = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)], dtype=np.uint64)))
    return _mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64)) | np.uint64(1), begins


def hashes_of(bodies: list[bytes | None]) -> list[np.ndarray]:
    """The hashes of the words of each text; texts are taken together in pieces of about 1 MB, longer words whole."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def done() -> None:
        nonlocal held, size
        if held:
            found, begins = _piece_hashes(b" ".join(held))
            cuts = np.searchsorted(begins, np.cumsum([len(b) + 1 for b in held])[:-1])
            out.extend(np.split(found, cuts))
        held, size = [], 0

    for body in bodies:
        folded = (body or b"").translate(_FOLD)
        if len(folded) > _PIECE:
            done()
            parts, at = [], 0
            while at < len(folded):
                end = folded.find(b" ", at + _PIECE)
                end = len(folded) if end < 0 else end
                parts.append(_piece_hashes(folded[at:end])[0])
                at = end
            out.append(np.concatenate(parts))
            continue
        held.append(folded)
        size += len(folded)
        if size >= _PIECE:
            done()
    done()
    return out


class Sampler:
    """CGK walks over words and the places of the walks that are sampled.

    A walk writes the word it stands on and moves on by one bit, which the step's own hash gives to that word: two
    walks over equal words move together, an unequal pair parts them, and they meet again by chance. So texts that
    few edits part agree in most of what their walks write (edit distance has become Hamming distance), and a few
    sampled places are all equal often enough. Places are drawn one from each of as many equal stretches of the
    first ``span`` steps, so that they stand on different words; the first is always the word a window starts at.
    """

    def __init__(self, walks: int, samples: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed)
        self.walks, self.samples = walks, samples
        self.turns = draw.integers(0, 1 << 64, (walks, 64), np.uint64) | np.uint64(1)
        self.layouts = {}
        for span, places in ((1, 1), (2, 2), (3, 3), (4, 3), (8, 5), (10, 6), (16, 7)):
            edges = np.linspace(0, span, places + 1)
            unit = draw.random((walks, samples, places))
            at = (edges[:-1] + unit * np.diff(edges)).astype(int)
            at[:, :, 0] = 0
            self.layouts[span] = at

    @staticmethod
    def span_for(n: int) -> int:
        """How many steps are sampled from an item of ``n`` words: so few that the walk stays within it."""
        return 16 if n >= 24 else 10 if n >= 12 else 8 if n >= 8 else 3 if n >= 6 else 2 if n == 5 else n

    def keys(self, text: np.ndarray, starts: np.ndarray, spans: Iterable[int]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(span, walk, sample, 64-bit key of each window's sampled places, how many words those stand on) of windows from ``starts``."""
        spans = sorted(spans)
        padded = np.concatenate((text, np.zeros(spans[-1] + 1 if spans else 1, np.uint64)))
        for walk in range(self.walks):
            now = starts.copy()
            asked: dict[int, list] = {}
            got, last, words = {}, {}, {}
            for span in spans:
                for s in range(self.samples):
                    got[span, s] = np.full(len(starts), 1 + 64 * span + 8 * walk + s, np.uint64)
                    last[span, s], words[span, s] = starts, np.ones(len(starts), np.int8)
                    for p in self.layouts[span][walk, s].tolist():
                        asked.setdefault(p, []).append((span, s))
            for step in range(max(asked, default=-1) + 1):
                word = padded[now]
                for k in asked.get(step, ()):
                    got[k] = _mixed(got[k] ^ word)
                    words[k] += now != last[k]
                    last[k] = now
                now = now + ((word * self.turns[walk, step]) >> _TOP).astype(np.int64)
            for (span, s), key in got.items():
                yield span, walk, s, key, words[span, s]


class Items:
    """A block of benchmark items and the keys of their embeddings, sorted: what a task needs to search documents.

    An item of n words may differ by ``k = floor((1 - similarity) * n)`` word edits. It is embedded from ``anchors``
    of its words on, so that an edit at its head doesn't spoil all of its samples.
    """

    def __init__(self, ids: list, words: list[np.ndarray], similarity: float, sampler: Sampler, anchors: int) -> None:
        self.ids, self.words, self.sampler = ids, words, sampler
        self.bags = [np.unique(w) for w in words]
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for w in words]
        by_span: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            span = sampler.span_for(len(w))
            last = max(0, len(w) - max(span - 4, span // 2 + 1))
            for at in np.unique(np.linspace(0, last, anchors).astype(int)).tolist():
                by_span.setdefault(span, []).append((k, at))
        offsets = np.cumsum([0, *map(len, words)])
        whole = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.index: dict[tuple[int, int, int], tuple] = {}
        heads = []
        for span, rows in by_span.items():
            item, at = np.array(rows).T
            heads.append(whole[offsets[item] + at])
            made = list(sampler.keys(whole, offsets[item] + at, [span]))
            # A walk that hardly moved says little and is passed over, unless an item has no better one that is sure to stay within it.
            inner = at + span <= np.diff(offsets)[item]
            most = np.zeros(len(words), np.int64)
            for *_, stood in made:
                np.maximum.at(most, item[inner], stood[inner])
            wanted = min(4, span, max(2, span // 2))
            least = np.where(inner, np.minimum(most[item], wanted), wanted)
            for _, walk, s, key, stood in made:
                order = np.argsort(key, kind="stable")
                order = order[stood[order] >= least[order]]
                self.index[span, walk, s] = key[order], item[order], at[order], _bitmap(key[order])
        self.heads = _bitmap(np.concatenate([*heads, np.zeros(0, np.uint64)]))

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """(item, start) of all windows of ``text`` that agree with an item in all places of a sample, each once."""
        starts = np.flatnonzero(_maybe(self.heads, text))
        found = [np.zeros((0, 2), np.int64)]
        for span, walk, s, key, _ in self.sampler.keys(text, starts, {k[0] for k in self.index}):
            keys, item, at, bits = self.index[span, walk, s]
            likely = np.flatnonzero(_maybe(bits, key))
            first, last = np.searchsorted(keys, key[likely]), np.searchsorted(keys, key[likely], "right")
            n = last - first
            which = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(np.stack((item[which], np.repeat(starts[likely], n) - at[which]), axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, start word, end word) of all copies found, the best of overlapping ones.

        A candidate is verified by exact edit distance over the window and as many words around it as the item may
        lose or gain; before that, it must hold enough of the item's words to be a copy at all.
        """
        offsets = np.cumsum([0, *map(len, texts)])
        whole = np.concatenate([*texts, np.zeros(0, np.uint64)])
        pairs = self.candidates(whole)
        if not len(pairs):
            return
        middle = pairs[:, 1] + np.array([len(w) for w in self.words])[pairs[:, 0]] // 2
        owner = np.clip(np.searchsorted(offsets, np.clip(middle, 0, max(0, len(whole) - 1)), "right") - 1, 0, len(texts) - 1)
        seen: dict[tuple[int, int], list[int]] = {}
        for (item, start), doc in zip(pairs.tolist(), owner.tolist(), strict=True):
            for d in (doc - 1, doc, doc + 1):  # a window may reach over the end of its document
                if 0 <= d < len(texts) and start < offsets[d + 1] and start + len(self.words[item]) > offsets[d]:
                    seen.setdefault((d, item), []).append(start - int(offsets[d]))
        for (doc, item), starts in sorted(seen.items()):
            yield from ((doc, item, *hit) for hit in self._copies(texts[doc], item, sorted(starts)))

    def _copies(self, text: np.ndarray, item: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        words, k = self.words[item], self.edits[item]
        n, best, done = len(words), set(), None
        for start in starts:
            if done is not None and start <= done:
                continue
            done = start + k
            low = max(0, start - k)
            window = text[low : done + n + k]
            if np.isin(window, self.bags[item]).sum() >= n - k:
                got = best_match(words, window)
                if got and got[0] <= k:
                    best.add((got[0], low + got[1], low + got[2]))
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(best):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                yield edits, a, b


def _bitmap(keys: np.ndarray) -> np.ndarray:
    """A table of flags by the top bits of a hash: about 32 for each key, 64 MB at most."""
    bits = np.zeros(1 << min(26, max(12, int(32 * len(keys)).bit_length())), bool)
    bits[_slots(bits, keys)] = True
    return bits


def _slots(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - (len(bits).bit_length() - 1))).astype(np.int64)


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return bits[_slots(bits, keys)]


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """(edits, start, end) of the run of ``text`` nearest to ``item`` in word edits; ties to the first end."""
    if not len(text):
        return None
    n = len(item)
    cost, origin = np.arange(n + 1), np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    best = (n, 0, 0)
    for j, word in enumerate(text):
        differs = (item != word).astype(np.int64)
        move, skip = cost[:-1] + differs, cost[1:] + 1
        now, src = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        now[0], src[0] = 0, j + 1
        now[1:] = np.minimum(move, skip)
        src[1:] = np.where(move <= skip, origin[:-1], origin[1:])
        lag = np.minimum.accumulate(now - steps)
        at = np.maximum.accumulate(np.where(now - steps == lag, steps, 0))
        cost, origin = lag + steps, src[at]
        if cost[-1] < best[0]:
            best = (int(cost[-1]), int(origin[-1]), j + 1)
    return best


def _loaded(blocks: list[Broadcast]) -> Iterator[Items]:
    """The blocks one after another; where there are several, each is let go before the next is read from the executor's disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    **how: int,
) -> DataFrame:
    """(id, item, edits, item_words, start_word, end_word): near copies of benchmark items in ``df``.

    A copy is a run of words within ``floor((1 - similarity) * n)`` word edits of an item of n words, case and
    ASCII punctuation aside; of overlapping runs for one item the nearest is given. Candidates come from equal
    samples of CGK walks alone (``walks``, ``samples``, ``anchors``), so a copy is found with a probability, which
    tests hold above the 0.9 aimed at; unedited copies share all samples and are always found, and nothing is
    reported that exact edit distance doesn't confirm. Items are broadcast in blocks of at most ``block_bytes``;
    documents are read once, whatever the number of blocks. Null and empty texts and items give nothing; equal
    items are found each under its own id; rows of one document id, equal or not, are searched each; an empty
    benchmark or table gives no rows. Only id and text of ``df`` are read.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    item_type, kind, doc_type = benchmark.schema[item_col].dataType, dict(source.dtypes)["id"], source.schema["id"].dataType
    blocks = _shared(benchmark, item_col, item_text_col, similarity, **how)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["id", "item", "edits", "item_words", "start_word", "end_word"]
        types = [to_arrow_type(doc_type), to_arrow_type(item_type), *[pa.int32()] * 4]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, texts in _groups(batch.column(1)):
                rows = []
                for model in _loaded(blocks):
                    rows += [(ids[low + d], model.ids[k], e, len(model.words[k]), a, b) for d, k, e, a, b in model.search(texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = f"id {kind}, item {item_type.simpleString()}, edits int, item_words int, start_word int, end_word int"
    return source.mapInArrow(run, schema)


def _groups(bodies: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, hashed texts) of groups of about ``limit`` bytes that are searched together."""
    low, held, size = 0, [], 0
    for k, body in enumerate(values(bodies)):
        held.append(body)
        size += len(body or b"")
        if size >= limit:
            yield low, hashes_of(held)
            low, held, size = k + 1, [], 0
    if held:
        yield low, hashes_of(held)


def _shared(
    benchmark: DataFrame, item_col: str, text_col: str, similarity: float, walks: int = 6, samples: int = 2, anchors: int = 8, block_bytes: int = 64 << 20
) -> list[Broadcast]:
    """The benchmark in broadcast blocks of bounded size; items pass through the driver one block at a time."""
    sampler = Sampler(walks, samples)
    each = walks * samples * anchors * 64  # keys, owners and flags
    listed = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").cast("binary").alias("body"))
    context, blocks = benchmark.sparkSession.sparkContext, []
    ids: list = []
    words: list[np.ndarray] = []
    size = 0

    def close() -> None:
        nonlocal ids, words, size
        if ids:
            blocks.append(context.broadcast(Items(ids, words, similarity, sampler, anchors)))
        ids, words, size = [], [], 0

    for row in listed.where("body is not null").toLocalIterator():
        if len(hashed := hashes_of([bytes(row[1])])[0]):
            ids.append(row[0])
            words.append(hashed)
            size += 24 * len(hashed) + each
            if size >= block_bytes:
                close()
    close()
    return blocks


def decontaminated(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    **how: int,
) -> DataFrame:
    """The rows of ``df`` in which ``contamination`` finds nothing; all columns pass through, nothing is shuffled."""
    blocks = _shared(benchmark, item_col, item_text_col, similarity, **how)

    def run(bodies: pa.Array) -> pa.Array:
        clean = np.ones(len(bodies), bool)
        for low, texts in _groups(bodies):
            for model in _loaded(blocks):
                clean[[low + d for d, *_ in model.search(texts)]] = False
        return pa.array(clean)

    return df.where(F.arrow_udf(run, "boolean")(F.col(text_col).cast("string").cast("binary")))
