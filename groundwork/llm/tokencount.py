"""Token counts: a unigram vocabulary scored once per shared prefix of the distinct pre-tokens."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, values, written

MARK = "▁"
_NEVER = -1e300


class Vocabulary:
    """Pieces with log-probabilities. A character that no piece covers costs ``unknown`` and is one token."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None) -> None:
        self.scores = {p: float(s) for p, s in scores.items() if p}
        self.unknown = min(self.scores.values(), default=0.0) - 10.0 if unknown is None else unknown


def vocabulary_of_model(path: str) -> Vocabulary:
    """The normal pieces of a sentencepiece model file; a piece's probability falls as 1 / (rank + 1).

    The file ranks its pieces; nothing is trained. The file is read on the driver and not copied anywhere.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    normal = [k for k in range(model.vocab_size()) if not any(f(k) for f in special)]
    normal.sort(key=lambda k: (-model.get_score(k), k))
    total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    return Vocabulary({model.id_to_piece(k): -math.log(r + 1) - total for r, k in enumerate(normal)})


class Trie:
    """Best segmentations of pre-tokens, each shared prefix scored once.

    Pre-tokens come in sorted order, which walks their trie depth first: the path from the root to the present node is
    a stack, and a node's forward score is computed from its ancestors when it is first entered. A node holds its
    score, its tokens and the pieces that are still open there, so that only text which begins a piece is followed.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.unknown, self.scored = vocabulary.unknown, 0
        self.pieces: dict = {}
        for piece, score in vocabulary.scores.items():
            node = self.pieces
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        self.stack: list[tuple] = [(0.0, 0, [])]
        self.before = ""

    def count(self, word: str) -> int:
        """Tokens of the next word. Ties go to fewer tokens."""
        shared, limit = 0, min(len(word), len(self.before), len(self.stack) - 1)
        while shared < limit and word[shared] == self.before[shared]:
            shared += 1
        stack, unknown, root = self.stack, self.unknown, self.pieces
        del stack[shared + 1 :]
        self.before = word
        self.scored += len(word) - shared
        score, tokens, open_pieces = stack[shared]
        for depth in range(shared, len(word)):
            c = word[depth]
            first = root.get(c)
            best, least = (score + unknown, tokens + 1) if first is None or "" not in first else (_NEVER, 0)
            going = []
            for begun, held, node in (*open_pieces, (score, tokens, root)):
                child = node.get(c)
                if child is not None:
                    going.append((begun, held, child))
                    piece = child.get("")
                    if piece is not None:
                        got = begun + piece
                        if got > best or (got == best and held + 1 < least):
                            best, least = got, held + 1
            score, tokens, open_pieces = best, least, going
            if depth < _DEPTH:
                stack.append((score, tokens, open_pieces))
        return tokens


#: Prefixes longer than this aren't shared, so that one endless word takes no memory.
_DEPTH = 256
#: Bytes of the frequent pre-tokens that are broadcast, and what one takes besides its text.
HEAD_BYTES, _ENTRY = 64 << 20, 64
#: Distinct words that a worker counts before it hands them on.
_FLUSH = 1_000_000


class _Known(dict):
    """Tokens of frequent words; words that aren't among them count as 0 and are noted."""

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return 0


def distinct_words(source: DataFrame) -> DataFrame:
    """(word, n): the distinct pre-tokens of all texts, counted before and after one shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for body in values(batch.column(0)):
                held.update((body or b"").split())
                if len(held) >= _FLUSH:
                    yield counted()
                    held.clear()
        yield counted()

    return source.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scored_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, n, tokens): words dealt by ranges, so that shared prefixes meet, and scored by a trie in each range."""
    shared = words.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            tokens = pa.array([trie.count(MARK + w.decode("utf-8", "replace")) for w in values(batch.column(0))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], ["word", "n", "tokens"])

    dealt = words.repartitionByRange(shuffle_partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "word binary, n long, tokens long")


def _head(scored: DataFrame, limit: int) -> dict[bytes, int]:
    """Tokens of the most frequent words, as many classes of frequency as fit in ``limit`` bytes."""
    rank = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = scored.groupBy(rank.alias("rank")).agg(F.sum(F.octet_length("word") + _ENTRY).alias("bytes")).orderBy(F.col("rank").desc()).collect()
    least, total = None, 0
    for row in sizes:
        total += row["bytes"]
        if total > limit:
            break
        least = row["rank"]
    if least is None:
        return {}
    taken = scored.where(F.col("n") >= 2**least).select("word", "tokens").toArrow()
    return dict(zip(taken["word"].to_pylist(), taken["tokens"].to_pylist(), strict=True))


def token_counts(
    df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", head_bytes: int = HEAD_BYTES
) -> DataFrame:
    """(id, n_pretokens, n_tokens), one row per row of ``df``.

    Pre-tokens are runs of anything but space and 0x09-0x0D, each led by the word mark. The distinct ones of the
    whole table are gathered, put in a trie range by range and scored once. Counts come back to the texts by a broadcast
    of the frequent words, of at most ``head_bytes``, and by a join for the occurrences of all others, so no
    table of words need fit anywhere. Null and blank texts have 0 of both; texts and words may be of any length;
    repeated rows and null ids are rows like any other; an empty table gives none; other columns don't matter.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    kind = dict(source.dtypes)["id"]
    scored = written(scored_words(distinct_words(source), vocabulary))
    shared = df.sparkSession.sparkContext.broadcast(_head(scored, head_bytes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(shared.value)
        shared.__dict__.pop("_value", None)  # the plain table isn't needed beside it
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                split, sums, open_words = [], [], []
                for body in values(part.column(1)):
                    words = (body or b"").split()
                    known.rare = []
                    split.append(len(words))
                    sums.append(sum(map(known.__getitem__, words)))
                    open_words.append(known.rare)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(split, pa.int64()), pa.array(sums, pa.int64()), pa.array(open_words, pa.list_(pa.binary()))],
                    ["id", "n_pretokens", "sums", "words"],
                )

    counted = source.mapInArrow(run, f"id {kind}, n_pretokens long, sums long, words array<binary>")
    rows = written(counted.withColumn("place", F.monotonically_increasing_id()))
    rare = rows.select("place", F.explode("words").alias("word")).join(scored.select("word", "tokens"), "word").groupBy(F.col("place").alias("at")).agg(F.sum("tokens").alias("more"))
    total = (F.col("sums") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return rows.join(rare, rows["place"] == rare["at"], "left").select("id", "n_pretokens", total)
