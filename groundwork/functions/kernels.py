"""Arrow functions over the text kernels; everything else of an audit is built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from .extracting import extract
from .folding import digits_of, fold, shape_of
from .languages import packs_of, rules_of
from .matching import Hay, keys_of, places, probe_of
from .segmenting import Segmenter, script_of

TOKEN = "struct<ord:int,kind:string,start:int,end:int,text:string,form:string,probe:string,digits:string,shape:string,keys:array<string>>"
SEGMENTS = (
    "array<struct<ord:int,start:int,end:int,text:string,kind:string,script:string,boundary:string,"
    f"tokens:array<{TOKEN}>>>"
)
_TOKEN = pa.struct(
    [("ord", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    + [(n, pa.string()) for n in ("text", "form", "probe", "digits", "shape")] + [("keys", pa.list_(pa.string()))]
)
_SEGMENT = pa.struct(
    [("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
    + [(n, pa.string()) for n in ("text", "kind", "script", "boundary")]
    + [("tokens", pa.list_(_TOKEN))]
)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


@lru_cache(4096)
def _comparable(text: str) -> dict:
    form = fold(text).text
    return {"text": text, "form": form, "probe": probe_of(form), "digits": digits_of(form), "shape": shape_of(form), "keys": keys_of(form)}


def token_fields(kind: str, start: int, text: str, order: int, bare: bool = False) -> dict:
    """A token's row; a ``bare`` one has nothing that it is compared by."""
    return {"ord": order, "kind": kind, "start": start, "end": start + len(text), **({"text": text} if bare else _comparable(text))}


def segments_with_tokens(text: str, segmenter: Segmenter, rules: Sequence, bare: bool = False) -> list[dict]:
    """All segments of a text, each with its tokens in the text's coordinates; code has none, and without rules none has."""
    out = []
    for k, s in enumerate(segmenter.segments_of(text)):
        body = text[s.start : s.end]
        tokens = [] if s.kind == "code" or not rules else extract(body, rules)
        found = [token_fields(t.kind, s.start + t.start, body[t.start : t.end], i, bare) for i, t in enumerate(tokens)]
        out.append(
            {"ord": k, "start": s.start, "end": s.end, "text": body, "kind": s.kind, "script": script_of(body), "boundary": s.boundary, "tokens": found}
        )
    return out


def segment_function(codes: Sequence[str] | None = None, tokens: str = "all"):
    """array of segments with tokens of a text column; null for null. One pass of Python for both steps.

    A text that a batch holds more than once is cut once. ``tokens`` are all, or bare ones, without what they are
    compared by, or none.
    """
    packs = packs_of(codes)
    segmenter, rules = Segmenter(packs), rules_of(packs) if tokens != "none" else ()

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        made = [segments_with_tokens(t, segmenter, rules, tokens == "bare") for t in coded.dictionary.to_pylist()]
        return pa.array(made, pa.list_(_SEGMENT)).take(coded.indices)

    return F.arrow_udf(run, SEGMENTS)


def script_function():
    """Script label of a text; null for null."""
    return F.arrow_udf(lambda texts: pa.array([None if t is None else script_of(t) for t in texts.to_pylist()], pa.string()), "string")


def forms_function(matcher: str = "normalized"):
    """struct<form, probe, keys> of whole texts that are looked for as tokens are."""
    kind = pa.struct([("form", pa.string()), ("probe", pa.string()), ("keys", pa.list_(pa.string()))])

    def run(texts: pa.Array) -> pa.Array:
        forms = [fold(t or "").text for t in texts.to_pylist()]
        return pa.array([{"form": f, "probe": probe_of(f), "keys": keys_of(f, matcher)} for f in forms], kind)

    return F.arrow_udf(run, "struct<form:string,probe:string,keys:array<string>>")


def fold_function():
    """Folded text of a column."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold(t).text for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def folded(column):
    """Folded text: expressions for ASCII rows, the function for others."""
    plain = F.trim(F.regexp_replace(F.lower(column), r"[\s\x1c-\x1f]+", " "))
    return F.when(column.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(fold_function()(F.when(~column.rlike(r"^[\x00-\x7f]*$"), column)))


def places_function(matcher: str = "normalized"):
    """Spans of an item's text where a folded token stands alone."""

    def run(forms: pa.Array, texts: pa.Array) -> pa.Array:
        kept: dict = {}
        asked: dict = {}  # equal pairs of a batch are looked at once
        at = [asked.setdefault(pair, len(asked)) for pair in zip(forms.to_pylist(), texts.to_pylist(), strict=True)]
        out = []
        for form, text in asked:
            if text not in kept:
                if len(kept) > 256:
                    kept.clear()
                kept[text] = Hay.of(text or "")
            out.append([{"start": a, "end": b} for a, b in places(form, kept[text], matcher)])
        return pa.array(out, pa.list_(_SPAN)).take(pa.array(at, pa.int32()))

    return F.arrow_udf(run, "array<struct<start:int,end:int>>")


_FOUND = pa.list_(pa.struct([("form", pa.string()), ("spans", pa.list_(_SPAN))]))


def form_places_function(matcher: str = "normalized"):
    """array<struct<form, spans>> of those of some forms that stand alone in a text; what a batch asks twice is looked up once."""

    def run(forms: pa.Array, texts: pa.Array) -> pa.Array:
        asked: dict = {}
        at = [asked.setdefault((tuple(some), text), len(asked)) for some, text in zip(forms.to_pylist(), texts.to_pylist(), strict=True)]
        out = []
        for some, text in asked:
            hay = Hay.of(text or "")
            found = ((form, places(form, hay, matcher)) for form in some)
            out.append([{"form": form, "spans": [{"start": a, "end": b} for a, b in spans]} for form, spans in found if spans])
        return pa.array(out, _FOUND).take(pa.array(at, pa.int32()))

    return F.arrow_udf(run, "array<struct<form:string,spans:array<struct<start:int,end:int>>>>")
