"""Triage of drafted vocabulary: what contradicts itself, and what of a drafted value extraction can't take.

A draft is a row ``(language, subject, neighbour, attribute, paraphrase, value, superseded_value, sentence)`` of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import folded, segment_function

FIELDS = ("subject", "neighbour", "attribute", "paraphrase", "value", "superseded_value", "sentence")
#: Characters that part words, besides white space.
APART = ",;:、，；"


def malformed(drafts: DataFrame) -> DataFrame:
    """``drafts`` with ``problems``: the fields that are missing, else all in which a draft contradicts itself."""
    absent = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"missing {c}")) for c in FIELDS)))
    folds = {f"__{c}": folded(F.coalesce(c, F.lit(""))) for c in ("subject", "neighbour", "attribute", "paraphrase", "value", "superseded_value")}
    col = lambda c: F.col(f"__{c}")
    told = F.array_compact(
        F.array(
            F.when(~F.contains("sentence", "value"), F.lit("the sentence doesn't hold the value")),
            F.when(col("neighbour") == col("subject"), F.lit("the neighbour repeats the subject")),
            F.when(col("superseded_value") == col("value"), F.lit("the superseded value repeats the value")),
            F.when((col("attribute") != "") & F.contains(col("paraphrase"), col("attribute")), F.lit("the paraphrase uses the attribute")),
        )
    )
    return drafts.withColumns(folds).withColumn("problems", F.when(F.size(absent) > 0, absent).otherwise(told)).drop(*folds)


def is_apart(edge: Column) -> Column:
    """Whether a character, or none, means that the text beside it is another word."""
    return (edge == "") | edge.rlike(rf"^[\s{APART}]$")


def left_over(value: Column, parts: Column) -> Column:
    """A value with the first occurrence of each part blanked out."""
    blanked = lambda rest, part: F.when(
        F.position(part, rest) > 0, F.concat(F.substring(rest, F.lit(1), F.position(part, rest) - 1), F.lit(" "), F.substring(rest, F.position(part, rest) + F.length(part), F.length(rest)))
    ).otherwise(rest)
    return F.aggregate(parts, value, blanked)


def unextracted(drafts: DataFrame, codes=None) -> DataFrame:
    """``drafts`` with ``extracted``, the tokens of the sentence, and ``outcome``.

    ``taken``: the value is a token, holds one that is a word by itself, or is made of tokens. ``clause``: a token has text
    grown to its left only, so the draft has more than a value. ``cut``: what is left of the value hangs on its token.
    ``missed``: no token lies in the value.
    """
    cut = segment_function(codes).asNondeterministic()
    tokens = F.flatten(F.transform(cut(F.col("sentence")), lambda s: F.transform(s["tokens"], lambda t: t["text"])))
    rows = drafts.withColumn("extracted", tokens)
    parts = F.filter("extracted", lambda t: (t != "") & F.contains("value", t))
    at = lambda t: F.position(t, F.col("value"))
    before = lambda t: F.substring("value", at(t) - 1, F.when(at(t) > 1, 1).otherwise(0))
    after = lambda t: F.substring("value", at(t) + F.length(t), F.lit(1))
    alone = F.exists("__parts", lambda t: is_apart(before(t)) & is_apart(after(t)))
    first = F.get("__parts", F.lit(0))
    whole = ~left_over(F.col("value"), F.col("__parts")).rlike(r"[\p{L}\p{N}]")
    outcome = (
        F.when(F.array_contains("extracted", F.col("value")) | alone | ((F.size("__parts") > 0) & whole), "taken")
        .when(F.size("__parts") == 0, "missed").when(~is_apart(before(first)) & is_apart(after(first)), "clause").otherwise("cut")
    )
    return rows.withColumn("__parts", parts).withColumn("outcome", outcome).drop("__parts")
