"""What a report comes to, as columns over reports: tokens by standing, what lies near, what wasn't checked, one line for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import grounding as g

VERDICT_MEANING = {
    "grounded": "every checkable token stands in the evidence", "floating": "a checkable token is in none of the evidence",
    "contradicted": "a token has the digits of one evidence token and another unit", "unbearing": "nothing in it can be checked",
    "unchecked": "it isn't prose and wasn't looked at", "unverifiable": "a redacted value stands in it",
}


def _tokens() -> Column:
    return F.flatten(F.transform(F.coalesce("segments", F.expr("array()")), lambda s: s["tokens"]))


def _up(t: Column) -> Column:
    return F.size(t["locations"]) > 0


def ambiguous(token: Column) -> Column:
    """Whether a token stands in more than one place."""
    return F.size(token["locations"]) > 1


def in_an_interpretation(token: Column) -> Column:
    """Whether a token stands somewhere, and nowhere but in interpretations."""
    return _up(token) & F.forall(token["locations"], lambda x: F.coalesce(x["layer"] == "interpretation", F.lit(False)))


def accessors(reports: DataFrame) -> DataFrame:
    """(audit, grounded_share, grounded, floating, nearby, unchecked, limits, has_findings, examined) of each report.

    ``grounded`` and ``floating`` are texts of tokens in order; ``nearby`` maps a floating token's text to what the
    evidence has of its kind, the last one's where a text floats twice; ``unchecked`` says by which rule each segment
    was passed over; ``examined`` counts the segments that were looked at.
    """
    every = _tokens()
    near = F.filter(every, lambda t: F.size(F.coalesce(t["nearby"], F.expr("array()"))) > 0)
    pairs = F.transform(near, lambda t, k: F.struct(t["text"].alias("key"), F.transform(t["nearby"], lambda x: x["text"]).alias("value"), k.alias("k")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["k"] > p["k"])))
    return reports.select(
        "audit", "grounded_share", F.transform(F.filter(every, _up), lambda t: t["text"]).alias("grounded"),
        F.transform(F.filter(every, lambda t: ~_up(t)), lambda t: t["text"]).alias("floating"),
        F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"]))).alias("nearby"),
        F.transform(F.coalesce("unchecked", F.expr("array()")), lambda u: F.concat(u["segment_id"], F.lit(": "), u["rule"])).alias("unchecked"), "limits",
        F.exists("segments", lambda s: s["verdict"].isin(*g.FINDINGS)).alias("has_findings"),
        (F.col("coverage.bearing") + F.col("coverage.unbearing")).alias("examined"),
    )


def traced(reports: DataFrame) -> DataFrame:
    """(audit, segment_id, text, start, end, places, in_an_interpretation): grounded tokens of segments that are no findings."""
    rows = reports.select("audit", F.explode("segments").alias("s")).where(~F.col("s.verdict").isin(*g.FINDINGS))
    flat = rows.select("audit", "s.segment_id", F.explode("s.tokens").alias("t")).where(F.size("t.locations") > 0)
    where = F.transform("t.locations", lambda x: F.concat(F.coalesce(F.nullif(x["source_path"], F.lit("")), x["document_id"]), F.lit("["), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"), F.lit("]")))
    return flat.select("audit", "segment_id", "t.text", "t.start", "t.end", where.alias("places"), in_an_interpretation(F.col("t")).alias("in_an_interpretation"))


def skip_counts(reports: DataFrame) -> DataFrame:
    """(audit, rule, n): how many segments each rule passed over, by name of the rule."""
    return reports.select("audit", F.explode("unchecked").alias("u")).groupBy("audit", F.col("u.rule").alias("rule")).agg(F.count("*").alias("n")).orderBy("audit", "rule")


def summaries(reports: DataFrame) -> DataFrame:
    """(audit, summary): one line for each report; what wasn't checked is said before the share."""
    skipped, up, all_ = F.size("unchecked"), F.col("particulars.grounded"), F.col("particulars.grounded") + F.col("particulars.floating")
    share = F.when(all_ == 0, "nothing in it could be checked").otherwise(F.format_string("%d of %d tokens grounded", up, all_))
    found = F.size(F.filter("segments", lambda s: s["verdict"].isin(*g.FINDINGS)))
    return reports.select("audit", F.format_string("%d of %d segments not checked; %s; %d findings", F.coalesce(skipped, F.lit(0)), "coverage.segments", share, F.coalesce(found, F.lit(0))).alias("summary"))
