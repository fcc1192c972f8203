"""The audit of a dataset: answers and evidence in, one report row for each answer out."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import packs_of, uncovered
from ..functions.matching import MATCHERS, PLACE_LIMIT, SOURCE_LIMIT
from ..operators import grounding as g
from ..runtime import alike, by_key, stored
from ..sources import samples

CONTRACT = "groundwork.audit-report/1"
MAX_RUN, MAX_CLAIMS, MAX_PAIRS = 256, 64, 4096

LIMITS = (
    "Grounded says that a string stands in the evidence, not that it is true or well reasoned from.",
    "A sentence joined from two sources that are each quoted correctly counts as grounded.",
    "A meaning turned round without touching any checkable token goes unseen.",
    "A value rightly computed from grounded ones floats, since it is in no source; no arithmetic is done.",
    "Names are found by a title, honorific or legal form beside them; other names are never checked.",
    "A floating value is held against a source only if all its digits are the source's.",
)
PLAIN_LIMIT = "The evidence came as plain strings: offsets index those strings, and nothing is known of where they are from."
IRREVERSIBLE_LIMIT = "Values were redacted for good; segments with a placeholder are unverifiable, which is unknown and not wrong."


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def report_id(response_hash: Column, package_id: Column, version: str, codes=None, matcher: str = "normalized") -> Column:
    """The hash of all that a report follows from, but for the evidence's text."""
    packs = packs_of(codes)
    parts = [
        F.lit(CONTRACT), response_hash, F.coalesce(package_id, F.lit("")), F.lit(version), F.lit(",".join(segmenters(codes))), F.lit(",".join(extractors(codes))),
        F.lit(",".join(p.code for p in packs)), F.lit(matcher),
    ]
    return content_hash(F.concat_ws("\n", *parts))


def segmenters(codes=None) -> list[str]:
    return sorted(f"groundwork.segmenter/{p.code}@{p.version}" for p in packs_of(codes) if p.stops)


def extractors(codes=None) -> list[str]:
    return sorted(f"groundwork.extractor/{p.code}@{p.version}" for p in packs_of(codes) if p.rules)


def admit(answers: DataFrame) -> DataFrame:
    """``answers`` with refused, restored_by, asserted, protection_by, text and residue.

    Reads ``answer`` and, where the frame has them, ``protection`` and ``record`` (struct<by,scope,reversible>),
    ``restored`` (the answer as a restorer gave it back, null if none ran) and ``restored_by`` (a claim that it was).
    """
    have = set(answers.columns)
    shield = "struct<by:string,scope:string,reversible:boolean>"
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    rows = answers.withColumns(
        {"__p": col("protection", shield), "__r": col("record", shield), "__text": col("restored", "string"), "__by": col("restored_by", "string")}
    )
    shield_of = F.coalesce("__p", "__r")
    rows = rows.withColumns({"__shield": shield_of, "__residue": g.placeholders(F.col("answer"))})
    n, left = F.size("__residue"), F.size(g.placeholders(F.col("__text")))
    guarded, back = F.col("__shield").isNotNull(), F.col("__shield.reversible")
    differ = F.col("__p").isNotNull() & F.col("__r").isNotNull() & ~F.to_json("__p").eqNullSafe(F.to_json("__r"))
    refused = (
        F.when(F.col("__text").isNotNull() & F.col("__by").isNotNull(), "give a restorer or its name, not both")
        .when(differ, "the package and the record disagree on the protection")
        .when(~guarded & (n > 0), "the answer holds placeholders and nothing says it was protected")
        .when(guarded & back & F.col("__by").isNull() & F.col("__text").isNull(), "the answer is protected and nothing restored it")
        .when(guarded & back & F.col("__text").isNotNull() & (n > 0) & (left == n), "the restorer put nothing back")
    )
    ran = guarded & back & F.col("__text").isNotNull()
    text = F.when(ran, F.col("__text")).otherwise(F.col("answer"))
    by = F.when(guarded & ~back, None).when(ran, F.col("__shield.by")).otherwise(F.col("__by"))
    out = rows.withColumns(
        {"refused": refused, "text": text, "restored": F.lit(None), "asserted": F.coalesce(by.isNotNull() & ~F.coalesce(ran, F.lit(False)), F.lit(False)), "protection_by": F.col("__shield.by")}
    ).withColumn("restored_by", by)
    kept = out.withColumn("residue", g.placeholders(F.col("text"))).withColumn("irreversible", F.coalesce(guarded & ~back, F.lit(False)))
    return kept.drop("__p", "__r", "__text", "__by", "__shield", "__residue", "restored")


def bounds(tokens: DataFrame, answers: DataFrame) -> DataFrame:
    """(audit, bounds): a receipt for every cap that was met."""
    full = tokens.where(F.size("locations") >= min(PLACE_LIMIT, SOURCE_LIMIT))  # no other token meets a cap
    per_doc = full.select("audit", "seg", "tok", F.explode("locations.document_id").alias("document_id")).groupBy("audit", "seg", "tok", "document_id").agg(F.count("*").alias("n"))
    per_token = per_doc.groupBy("audit", "seg", "tok").agg(F.max("n").alias("most"), F.count("*").alias("documents"))
    met = per_token.groupBy("audit").agg(F.count_if(F.col("most") >= PLACE_LIMIT).alias("places"), F.count_if(F.col("documents") >= SOURCE_LIMIT).alias("sources"))
    runs = answers.select("audit", g.oversized_runs(F.col("text"), MAX_RUN).alias("runs"))
    row = lambda name, limit, why: F.struct(F.lit(name).alias("name"), F.lit(limit).alias("limit"), why.alias("because"))
    listed = F.array(
        F.when(F.size("runs") > 0, row("MAX_RUN", MAX_RUN, F.format_string("%d digit runs are longer than rules read, the longest %d", F.size("runs"), F.array_max("runs")))),
        F.when(F.col("places") > 0, row("LOCATION_LIMIT", PLACE_LIMIT, F.format_string("%d tokens occur in one document as often as places are listed", "places"))),
        F.when(F.col("sources") > 0, row("SOURCE_LIMIT", SOURCE_LIMIT, F.format_string("%d tokens occur in as many documents as are listed", "sources"))),
    )
    return by_key(runs, met, "audit", "left").select("audit", F.array_compact(listed).alias("bounds"))


def segments_of(admitted: DataFrame, codes=None) -> DataFrame:
    """Segments of the admitted answers with their tokens and the placeholders that reach into each; staged once."""
    cut = g.segments(alike(admitted.select("audit", "pkg", F.col("residue").alias("all_residue"), "text"), "text", "audit"), "text", codes)
    mine = F.filter("all_residue", lambda r: g.overlap(F.col("start"), F.col("end"), r["start"], r["end"]))
    free = cut.withColumn("residue", mine).drop("all_residue")
    kind = dict(free.dtypes)["tokens"]
    return stored(free.withColumn("tokens", F.when(F.size("residue") == 0, F.col("tokens")).otherwise(F.array().cast(kind))))


def audited(
    answers: DataFrame, items: DataFrame, *, codes=None, matcher: str = "normalized", neighbours: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(admitted answers, checked segments, checked tokens); without ``neighbours`` nothing is listed near floating tokens."""
    if matcher not in MATCHERS:
        raise ValueError(f"no matcher {matcher!r}")
    admitted = admit(answers)
    live = admitted.where("refused is null")
    segs = segments_of(live, codes)
    tokens = stored(g.checked_tokens(segs, items, codes, matcher, neighbours))
    return admitted, g.checked_segments(segs, tokens), tokens


def shares(answers: DataFrame, items: DataFrame, *, codes=None, matcher: str = "normalized") -> DataFrame:
    """(audit, grounded, floating) of each admitted answer, from the tokens' places alone; no report is made."""
    admitted = admit(answers).where("refused is null")
    placed = g.placed_tokens(segments_of(admitted, codes), items, matcher)
    up = F.count_if(F.size("locations") > 0)
    counts = placed.groupBy("audit").agg(up.alias("grounded"), (F.count("*") - up).alias("floating"))
    return by_key(admitted.select("audit"), counts, "audit", "left").select("audit", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("grounded", "floating")))


def pooled_shares(rows: DataFrame) -> DataFrame:
    """``pooled`` over rows of ``shares``."""
    up, down = F.sum("grounded"), F.sum("floating")
    return rows.agg(
        F.count("*").alias("answers"), F.count_if(F.col("grounded") + F.col("floating") > 0).alias("scored"), up.alias("grounded"), down.alias("floating"), F.try_divide(up, up + down).alias("grounded_share"),
    )


def audit(
    answers: DataFrame, items: DataFrame, omissions: DataFrame | None = None, *, codes=None, matcher: str = "normalized", version: str = "", plain: bool = True, neighbours: bool = True
) -> DataFrame:
    """One report row for each answer, refused ones with the reason and nothing else.

    ``answers(audit, pkg, answer[, package_id, unrecognised, ...])``; ``items`` as sources give them; packages may serve many
    answers. Arrays are in report order, so equal inputs give equal rows. Without ``neighbours`` tokens have no ``nearby``.
    """
    admitted, segs, tokens = audited(answers, items, codes=codes, matcher=matcher, neighbours=neighbours)
    row = F.struct(
        "seg", g.segment_ids(F.col("seg")).alias("segment_id"), "start", "end", F.col("body").alias("text"), "kind", "script", "boundary", "verdict", "because", "tokens",
    )
    skip = F.struct("start", "end", g.skip_rule().alias("rule"), g.segment_ids(F.col("seg")).alias("segment_id"), g.skip_reason().alias("reason"))
    told = segs.groupBy("audit").agg(  # one pass over the segments for all that a report says of them
        F.array_sort(F.collect_list(row)).alias("segments"), F.struct(*g.verdict_sums()).alias("verdicts"), F.struct(*g.coverage_sums()).alias("sums"),
        F.array_sort(F.collect_list(F.when(g.skipped(), skip))).alias("skipped"),
    )
    n = F.col("sums")
    told = told.select(
        "audit", "segments", "verdicts",
        F.struct(n["segments"].alias("segments"), n["bearing"].alias("bearing"), n["unbearing"].alias("unbearing"), n["unexamined"].alias("unexamined"), n["particulars"].alias("particulars"), n["particulars"].alias("checked"), F.array(*map(F.lit, uncovered(packs_of(codes)))).cast("array<string>").alias("kinds_not_extracted")).alias("coverage"),
        F.struct(n["grounded_tokens"].alias("grounded"), (n["particulars"] - n["grounded_tokens"]).alias("floating")).alias("particulars"), F.try_divide(n["grounded_tokens"], n["particulars"]).alias("grounded_share"),
        F.when(F.size("skipped") > 0, F.col("skipped")).alias("unchecked"),
    )
    receipts = bounds(tokens, admitted.where("refused is null"))
    out = by_key(by_key(admitted, told, "audit", "left"), receipts, "audit", "left")
    if omissions is not None:
        per = g.withheld_by_rule(omissions, "pkg").groupBy("pkg").agg(F.array_sort(F.collect_list(F.struct("rule", "n"))).alias("withheld"))
        out = by_key(out, per, "pkg", "left")
    else:
        out = out.withColumn("withheld", F.array().cast("array<struct<rule:string,n:bigint>>"))
    package = F.col("package_id") if "package_id" in answers.columns else F.lit("")
    extra = [F.lit(x) for x in LIMITS + ((PLAIN_LIMIT,) if plain else ())]
    limits = F.concat(F.array(*extra), F.when(F.col("irreversible") & (F.size("residue") > 0), F.array(F.lit(IRREVERSIBLE_LIMIT))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce("bounds", F.array().cast("array<struct<name:string,limit:int,because:string>>")), lambda b: b["because"]))
    unread = F.coalesce("unrecognised" if "unrecognised" in answers.columns else F.lit(None), F.array().cast("array<string>"))
    whole = out.withColumn("response_hash", content_hash(F.col("text")))
    return whole.select(
        "audit", "pkg", "refused", F.lit(CONTRACT).alias("contract"), report_id(F.col("response_hash"), package, version, codes, matcher).alias("report_id"),
        F.struct(package.alias("package_id"), "response_hash", F.length("text").alias("response_length"), F.array(*map(F.lit, segmenters(codes))).alias("segmenters"), F.array(*map(F.lit, extractors(codes))).alias("extractors"), F.array(*[F.lit(p.code) for p in packs_of(codes)]).alias("packs"), F.lit(version).alias("engine_version"), F.lit(matcher).alias("matcher")).alias("audited"),
        "unchecked", "coverage", limits.alias("limits"), "bounds", "verdicts", "particulars", "grounded_share", "segments",
        F.struct("restored_by", F.col("asserted").alias("restoration_asserted"), "protection_by", "withheld", unread.alias("unrecognised")).alias("provenance"), F.col("text").alias("answer"),
    )


def refusals(samples_df: DataFrame, key: str = "audit") -> DataFrame:
    """(audit, refused): the samples of a dataset that can't be audited; no evidence is read for that."""
    rows = samples.resolve(samples_df, key)
    late = admit(rows.where("refused is null").select("audit", "pkg", "answer")).where("refused is not null")
    return rows.where("refused is not null").select("audit", "refused").unionByName(late.select("audit", "refused"))


def evaluate_frame(samples_df: DataFrame, key: str = "audit", **options) -> tuple[DataFrame, DataFrame]:
    """(reports, refused): a dataset of samples under any of the usual column names."""
    rows = stored(samples.resolve(samples_df, key))
    good = rows.where("refused is null").drop("refused")
    reports = audit(good.select("audit", "pkg", "answer"), samples.items_of(good), **options)
    late = reports.where("refused is not null").select("audit", "refused")
    return reports.where("refused is null"), rows.where("refused is not null").select("audit", "refused").unionByName(late)


def pooled(reports: DataFrame) -> DataFrame:
    """The share over all tokens of a dataset, not the mean of the answers' shares, and how many answers had a token."""
    up, down = F.sum("particulars.grounded"), F.sum("particulars.floating")
    return reports.agg(
        F.count("*").alias("answers"), F.count_if(F.col("grounded_share").isNotNull()).alias("scored"), up.alias("grounded"), down.alias("floating"), F.try_divide(up, up + down).alias("grounded_share"),
    )


def flat_rows(reports: DataFrame) -> DataFrame:
    """One flat row for each report."""
    return reports.select("audit", "report_id", "verdicts.*", F.col("particulars.grounded").alias("grounded_tokens"), F.col("particulars.floating").alias("floating_tokens"), "grounded_share", F.array_join("limits", "\n").alias("limits"))


def claims(reports: DataFrame, with_grounded: bool = False) -> DataFrame:
    """(audit, n, segment_id, text, particular, found_in, total): what a judge is asked, the first 64 of each report."""
    none = F.lit(None).cast("string")
    claim = lambda s, token, found: F.struct(s["segment_id"].alias("segment_id"), s["text"].alias("text"), token.alias("particular"), found.alias("found_in"))
    kind = "array<struct<segment_id:string,text:string,particular:string,found_in:string>>"

    def of(s: Column) -> Column:
        up = F.transform(F.filter(s["tokens"], lambda t: F.size(t["locations"]) > 0), lambda t: claim(s, t["text"], t["locations"][0]["item_id"]))
        down = F.transform(F.filter(s["tokens"], lambda t: (F.size(t["locations"]) == 0) & t["contradiction"].isNull()), lambda t: claim(s, t["text"], none))
        rest = F.when(s["verdict"] == "unbearing", F.array(claim(s, none, none))).otherwise(down)
        asked = F.concat(up, rest) if with_grounded else rest
        return F.when(s["verdict"].isin(*g.UNEXAMINED), F.array().cast(kind)).otherwise(asked.cast(kind))

    rows = reports.select("audit", F.flatten(F.transform("segments", of)).alias("all")).withColumn("total", F.size("all"))
    return rows.select("audit", "total", F.posexplode(F.slice("all", 1, MAX_CLAIMS)).alias("n", "c")).select("audit", (F.col("n") + 1).alias("n"), "c.*", "total")


def unjudgeable(asked: DataFrame, contexts: DataFrame) -> DataFrame:
    """(audit, refused): answers whose claims can't be judged, for want of contexts or because they make too many pairs."""
    claims_of = asked.groupBy("audit").agg(F.count("*").alias("claims"))
    both = by_key(claims_of, contexts.groupBy("audit").agg(F.count("*").alias("contexts")), "audit", "left")
    pairs = F.col("claims") * F.col("contexts")
    refused = F.when(F.col("contexts").isNull(), "there is no context to judge by").when(
        pairs > MAX_PAIRS, F.format_string("%d claims and %d contexts make more than %d pairs", "claims", "contexts", F.lit(MAX_PAIRS))
    )
    return both.select("audit", refused.alias("refused")).where("refused is not null")


def judge(asked: DataFrame, contexts: DataFrame, score, supported: float = 0.5, unsupported: float = 0.2, model: str = "", scope: str = "") -> DataFrame:
    """(audit, n, segment_id, particular, standing, item, because, model, scope): each claim by the best of its answer's contexts.

    ``contexts(audit, item, premise)`` are those of the claim's own answer; ties go to the first context. ``score(premise,
    claim)`` is the caller's column function. Answers of more than MAX_PAIRS pairs of claim and context are left out
    before any pair is made, as are those without a context; ``unjudgeable`` names them.
    """
    if not 0 <= unsupported <= supported <= 1:
        raise ValueError("scores lie between 0 and 1, and what is unsupported below what is supported")
    fit = by_key(asked, unjudgeable(asked, contexts).select("audit"), "audit", "left_anti")
    pairs = by_key(fit, contexts.select("audit", "item", "premise"), "audit")
    scored = pairs.withColumn("score", score(F.col("premise"), F.coalesce("particular", "text")))
    best = scored.groupBy("audit", "n").agg(F.max_by(F.struct("score", "item"), F.struct("score", -F.col("item"))).alias("best"))
    got = F.col("best.score")
    standing = F.when(got >= supported, "supported").when(got < unsupported, "unsupported").otherwise("unclear")
    why = F.format_string("score %.2f with context %d; supported from %.2f, unsupported below %.2f", got.cast("double"), F.col("best.item").cast("long"), F.lit(float(supported)), F.lit(float(unsupported)))
    rows = by_key(fit, best, ["audit", "n"])
    return rows.select("audit", "n", "segment_id", "particular", standing.alias("standing"), "best.item", why.alias("because"), F.lit(model).alias("model"), F.lit(scope).alias("scope"))


JUDGEMENT_LIMITS = (
    "What is listed under judged is the opinion of a model and no verdict; asked again it may differ, so each names its model.",
    "Supported says that a model thinks the evidence entails a claim, not that the claim's tokens stand in the evidence.",
    "Judgements don't enter the report's id, and deriving the report again leaves them out.",
)


def with_judgements(reports: DataFrame, judged: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Reports with ``judged``, in the order of the claims, and what that adds to limits and bounds; the id stays.

    The limits are the standing ones and the scopes that the models state, each once, in the order they first appear.
    ``asked`` are the claims, whose ``total`` says whether all were sent. A report with no judgement stays as it is.
    """
    row = F.struct("n", "segment_id", "particular", "standing", "because", "model", "scope")
    listed = judged.groupBy("audit").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    out = reports.join(listed, "audit", "left")
    none = "array<struct<segment_id:string,particular:string,standing:string,because:string,model:string>>"
    said = F.filter(F.transform("__rows", lambda r: r["scope"]), lambda x: x.isNotNull() & (x != ""))
    plain = F.transform("__rows", lambda r: F.struct(*(r[c].alias(c) for c in ("segment_id", "particular", "standing", "because", "model"))))
    more = F.when(F.size("__rows") > 0, F.concat(F.array(*map(F.lit, JUDGEMENT_LIMITS)), F.array_distinct(said))).otherwise(F.array().cast("array<string>"))
    receipt = "struct<name:string,limit:int,because:string>"
    if asked is None:
        unsent = out.withColumn("__unsent", F.lit(None).cast(receipt))
    else:
        sums = asked.groupBy("audit").agg(F.count("*").alias("__sent"), F.max("total").alias("__total"))
        told = F.struct(
            F.lit("MAX_CLAIMS").alias("name"), F.lit(MAX_CLAIMS).alias("limit"),
            F.format_string("%d of %d claims were sent to a judge; nothing judged the others", "__sent", "__total").alias("because"),
        )
        unsent = out.join(sums, "audit", "left").withColumn("__unsent", F.when(F.col("__sent") < F.col("__total"), told).cast(receipt))
    extra = F.array_compact(F.array("__unsent"))
    judged_columns = {
        "judged": F.coalesce(plain.cast(none), F.array().cast(none)), "bounds": F.concat(F.coalesce("bounds", F.array().cast(f"array<{receipt}>")), extra),
        "limits": F.concat("limits", F.transform(extra, lambda b: b["because"]), more),
    }
    return unsent.withColumns(judged_columns).select(*reports.columns, *(["judged"] if "judged" not in reports.columns else []))


def _flat(value, path: str, out: list) -> None:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            _flat(inner, f"{path}.{key}" if path else key, out)
    elif isinstance(value, list) and value:
        for k, inner in enumerate(value):
            _flat(inner, f"{path}[{k}]", out)
    else:
        out.append({"path": path, "value": json.dumps(value, ensure_ascii=False, sort_keys=True)})


def leaves(documents: DataFrame, column: str = "document") -> DataFrame:
    """(audit, path, value): every leaf of a JSON document; an empty list or object is one."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            found: list = []
            if text is not None:
                _flat(json.loads(text), "", found)
            rows.append(found)
        return pa.array(rows, kind)

    flat = F.arrow_udf(run, "array<struct<path:string,value:string>>").asNondeterministic()
    return documents.withColumn("__flat", flat(F.col(column))).select("audit", F.explode("__flat").alias("l")).select("audit", "l.path", "l.value")


def recheck(archived: DataFrame, fresh: DataFrame) -> DataFrame:
    """(audit, path, archived, fresh): leaves that differ, the engine version first; keys are (audit, path, value) rows."""
    a, b = archived.select("audit", "path", F.col("value").alias("archived")), fresh.select("audit", "path", F.col("value").alias("fresh"))
    return _told(a.join(b, ["audit", "path"], "full_outer").where(~F.col("archived").eqNullSafe(F.col("fresh"))))


def recheck_documents(archived: DataFrame, fresh: DataFrame, column: str = "document") -> DataFrame:
    """``recheck`` of the leaves of two JSON documents of one audit, of which only those that differ leave Python."""
    kind = pa.list_(pa.struct([("path", pa.string()), ("archived", pa.string()), ("fresh", pa.string())]))

    def leaves_of(text: str | None) -> dict:
        found: list = []
        if text is not None:
            _flat(json.loads(text), "", found)
        return {leaf["path"]: leaf["value"] for leaf in found}

    def run(old: pa.Array, new: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(map(leaves_of, old.to_pylist()), map(leaves_of, new.to_pylist()), strict=True):
            rows.append([{"path": k, "archived": a.get(k), "fresh": b.get(k)} for k in a.keys() | b.keys() if a.get(k) != b.get(k)])
        return pa.array(rows, kind)

    differ = F.arrow_udf(run, "array<struct<path:string,archived:string,fresh:string>>").asNondeterministic()
    both = by_key(archived.select("audit", F.col(column).alias("__old")), fresh.select("audit", F.col(column).alias("__new")), "audit", "full_outer")
    found = both.withColumn("__leaves", differ("__old", "__new")).select("audit", F.explode("__leaves").alias("l"))
    return _told(found.select("audit", "l.path", "l.archived", "l.fresh"))


def _told(differing: DataFrame) -> DataFrame:
    absent = F.lit("<absent>")
    return differing.select("audit", "path", F.coalesce("archived", absent).alias("archived"), F.coalesce("fresh", absent).alias("fresh")).orderBy("audit", F.col("path") != "audited.engine_version", "path")
