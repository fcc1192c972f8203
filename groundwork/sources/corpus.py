"""Labelled corpora on disk: planted cases, marked answers, archived reports and statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import KINDS

SPAN = "array<int>"
PLANT = (
    f"struct<kind:string,span:{SPAN},text:string,was:string,source:struct<document_id:string,span:{SPAN}>,"
    "expect_detected:boolean,is_hallucination:boolean,declared_miss:boolean,expect_verdict:string>"
)
CASE = f"struct<format:string,case_id:string,language:string,genre:string,split:string,tier:array<string>,expect_refusal:boolean,plants:array<{PLANT}>>"
REPORT = (
    "struct<contract:string,report_id:string,answer:string,"
    "audited:struct<package_id:string,response_hash:string,packs:array<string>,engine_version:string,matcher:string>>"
)
REPORT_FAMILY = "audit-report"


def strip_markup(text: Column, tag: str = "P") -> Column:
    """struct<text, markings>: a text without ``{{tag:name}}body{{/tag}}`` and where each body lies in it."""
    pattern = rf"(?s)\{{\{{{tag}:([^}}]*)\}}\}}(.*?)\{{\{{/{tag}\}}\}}"
    names, bodies = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    between = F.split(text, pattern, -1)
    places = F.transform(
        names,
        lambda name, k: F.struct(
            name.alias("kind"),
            (F.length(F.array_join(F.slice(between, F.lit(1), k + 1), "")) + F.length(F.array_join(F.slice(bodies, F.lit(1), k), ""))).alias("start"),
            F.get(bodies, k).alias("text"),
        ),
    )
    marks = F.transform(places, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text")))
    return F.struct(F.regexp_replace(text, pattern, "$2").alias("text"), marks.alias("markings"))


def marked_answers(spark: SparkSession, root: str) -> DataFrame:
    """(name, language, genre, text, markings, refused) of ``<language>-<genre>-<number>.md`` files; an unknown kind is refused."""
    files = spark.read.text(f"{root}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("name"), F.col("value"))
    parts, cut = F.split("name", "-"), strip_markup(F.col("value"))
    rows = files.where("name <> 'README'").select("name", parts[0].alias("language"), F.get(parts, F.lit(1)).alias("genre"), F.size(parts).alias("n"), cut.alias("c"))
    unknown = F.exists("c.markings", lambda m: ~m["kind"].isin(*KINDS))
    refused = F.when(F.col("n") < 3, "the name isn't language-genre-number").when(unknown, "a marking has an unknown kind")
    return rows.select("name", "language", "genre", "c.text", "c.markings", refused.alias("refused"))


def cases(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train",), tier: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, plants, packages) of folders that hold ``case.json``, ``package.json`` and ``response.txt``.

    Only the named splits are read. ``cases`` has audit, language, genre, answer, refusal_due and ``refused``, set where a
    plant's text isn't what the response has at its place, or what it was isn't what an item of the package has at its
    source. Cases come by id, plants by case and place.
    """

    def files(name: str, column: str) -> DataFrame:
        folder = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
        return spark.read.text(f"{root}/*/{name}", wholetext=True).select(folder.alias("folder"), F.col("value").alias(column))

    read = files("case.json", "raw").withColumn("case", F.from_json("raw", CASE)).drop("raw")
    kept = read.where(F.col("case.split").isin(*splits))
    if tier is not None:
        kept = kept.where(F.array_contains("case.tier", tier))
    both = kept.join(files("response.txt", "answer"), "folder")
    moved = F.exists("case.plants", lambda p: F.substring("answer", p["span"][0] + 1, p["span"][1] - p["span"][0]) != p["text"])
    packages = both.join(files("package.json", "raw"), "folder").select(F.col("case.case_id").alias("pkg"), "raw")
    unreached = unreachable_sources(both, packages)
    both = both.join(unreached, F.col("case.case_id") == F.col("bad"), "left")
    told = (
        F.when(F.col("case.case_id").isNull(), "not a case document").when(moved, "a plant's text isn't what the response holds there")
        .when(F.col("bad").isNotNull(), "a plant's source isn't what an item of the package holds there")
    )
    listed = both.select(
        F.col("case.case_id").alias("audit"), F.col("case.case_id").alias("pkg"), "case.language", "case.genre", "answer",
        F.coalesce("case.expect_refusal", F.lit(False)).alias("refusal_due"), told.alias("refused"),
    )
    flat = both.where(told.isNull()).select(F.col("case.case_id").alias("audit"), "case.language", F.posexplode("case.plants").alias("plant", "p"))
    yes = lambda name, default: F.coalesce(F.col(f"p.{name}"), F.lit(default)).alias(name)
    plants = flat.select(
        "audit", "plant", "language", "p.kind", F.col("p.span")[0].alias("start"), F.col("p.span")[1].alias("end"),
        F.col("p.source.document_id").alias("source_document"), F.get("p.source.span", F.lit(0)).alias("source_start"), F.get("p.source.span", F.lit(1)).alias("source_end"),
        yes("expect_detected", True), yes("is_hallucination", True), yes("declared_miss", False), yes("expect_verdict", "floating"),
    )
    return listed.orderBy("audit"), plants.orderBy("audit", "plant"), packages


def unreachable_sources(read: DataFrame, packages: DataFrame) -> DataFrame:
    """(bad): ids of cases with a plant whose source lies in no item of the package, or where the first such item holds other text.

    ``read`` has the parsed ``case``; plants that say neither a source nor what they were aren't looked at.
    """
    from . import packages as documents

    named = read.select(F.col("case.case_id").alias("pkg"), F.posexplode("case.plants").alias("plant", "p")).where(
        F.col("p.source").isNotNull() & (F.coalesce("p.was", F.lit("")) != "")
    )
    wanted = named.select("pkg", "plant", F.col("p.was").alias("was"), F.col("p.source.document_id").alias("document_id"), F.col("p.source.span")[0].alias("a"), F.col("p.source.span")[1].alias("b"))
    items = documents.items_of(documents.read(packages)).select("pkg", "item", "document_id", "start", "end", "text")
    inside = wanted.join(items, ["pkg", "document_id"]).where("start <= a and b <= end")
    held = inside.groupBy("pkg", "plant").agg(F.min_by(F.expr("substring(text, a - start + 1, b - a)"), "item").alias("held"))
    both = wanted.join(held, ["pkg", "plant"], "left")
    return both.where(~F.col("was").eqNullSafe(F.col("held"))).select(F.col("pkg").alias("bad")).distinct()


def archived_reports(raws: DataFrame, column: str = "raw") -> DataFrame:
    """``raws`` with ``document`` (a report, taken out of its statement if it is in one), ``report`` and ``refused``."""
    statement = F.startswith(F.get_json_object(column, "$._type"), F.lit("https://in-toto.io/"))
    rows = raws.withColumn("document", F.when(statement, F.get_json_object(column, "$.predicate")).otherwise(F.col(column)))
    r = F.from_json("document", REPORT)
    contract = r["contract"]
    audited = r["audited"]
    lacking = [r["report_id"], r["answer"], audited, *(audited[c] for c in ("package_id", "response_hash", "packs", "engine_version", "matcher"))]
    refused = (
        F.when(statement & F.col("document").isNull(), "the statement has no predicate")
        .when(r.isNull() | contract.isNull(), "not a report document")
        .when(~F.endswith(F.substring_index(contract, "/", 1), F.lit(REPORT_FAMILY)) | (F.substring_index(F.substring_index(contract, "/", -1), "-", 1) != "1"), F.concat(F.lit("unknown contract "), contract))
        .when(F.exists(F.array(*(c.isNull() for c in lacking)), lambda x: x), "the report lacks a field")
    )
    return rows.withColumn("report", r).withColumn("refused", refused)
