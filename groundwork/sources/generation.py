"""Labelled cases made from marked-up documents and planted sentences, and what differs from those on disk.

``documents(genre, language, question, protected, document, document_id, source_path, section, paragraphs)``: paragraphs
mark their facts as ``{{F:name}}text{{/F}}``. ``sentences(genre, sentence, text, kind, target, fact, expect_verdict)``: the
target is the planted part of a sentence, the whole of it if null; the fact is what it was made from.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import write_text
from .corpus import strip_markup

CASE_FORMAT, PACKAGE_CONTRACT, GENERATOR = "groundwork.case/1", "groundwork.context-package/1", "groundwork.cases/1"
#: Kind of plant, whether it should be detected, is made up, is a declared miss, and the verdict it should get.
LABELS = (
    ("grounded", False, False, False, "grounded"), ("digit_drift", True, True, False, "contradicted"), ("unit_swap", True, True, False, "contradicted"),
    ("invented_particular", True, True, False, "floating"), ("entity_swap", False, True, True, "grounded"), ("negation_flip", False, True, True, "grounded"),
    ("faithful_paraphrase", False, False, False, "unbearing"), ("cross_document_stitch", False, True, True, "grounded"),
    ("derived_value", True, False, False, "floating"), ("placeholder_residue", False, False, False, "unverifiable"),
)
PARAGRAPH = "\n\n"


def paragraphs_of(documents: DataFrame) -> DataFrame:
    """(genre, document, document_id, source_path, section, start, end, text, facts): one row a paragraph, markup taken off.

    Offsets are those of the document's whole text; ``facts`` are the marked facts that lie in the paragraph.
    """
    whole = documents.withColumn("c", strip_markup(F.array_join("paragraphs", PARAGRAPH), "F"))
    pieces = F.split("c.text", PARAGRAPH, -1)
    lead = lambda k: F.aggregate(F.slice(pieces, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x) + len(PARAGRAPH))
    spans = F.transform(pieces, lambda x, k: F.struct(lead(k).alias("start"), (lead(k) + F.length(x)).alias("end"), x.alias("text")))
    rows = whole.select("genre", "document", "document_id", "source_path", "section", F.col("c.markings").alias("marks"), F.explode(spans).alias("p"))
    inside = F.filter("marks", lambda m: (F.col("p.start") <= m["start"]) & (m["end"] <= F.col("p.end")))
    return rows.select("genre", "document", "document_id", "source_path", "section", "p.start", "p.end", "p.text", inside.alias("facts"))


def facts_of(documents: DataFrame) -> DataFrame:
    """(genre, fact, was, source_document, source_start, source_end) of all marked facts."""
    rows = paragraphs_of(documents).select("genre", "document_id", F.explode("facts").alias("f"))
    return rows.select("genre", F.col("f.kind").alias("fact"), F.col("f.text").alias("was"), F.col("document_id").alias("source_document"), F.col("f.start").alias("source_start"), F.col("f.end").alias("source_end"))


def packages_of(documents: DataFrame) -> DataFrame:
    """(genre, items, omissions): paragraphs with a fact are evidence, the others are withheld."""
    order = Window.partitionBy("genre").orderBy("document", "start")
    rows = paragraphs_of(documents).withColumn("bears", F.size("facts") > 0)
    item = F.struct(
        F.format_string("itm_%02d", F.row_number().over(order)).alias("item_id"), "text",
        F.struct("document_id", "source_path", "section", "start", "end", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_hash")).alias("anchor"),
        F.struct(F.lit("fact").alias("layer"), F.lit(GENERATOR).alias("producer")).alias("provenance"),
    )
    kept = rows.where("bears").select("genre", "document", "start", item.alias("item"))
    left = rows.where("not bears").select(
        "genre", "document", "start", F.struct(F.lit("below_threshold").alias("rule"), F.lit("it holds no fact that was asked for").alias("reason"), F.struct("document_id", "start", "end").alias("anchor")).alias("omission"),
    )
    listed = lambda df, name: df.groupBy("genre").agg(F.transform(F.array_sort(F.collect_list(F.struct("document", "start", name))), lambda x: x[name]).alias(f"{name}s"))
    both = listed(kept, "item").join(listed(left, "omission"), "genre", "full_outer")
    return both.select("genre", *(F.coalesce(c, F.array().cast(dict(both.dtypes)[c])).alias(c) for c in ("items", "omissions")))


def assembled(sentences: DataFrame, documents: DataFrame, seed: int, total: int) -> DataFrame:
    """``sentences`` with case_index, at (their place in the case), start and end, every sentence in exactly one of ``total`` cases.

    The order within a genre is that of hashes with the seed; sentence n of it goes to case n modulo ``total``.
    Every third sentence of a case begins a paragraph; others follow after a space, or none where the script has none.
    """
    by_hash = Window.partitionBy("genre").orderBy(F.sha2(F.concat_ws("\n", F.lit(str(seed)), "genre", F.col("sentence").cast("string")), 256))
    languages = documents.groupBy("genre").agg(F.min("language").alias("language"))
    rows = sentences.join(languages, "genre").withColumn("n", F.row_number().over(by_hash) - 1).withColumn("case_index", (F.col("n") % total).cast("int"))
    in_case = Window.partitionBy("genre", "case_index").orderBy("n")
    placed = rows.withColumn("at", F.row_number().over(in_case) - 1)
    joiner = F.when(F.col("at") == 0, "").when(F.col("at") % 3 == 0, PARAGRAPH).when(F.col("language") == "en", " ").otherwise("")
    joined = placed.withColumn("joiner", joiner)
    end = F.sum(F.length("joiner") + F.length("text")).over(in_case.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return joined.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def _labels(kind: Column, field: int) -> Column:
    return F.coalesce(*(F.when(kind == row[0], F.lit(row[field])) for row in LABELS))


def build(documents: DataFrame, sentences: DataFrame, seed: int = 0, total: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, plants, packages) as ``corpus.cases`` gives them; the last case of a genre is held out.

    A target that doesn't stand exactly once in its sentence, or a fact that no document marks, makes the case refused.
    """
    placed = assembled(sentences, documents, seed, total)
    case_id = F.concat_ws("-", "language", "genre", F.format_string("%02d", F.col("case_index") + 1))
    rows = placed.withColumn("case_id", case_id).join(facts_of(documents), ["genre", "fact"], "left")
    target = F.coalesce("target", "text")
    times = F.size(F.split("text", F.concat(F.lit("\\Q"), target, F.lit("\\E")), -1)) - 1
    rows = rows.withColumn("bad", ((F.col("target").isNotNull() & (times != 1)) | (F.col("fact").isNotNull() & F.col("was").isNull())).cast("int"))
    at = F.col("start") + F.position(target, F.col("text")) - 1
    plants = rows.select(
        F.col("case_id").alias("audit"), F.col("at").alias("plant"), "language", "kind", at.alias("start"), (at + F.length(target)).alias("end"), target.alias("text"), "was",
        "source_document", "source_start", "source_end", _labels(F.col("kind"), 1).alias("expect_detected"), _labels(F.col("kind"), 2).alias("is_hallucination"),
        _labels(F.col("kind"), 3).alias("declared_miss"), F.coalesce("expect_verdict", _labels(F.col("kind"), 4)).alias("expect_verdict"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "joiner", "text"))), lambda s: F.concat(s["joiner"], s["text"])), "")
    answers = rows.groupBy("genre", "language", "case_index", "case_id").agg(F.concat(text, F.lit("\n")).alias("answer"), F.max("bad").alias("bad"))
    about = documents.groupBy("genre").agg(F.min("question").alias("question"), F.bool_or(F.coalesce("protected", F.lit(False))).alias("protected"))
    told = answers.join(about, "genre")
    cases = told.select(
        F.col("case_id").alias("audit"), F.col("case_id").alias("pkg"), "language", "genre", F.when(F.col("case_index") == total - 1, "held_out").otherwise("train").alias("split"),
        "answer", F.col("protected").alias("refusal_due"), F.when(F.col("bad") > 0, "a plant has no one place to stand, or no fact behind it").alias("refused"),
    )
    shield = F.when(F.col("protected"), F.struct(F.lit("redactor").alias("by"), F.col("case_id").alias("scope"), F.lit(True).alias("reversible")))
    body = F.struct(
        F.lit(PACKAGE_CONTRACT).alias("contract"), F.concat(F.lit("sha256:"), F.sha2(F.concat("case_id", "question"), 256)).alias("package_id"), F.col("question").alias("query"),
        "items", "omissions", F.struct(F.array(F.lit("generator")).alias("providers"), shield.alias("protection")).alias("provenance"),
    )
    packages = told.join(packages_of(documents), "genre").select(F.col("case_id").alias("pkg"), F.to_json(body, {"ignoreNullFields": "true"}).alias("raw"))
    return cases, plants, packages


def files_of(cases: DataFrame, plants: DataFrame, packages: DataFrame, seed: int = 0) -> DataFrame:
    """(path, body): the three files of every case, as they are written and compared."""
    span = lambda a, b: F.when(F.col(a).isNotNull(), F.array(a, b))
    plant = F.struct(
        "kind", span("start", "end").alias("span"), "text", "expect_detected", "is_hallucination", "declared_miss", "expect_verdict", "was",
        F.when(F.col("source_document").isNotNull(), F.struct(F.col("source_document").alias("document_id"), span("source_start", "source_end").alias("span"))).alias("source"),
    )
    listed = plants.groupBy("audit").agg(F.transform(F.array_sort(F.collect_list(F.struct("plant", plant.alias("p")))), lambda x: x["p"]).alias("plants"))
    manifest = F.to_json(
        F.struct(
            F.lit(CASE_FORMAT).alias("format"), F.col("audit").alias("case_id"), "language", "genre", "split", F.lit(GENERATOR).alias("generator"), F.lit(seed).alias("seed"),
            F.array(F.lit("ci")).alias("tier"), F.col("refusal_due").alias("expect_refusal"), "plants",
        )
    )
    rows = cases.join(listed, "audit", "left").join(packages, "pkg")
    each = F.array(*(F.struct(F.concat("audit", F.lit(f"/{name}")).alias("path"), body.alias("body")) for name, body in (("case.json", manifest), ("package.json", F.col("raw")), ("response.txt", F.col("answer")))))
    return rows.select(F.explode(each).alias("f")).select("f.*")


def write(files: DataFrame, root: str) -> None:
    """The files under a folder, in any store that Spark reaches; JSON is indented."""
    for path, body in files.toLocalIterator():
        shown = json.dumps(json.loads(body), ensure_ascii=False, indent=2) + "\n" if path.endswith(".json") else body
        write_text(files.sparkSession, f"{root}/{path}", shown)


def drift(made: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, problem): files that are missing, that nothing makes, or that differ; both frames are (path, body)."""
    both = made.select("path", F.col("body").alias("a")).join(stored.select("path", F.col("body").alias("b")), "path", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "not made").when(F.col("a") != F.col("b"), "differs")
    return both.select("path", problem.alias("problem")).where("problem is not null").orderBy("path")
