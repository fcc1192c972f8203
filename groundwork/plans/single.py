"""One answer at a time, from documents in memory: what the command line and the server share."""

from __future__ import annotations

import json

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .. import problems, sinks
from ..sources import corpus, packages, samples
from . import audit as plan

VERSION = "1"
_SHIELD = "struct<by:string,scope:string,reversible:boolean>"


class Refused(Exception):
    """What can't be audited, and why."""


def _shield(found: Row | None):
    if found is None:
        return F.lit(None).cast(_SHIELD)
    return F.struct(F.lit(found["by"]).alias("by"), F.lit(found["scope"]).alias("scope"), F.lit(found["reversible"]).alias("reversible")).cast(_SHIELD)


def audit_one(
    spark: SparkSession,
    answer: str | None,
    *,
    package: str | None = None,
    sample: dict | None = None,
    record: str | None = None,
    settings: problems.Settings,
    restored_by: str | None = None,
) -> Row:
    """The report of one answer against a package document or a sample of contexts, with a protection record if there is one."""
    omissions, unread, protection, package_id = None, [], None, ""
    if package is None:
        told = {k: v for k, v in (sample or {}).items() if answer is None or k not in samples.ANSWERS} | ({} if answer is None else {"answer": answer})
        rows = samples.resolve(spark.read.json(spark.sparkContext.parallelize([json.dumps(told | {"audit": 0})])))
        first = rows.first()
        if first.refused:
            raise Refused(first.refused)
        items, answer = samples.items_of(rows), first.answer
    else:
        read = packages.read(spark.createDataFrame([(0, package)], "pkg long, raw string"))
        first = read.select("refused", "package.package_id", F.col("package.provenance.protection").alias("protection"), "unrecognised").first()
        if first.refused:
            raise Refused(first.refused)
        items, omissions = packages.items_of(read), packages.omissions_of(read)
        unread, protection, package_id = first.unrecognised, first.protection, first.package_id or ""
    recorded = None
    if record is not None:
        recorded = spark.createDataFrame([(record,)], "raw string").select(packages.protection_record(F.col("raw")).alias("r")).first().r
        if recorded.refused:
            raise Refused(recorded.refused)
    answers = spark.createDataFrame([(0, 0, answer, package_id, restored_by, list(unread))], "audit long, pkg long, answer string, package_id string, restored_by string, unrecognised array<string>")
    answers = answers.withColumn("protection", _shield(protection)).withColumn("record", _shield(recorded))
    made = plan.audit(answers, items, omissions, codes=settings.languages, matcher=settings.matcher, version=VERSION, plain=package is None).first()
    if made.refused:
        raise Refused(made.refused)
    return made


def archived(spark: SparkSession, raw: str) -> dict:
    """A report document, taken out of its statement if it is in one."""
    row = corpus.archived_reports(spark.createDataFrame([(0, raw)], "audit long, raw string")).first()
    if row.refused:
        raise Refused(row.refused)
    return json.loads(row.document)


def recheck_one(spark: SparkSession, raw: str, answer: str | None = None, **inputs) -> list[Row]:
    """Differences between an archived report and the one that its packs and matcher give now, over its own answer if none is given."""
    old = archived(spark, raw)
    if answer is not None and answer != old["answer"]:
        raise Refused("the report was made over another answer")
    again = problems.Settings(matcher=old["audited"]["matcher"], languages=tuple(old["audited"]["packs"]))
    fresh = audit_one(spark, old["answer"], settings=again, **inputs)
    if fresh.audited.package_id != old["audited"]["package_id"]:
        raise Refused("the report was made over another package")
    new = json.dumps(sinks.report_document(fresh.asDict(True)), ensure_ascii=False, default=str)
    frame = lambda text: spark.createDataFrame([(0, text)], "audit long, document string")
    return plan.recheck(plan.leaves(frame(json.dumps(old, ensure_ascii=False))), plan.leaves(frame(new))).collect()
