"""Command line: audits of a package or of plain contexts, and what can be done with a report.

Exit codes: 0 audited, 1 can't be audited, 2 wrong arguments, 3 audited with findings (if asked for), 4 a floor was
breached (if asked for), 5 a report comes out differently when derived again.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from . import problems, server, sinks
from .operators import evaluation as ev
from .operators import grounding as g
from .plans import audit as plan
from .plans import single
from .plans.single import Refused
from .sources import corpus, packages

#: Differences and notes that are printed at most.
DIFFERENCES, NOTES = 40, 25


def _text(path: str | None) -> str | None:
    return None if path is None else Path(path).read_text(encoding="utf-8")


def _evidence(args: argparse.Namespace) -> dict:
    """What an audit reads besides the answer: a package, or a file of contexts or of a whole sample."""
    if args.package is not None:
        return {"package": _text(args.package), "record": _text(args.protection)}
    body = json.loads(_text(args.contexts))
    return {"sample": body if isinstance(body, dict) else {"contexts": body}, "record": _text(args.protection)}


def archived(spark: SparkSession, path: str) -> dict:
    """A report document from a file."""
    return single.archived(spark, _text(path))


def extraction_rows(spark: SparkSession, folder: str) -> list[Row]:
    """Scores of extraction against the marked answers of a folder."""
    marked = corpus.marked_answers(spark, folder)
    if bad := marked.where("refused is not null").take(1):
        raise Refused(f"{bad[0].name}: {bad[0].refused}")
    return ev.score_extraction(marked).orderBy("view", "name").collect()


def evaluate(spark: SparkSession, root: str, splits: tuple[str, ...], extraction: list[Row] = ()) -> tuple[list[Row], list[Row], list[str]]:
    """(rates, floors, notes) of a folder of cases; with scores of extraction, its floors are held against those.

    Notes tell of cases that couldn't be read and of tokens that float though nothing was planted there.
    """
    cases, plants, raws = corpus.cases(spark, root, splits)
    read = packages.read(raws)
    shield = read.select("pkg", F.col("package.provenance.protection").alias("protection"))
    answers = cases.where("refused is null").join(shield, "pkg", "left").select("audit", "pkg", "answer", "protection", "language", "refusal_due")
    admitted, segs, tokens = plan.audited(answers, packages.items_of(read))
    cover = g.coverage(segs, "audit").select("audit", "segments", "unbearing", "unexamined", "particulars")
    per = admitted.join(cover, "audit", "left").select(
        "audit", "language", "refusal_due", F.col("refused").isNotNull().alias("refused"), F.lit(True).alias("reproduced"), "segments", "unbearing", "unexamined", "particulars"
    )
    live = plants.join(admitted.where("refused is null").select("audit"), "audit", "left_semi")
    rates = ev.rates(ev.tallies(ev.score_plants(live, tokens, segs), per))
    measured = rates.where("view = 'all'").select("metric", "share")
    if every := [r for r in extraction if r.view == "all"]:
        names = {"extraction recall on claimed kinds": every[0].recall, "extraction precision": every[0].precision, "unbearing segments": every[0].unbearing_share}
        told = spark.createDataFrame(list(names.items()), "metric string, share double")
        measured = measured.join(told, "metric", "left_anti").unionByName(told)
    stray = ev.unattributed(live, tokens).orderBy("audit", "seg", "tok").select("audit", "text").limit(NOTES + 1).collect()
    notes = [f"{c.audit}: {c.refused}" for c in cases.where("refused is not null").collect()] + [f"{t.audit}: {t.text!r} floats and nothing was planted there" for t in stray]
    return rates.orderBy("view", "name", "metric").collect(), ev.floors_check(measured, spark).orderBy("metric").collect(), notes


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="groundwork")
    sub = top.add_subparsers(dest="command", required=True)
    audit = sub.add_parser("audit", help="audit one answer")
    for p in (audit, sub.add_parser("recheck", help="derive a report again and compare")):
        p.add_argument("--package")
        p.add_argument("--contexts")
        p.add_argument("--protection", help="a protection record")
        p.add_argument("--restored-by")
    audit.add_argument("--response")
    audit.add_argument("--matcher")
    audit.add_argument("--languages", type=lambda x: x.split(","))
    audit.add_argument("--format", choices=("json", "text", "page", "statement"), default="text")
    audit.add_argument("--fail-on-findings", action="store_true", default=None)
    sub.choices["recheck"].add_argument("report")
    score = sub.add_parser("eval", help="score audits of a labelled corpus")
    score.add_argument("root")
    score.add_argument("--split", action="append")
    score.add_argument("--gate", action="store_true")
    score.add_argument("--marked", help="a folder of marked answers")
    score.add_argument("--json", action="store_true")
    told = sub.add_parser("explain", help="one segment of a report, from the report alone")
    told.add_argument("report")
    told.add_argument("--segment")
    told.add_argument("--particular")
    page = sub.add_parser("certificate", help="a report as a page")
    page.add_argument("report")
    page.add_argument("--out")
    page.add_argument("--force", action="store_true")
    sub.add_parser("errors", help="kinds of refusal").add_argument("--by", required=True)
    sub.add_parser("doctor", help="what is installed")
    sub.add_parser("serve", help="answer JSON-RPC requests, one a line")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "errors":
        for r in problems.catalogue(spark, args.by).collect():
            print(json.dumps(r.asDict()))
        return 0
    if args.command == "serve":
        return server.serve(spark)
    if args.command == "eval":
        extraction = extraction_rows(spark, args.marked) if args.marked else []
        rates, floors, notes = evaluate(spark, args.root, tuple(args.split or ("train",)), extraction)
        breached = [f for f in floors if f.breached]
        if args.json:
            print(json.dumps({"rates": [x.asDict() for x in rates], "extraction": [x.asDict() for x in extraction], "floors": [x.asDict() for x in floors]}, ensure_ascii=False, indent=2))
            return 4 if args.gate and breached else 0
        for x in rates:
            print(f"{x.view} {x.name} {x.metric}: {x.hits}/{x.total}")
        for x in extraction:
            print(f"extraction {x.view} {x.name}: {(x.exact or 0) + (x.overlapping or 0)}/{x.marked} found, {x.exact}/{x.marked} to the character")
        for f in floors:
            print(f"floor {f.metric}: {'nothing to measure' if f.share is None else format(f.share, '.3f')}, {'at least' if f.at_least else 'at most'} {f.bound}")
        for note in notes[:NOTES]:
            print(f"note {note}")
        if len(notes) > NOTES:
            print("and more notes")
        for f in breached:
            print(f"breached: {f.metric} is {f.share:.3f}, the bound {f.bound}")
        return 4 if args.gate and breached else 0
    if args.command == "explain":
        row = sinks.report_row(archived(spark, args.report))
        if args.segment is None:
            print("\n".join(["give a segment with --segment; findings:", *(f"  {x}" for x in sinks.findings(row) or ["none"])]))
        else:
            print(sinks.explanation(row, args.segment, args.particular), end="")
        return 0
    if args.command == "certificate":
        made = sinks.page(sinks.report_row(archived(spark, args.report)))
        if args.out is None:
            print(made, end="")
        elif Path(args.out).exists() and not args.force:
            raise Refused(f"{args.out} exists; give --force to replace it")
        else:
            Path(args.out).write_text(made, encoding="utf-8", newline="\n")
        return 0
    if (args.package is None) == (args.contexts is None):
        raise ValueError("give a package or contexts")
    if args.command == "recheck":
        differences = single.recheck_one(spark, _text(args.report), restored_by=args.restored_by, **_evidence(args))
        for d in differences[:DIFFERENCES]:
            print(f"{d.path}: {d.archived} -> {d.fresh}")
        if more := len(differences[DIFFERENCES:]):
            print(f"and {more} more")
        return 5 if differences else 0
    if args.response is None and args.package is not None:
        raise ValueError("a package needs --response")
    settings = problems.settings(matcher=args.matcher, languages=args.languages, fail_on_findings=args.fail_on_findings)
    r = single.audit_one(spark, _text(args.response), settings=settings, restored_by=args.restored_by, **_evidence(args)).asDict(True)
    show = {
        "json": lambda: json.dumps(sinks.report_document(r), ensure_ascii=False, indent=2), "text": lambda: sinks.text_report(r), "page": lambda: sinks.page(r),
        "statement": lambda: json.dumps(sinks.statement(r, args.response or "answer"), ensure_ascii=False),
    }
    print(show[args.format]())
    return 3 if settings.fail_on_findings and sinks.findings(r) else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    if args.command == "doctor":
        print("\n".join(f"{k}: {v}" for k, v in problems.doctor().items()))
        return 0
    try:
        return run(spark or SparkSession.builder.appName("groundwork").getOrCreate(), args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    except (Refused, OSError) as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
