"""Scores, rates and floors on small labelled frames; corpora on disk; the streaming form."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from groundwork.operators import evaluation as ev
from groundwork.operators import grounding as g
from groundwork.plans import audit as plan
from groundwork.sources import corpus, generation, packages
from groundwork.streaming import answers as stream

PLANT = {"was": "", "source": None, "expect_detected": True, "is_hallucination": True, "declared_miss": False, "expect_verdict": "floating"}


def write_case(root, name, response, plants, contexts, language="en", split="train", refusal=False):
    folder = root / name
    folder.mkdir()
    plants = [PLANT | p | {"span": [response.index(p["text"]), response.index(p["text"]) + len(p["text"])]} for p in plants]
    (folder / "case.json").write_text(json.dumps({"format": "x.case/1", "case_id": name, "language": language, "genre": "g", "split": split, "tier": ["ci"], "expect_refusal": refusal, "plants": plants}))
    (folder / "response.txt").write_text(response)
    items = [{"item_id": f"i{k}", "text": t, "anchor": {"document_id": f"d{k}", "start": 0, "end": len(t)}} for k, t in enumerate(contexts)]
    (folder / "package.json").write_text(json.dumps({"contract": "x.context-package/1", "package_id": name, "items": items, "omissions": []}))


@pytest.fixture
def scored(spark, tmp_path):
    swap = {"kind": "unit_swap", "text": "12 mg", "source": {"document_id": "d0", "span": [10, 15]}, "expect_verdict": "contradicted"}
    write_case(
        tmp_path, "en-a-01", "It weighs 12 mg. It holds 77 bolts. It left in 3 days. It was 9 m long. The sum is 15 kg.",
        [swap, {"kind": "invented_particular", "text": "77"}, {"kind": "grounded", "text": "3 days", "is_hallucination": False, "expect_detected": False, "expect_verdict": "grounded"},
         {"kind": "entity_swap", "text": "9 m", "declared_miss": True, "expect_detected": False}, {"kind": "derived_value", "text": "15 kg", "is_hallucination": False}],
        ["It weighs 12 kg in all.", "It left in 3 days. It was 9 m long."],
    )
    write_case(tmp_path, "ja-b-01", "重さは5 kgです。", [{"kind": "digit_drift", "text": "5 kg"}], ["重さは5 kgです。"], language="ja")
    write_case(tmp_path, "en-c-01", "Out.", [], ["x"], split="held_out")
    cases, plants, raws = corpus.cases(spark, str(tmp_path))
    items = packages.items_of(packages.read(raws))
    _, segs, tokens = plan.audited(cases.where("refused is null").select("audit", "pkg", "answer"), items)
    cover = g.coverage(segs, "audit").select("audit", "segments", "unbearing", "unexamined", "particulars")
    per = cases.join(cover, "audit").select("audit", "language", "refusal_due", F.lit(False).alias("refused"), F.lit(True).alias("reproduced"), "segments", "unbearing", "unexamined", "particulars")
    return plants, tokens, segs, ev.tallies(ev.score_plants(plants, tokens, segs), per)


def test_plants_are_scored(scored):
    plants, tokens, _, sums = scored
    by = {(r.view, r.name): r for r in sums.collect()}
    every = by["all", "all"]
    assert (every.fabrications, every.fabrications_found, every.declared_passed, every.acknowledged_found) == (3, 2, 1, 1)
    assert (every.controls, every.false_positives, every.locatable, every.located, every.misdirected) == (1, 0, 1, 1, 0)
    assert every.cases == 2 and by["language", "ja"].fabrications_found == 0
    assert by["kind", "unit_swap"].verdicts_right == 1 and by["kind", "unit_swap"].cases is None
    assert ev.unattributed(plants, tokens).count() == 0
    assert ev.unattributed(plants.where("kind <> 'derived_value'"), tokens).count() == 1


def test_rates_and_floors(scored, spark):
    rates = ev.rates(scored[3]).where("view = 'all'")
    got = {r.metric: r.share for r in rates.collect()}
    assert got["fabrication recall"] == pytest.approx(2 / 3) and got["recall over everything planted"] == pytest.approx(2 / 4)
    assert got["refusals"] is None and got["reproducibility"] == 1.0
    checked = {r.metric: r.breached for r in ev.floors_check(rates, spark).collect()}
    assert checked["fabrication recall"] is True and checked["false positives"] is False and checked["refusals"] is None and checked["extraction precision"] is None


def test_a_plant_whose_source_holds_something_else_makes_its_case_refused(spark, tmp_path):
    swap = lambda was, span: {"kind": "unit_swap", "text": "5 mg", "was": was, "source": {"document_id": "d0", "span": span}}
    for name, was, span in (("en-a-01", "5 kg", [6, 10]), ("en-a-02", "9 kg", [6, 10]), ("en-a-03", "5 kg", [6, 40])):
        write_case(tmp_path, name, "It is 5 mg.", [swap(was, span)], ["It is 5 kg."])
    cases, plants, _ = corpus.cases(spark, str(tmp_path))
    assert [(c.audit, c.refused is None) for c in cases.collect()] == [("en-a-01", True), ("en-a-02", False), ("en-a-03", False)]
    assert {p.audit for p in plants.collect()} == {"en-a-01"}


def test_generated_cases_are_read_back_and_drift_is_told(spark, tmp_path):
    documents = spark.createDataFrame(
        [("g", "en", "What?", False, 0, "doc", "a.md", None, ["Nothing here.", "It weighs {{F:w}}12 kg{{/F}} or {{F:v}}13 kg{{/F}}.", "Nor here."])],
        "genre string, language string, question string, protected boolean, document int, document_id string, source_path string, section string, paragraphs array<string>",
    )
    rows = [("g", k, f"Box {k} weighs {12 if k % 2 else 77} kg.", "grounded" if k % 2 else "invented_particular", "12 kg" if k % 2 else "77 kg", "w" if k % 2 else None, None) for k in range(9)]
    sentences = spark.createDataFrame(rows, "genre string, sentence int, text string, kind string, target string, fact string, expect_verdict string")
    cases, plants, raws = generation.build(documents, sentences, seed=3, total=2)
    answers = {c.audit: c.answer for c in cases.collect()}
    assert len(plants.collect()) == 9 and all(answers[p.audit][p.start : p.end] == p.text for p in plants.collect())
    assert answers["en-g-01"].count("\n\n") == 1 and sorted(len(a.split("Box")) - 1 for a in answers.values()) == [4, 5]
    generation.write(generation.files_of(cases, plants, raws), str(tmp_path))
    read, told, _ = corpus.cases(spark, str(tmp_path), ("train", "held_out"))
    assert {c.audit: (c.answer, c.refused) for c in read.collect()} == {k: (v, None) for k, v in answers.items()} and told.count() == 9
    assert generation.drift(generation.files_of(cases, plants, raws), generation.files_of(cases, plants, raws)).count() == 0
    bad = generation.build(documents, sentences.withColumn("target", F.lit("kg kg")), total=1)[0].first()
    assert bad.refused is not None


def test_conflicts_counted_equal_conflicts_listed(spark):
    texts = ["It is 5 kg and 7 kg.", "It is 6 kg.", "It is 5 kg.", "It is 6 kg or 9 m."]
    items = spark.createDataFrame([(p, k, f"i{k}", f"d{k}", None, None, 0, 0, None, "", t) for p in (1, 2) for k, t in enumerate(texts[p - 1 :])], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    answers = spark.createDataFrame([(1, 1, "It is 5 kg, 6 kg and 9 m."), (2, 2, "It is 6 kg.")], "audit long, pkg long, answer string")
    _, _, tokens = plan.audited(answers, items)
    index = g.source_index(items)
    listed = {(r.audit, r.text, r.item_id): r["count"] for r in ev.source_conflict(tokens, index).groupBy("audit", "text", "item_id").count().collect()}
    assert {(r.audit, r.text, f"i{r.item}"): r.rivals for r in ev.conflict_counts(tokens, index).collect()} == listed and listed


def test_markup_comes_off_with_its_places(spark):
    text = "A {{P:quantity}}5 kg{{/P}} and\n{{P:date}}2024-01-02{{/P}}."
    got = spark.createDataFrame([(text,), ("none",), ("",)], "t string").select(corpus.strip_markup(F.col("t")).alias("c")).collect()
    assert got[0].c.text == "A 5 kg and\n2024-01-02."
    assert [(m.kind, got[0].c.text[m.start : m.end]) for m in got[0].c.markings] == [("quantity", "5 kg"), ("date", "2024-01-02")]
    assert got[1].c.text == "none" and got[1].c.markings == [] and got[2].c.text == ""


def test_extraction_is_scored(spark, tmp_path):
    (tmp_path / "en-a-01.md").write_text("It is {{P:quantity}}5 kg{{/P}} at {{P:time}}10:30 am{{/P}}. It was {{P:proper_noun}}Ada{{/P}}. And 7 more. Done.")
    (tmp_path / "zh-a-01.md").write_text("共计{{P:quantity}}3公斤{{/P}}。")
    (tmp_path / "README.md").write_text("not an answer")
    marked = corpus.marked_answers(spark, str(tmp_path))
    assert marked.where("refused is not null").count() == 0
    by = {(r.view, r.name): r for r in ev.score_extraction(marked).collect()}
    every = by["all", "all"]
    assert (every.marked, every.exact, every.overlapping, every.extracted, every.surplus) == (4, 2, 1, 4, 1)
    assert every.recall == 0.75 and every.precision == 0.75 and by["language", "zh"].recall == 1.0 and by["kind", "proper_noun"].recall == 0.0


def test_conflicting_sources_and_shared_pairs(spark):
    items = spark.createDataFrame([(1, k, f"i{k}", f"d{k}", None, None, 0, 0, None, "", t) for k, t in enumerate(["It is 5 kg and 7 kg.", "It is 6 kg.", "It is 5 kg."])], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    _, _, tokens = plan.audited(spark.createDataFrame([(1, 1, "It is 5 kg.")], "audit long, pkg long, answer string"), items)
    got = {(r.item_id, r.rival, r.rival_item) for r in ev.source_conflict(tokens, g.source_index(items)).collect()}
    assert got == {("i0", "6 kg", "i1"), ("i2", "6 kg", "i1"), ("i2", "7 kg", "i0")}
    rows = spark.createDataFrame([("weighs 5 kg", "5 kg", "It weighs 5 kg"), ("ab", "x", "cd"), ("", "", "")], "a string, v string, b string")
    shares = ev.context_overlaps(rows, "a", "b", "v").orderBy("a", ascending=False)
    assert [r.share for r in shares.collect()] == [1.0, 0.0, 0.0]
    assert ev.overlap_bins(shares).first().asDict() == {"none": 2, "to_0.1": 0, "to_0.25": 0, "to_0.5": 0, "to_1.01": 1}


def test_archived_reports(spark):
    audited = {"package_id": "", "response_hash": "sha256:x", "packs": [], "engine_version": "", "matcher": "exact"}
    good = {"contract": "x.audit-report/1-draft", "report_id": "r", "audited": audited, "answer": "a"}
    raws = [good, {"_type": "https://in-toto.io/Statement/v1", "predicate": good}, good | {"contract": "x.audit-report/2"}, {k: v for k, v in good.items() if k != "answer"}, good | {"audited": {}}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(raws)] + [(5, "junk"), (6, None)]
    got = corpus.archived_reports(spark.createDataFrame(rows, "audit long, raw string")).orderBy("audit").collect()
    assert [r.refused is None for r in got] == [True, True, False, False, False, False, False]
    assert got[1].report.report_id == "r"


def test_streamed_audits_equal_a_batch(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, "i", "d", None, None, 0, 11, None, "", "It is 5 kg.")], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    rows = spark.createDataFrame([(1, 1, "It is 5 kg."), (2, 1, "It is 6 kg.")], "audit long, pkg long, answer string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = stream.audit_stream(source, items, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("audit", "report_id", "grounded_share").collect()
    want = plan.audit(rows, items).select("audit", "report_id", "grounded_share").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
