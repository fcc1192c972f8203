"""Audits of small frames, against what the texts say and against plain loops."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from groundwork import sinks, testing
from groundwork.operators import grounding as g
from groundwork.plans import audit as plan
from groundwork.plans import results
from groundwork.sources import packages


def report_of(spark, answer, contexts, **options):
    return testing.evaluate(spark, answer=answer, contexts=contexts, **options)


def test_verdicts_of_one_answer(spark):
    answer = "It weighs 12 kg. It holds 99 bolts. It weighs 30 mg. Fine words. \n\n```\nx = 5\n```"
    r = report_of(spark, answer, ["The crate weighs 12 kg and was built in 2020.", "The box weighs 30 kg."])
    assert [s.verdict for s in r.segments] == ["grounded", "floating", "contradicted", "unbearing", "unchecked"]
    assert r.segments[2].tokens[0].contradiction.text == "30 kg"
    assert (r.particulars.grounded, r.particulars.floating) == (1, 2) and r.grounded_share == pytest.approx(1 / 3)
    assert {u.rule for u in r.unchecked} == {"no_particulars", "not_prose"}
    assert r.answer[r.segments[0].tokens[0].start : r.segments[0].tokens[0].end] == "12 kg"


def test_reports_are_the_same_twice_and_ids_follow_the_answer(spark):
    one, two, other = (report_of(spark, a, ["It is 5 kg."]) for a in ("It is 5 kg.", "It is 5 kg.", "It is 6 kg."))
    assert one == two and one.report_id != other.report_id


def test_more_evidence_never_unsettles_a_token(spark):
    few, more = report_of(spark, "It is 5 kg.", ["It is 5 kg."]), report_of(spark, "It is 5 kg.", ["No.", "It is 5 kg.", "It is 6 kg."])
    assert few.grounded_share == more.grounded_share == 1.0


def test_bounds_are_told(spark):
    r = report_of(spark, "It is 7 kg. " + "1" * 300 + ".", ["7 kg, " * 40])
    assert {b.name for b in r.bounds} == {"MAX_RUN", "LOCATION_LIMIT"}
    many = report_of(spark, "It is 7 kg.", ["It is 7 kg."] * 40)
    assert len(many.segments[0].tokens[0].locations) == 32 and [b.name for b in many.bounds] == ["SOURCE_LIMIT"]


def _reference(tokens, index, near, most):
    """Contradiction and neighbours by plain loops over one package."""
    told, around = {}, {}
    for t in tokens:
        if t["locations"]:
            continue
        key = (t["audit"], t["seg"], t["tok"])
        sentences = {(n["item"], n["s_start"], n["s_end"]) for n in near if (n["audit"], n["seg"]) == key[:2]}
        items = {i for i, _, _ in sentences}
        scope = lambda e: 0 if (e["item"], e["s_start"], e["s_end"]) in sentences else 1 if e["item"] in items else 2  # noqa: B023, E731
        mine = [e for e in index if e["pkg"] == t["pkg"] and e["kind"] == t["kind"]]
        units = [e for e in mine if t["digits"] and e["digits"] == t["digits"] and e["shape"] != t["shape"]]
        for k in range(3):
            inside = [e for e in units if scope(e) <= k]
            if len(inside) == 1:
                told[key] = (inside[0]["text"], inside[0]["item"])
            if inside:
                break
        others = sorted((scope(e), e["item"], e["entry"], e["text"]) for e in mine if e["text"] != t["text"])
        around[key] = [(x[1], x[3]) for x in others[:most]]
    return told, {k: v for k, v in around.items() if k not in told and v}


def test_explanations_and_neighbours_equal_plain_loops(spark):
    facts = ["Box {0} weighs {1} kg. It left in {2} days. It is {1} cm long.", "In {2} days box {0} weighs {1} g."]
    items = [
        (p, i, f"itm{i}", f"doc{i}", None, None, 0, 0, "fact", "x", facts[(p + i) % 2].format(i, (i * 7) % 23, (i * 3) % 11))
        for p, n in ((0, 3), (1, 40), (2, 1)) for i in range(n)
    ]
    made = spark.createDataFrame(items, "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    rows = [(10 * p + k, p, f"It weighs {w} kg and left in {d} days. It weighs {w} mg. It is {w} m or {w + 50} kg.") for p in range(3) for k, (w, d) in enumerate([(7, 3), (14, 90), (88, 6)])]
    answers = spark.createDataFrame(rows, "audit long, pkg long, answer string")
    _, segs, tokens = plan.audited(answers, made)
    index = g.source_index(made)
    near = g.neighbourhood(tokens, index)
    told, around = _reference(*([r.asDict(True) for r in df.collect()] for df in (tokens, index, near)), 5)
    got = {(t.audit, t.seg, t.tok): t for t in tokens.collect()}
    assert {k: (t.contradiction.text, int(t.contradiction.item_id[3:])) for k, t in got.items() if t.contradiction} == told
    assert {k: [(int(x.item_id[3:]), x.text) for x in t.nearby] for k, t in got.items() if t.nearby} == around
    short = g.nearby(tokens.join(g.explain(tokens, index, near), ["audit", "seg", "tok"], "left_anti"), index, near, front=3)
    assert {(t.audit, t.seg, t.tok): [(int(x.item_id[3:]), x.text) for x in t.nearby] for t in short.collect()} == around


def test_datasets_keep_refused_rows_apart(spark):
    rows = [(1, "It is 5 kg.", ["It is 5 kg."]), (2, None, ["x"]), (3, " ", ["x"]), (4, "a", []), (5, "a", [" ", None]), (6, "It is 6 kg, not 5 kg.", ["It is 5 kg.", " "])]
    reports, refused = plan.evaluate_frame(spark.createDataFrame(rows, "audit long, response string, retrieved_contexts array<string>"))
    assert {r.audit for r in refused.collect()} == {2, 3, 4, 5}
    share = plan.pooled(reports).first()
    assert (share.answers, share.scored, share.grounded, share.floating) == (2, 2, 2, 1)


def test_an_empty_dataset_gives_no_reports(spark):
    reports, refused = plan.evaluate_frame(spark.createDataFrame([], "audit long, answer string, contexts array<string>"))
    assert reports.count() == refused.count() == 0
    assert plan.pooled(reports).first().grounded_share is None


def test_admission(spark):
    shield = "struct<by:string,scope:string,reversible:boolean>"
    residue = "Paid to <PERSON_1>."
    grid = list(itertools.product([None, True, False], ["Paid.", residue], [None, "Paid to Ada."], [None, "someone"]))
    rows = [(i, 0, text, None if back is None else ("r", "names", back), restored, by) for i, (back, text, restored, by) in enumerate(grid)]
    got = plan.admit(spark.createDataFrame(rows, f"audit long, pkg long, answer string, protection {shield}, restored string, restored_by string")).collect()
    for r, (back, text, restored, by) in zip(sorted(got, key=lambda r: r.audit), grid, strict=True):
        bad = (restored and by) or (back is None and text == residue) or (back and not restored and not by)
        assert (r.refused is not None) == bool(bad), (back, text, restored, by, r.refused)
        if back and restored and not by:
            assert r.text == restored and r.restored_by == "r" and not r.asserted


def test_unverifiable_segments(spark):
    rows = [(1, 1, "Paid 5 kg to <PERSON_1>. It is 5 kg.", ("r", "names", False))]
    answers = spark.createDataFrame(rows, "audit long, pkg long, answer string, protection struct<by:string,scope:string,reversible:boolean>")
    items = spark.createDataFrame([(1, 0, "i", "d", None, None, 0, 11, None, "", "It is 5 kg.")], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    r = plan.audit(answers, items, plain=False).first()
    assert [s.verdict for s in r.segments] == ["unverifiable", "grounded"] and plan.IRREVERSIBLE_LIMIT in r.limits


def test_packages_are_validated(spark):
    def package(**change):
        item = {"item_id": "a", "text": "abc", "anchor": {"document_id": "d", "start": 2, "end": 5}} | change.pop("item", {})
        return json.dumps({"contract": "x.context-package/1-draft", "package_id": "p", "items": [item, *change.pop("more", [])], "omissions": []} | change)

    raws = {
        "good": package(extra=1), "major": package(contract="x.context-package/2"), "other": package(contract="y/1"), "length": package(item={"text": "abcd"}),
        "back": package(item={"anchor": {"document_id": "d", "start": 5, "end": 2}}), "layer": package(item={"provenance": {"layer": "guess"}}),
        "twice": package(more=[{"item_id": "a", "text": "", "anchor": {"document_id": "d", "start": 0, "end": 0}}]), "json": "nothing", "deep": "[" * 70 + "]" * 70,
        "number": package(item={"text": 123}), "flag": package(item={"anchor": {"document_id": "d", "start": True, "end": 5}}),
        "shield": package(provenance={"protection": {"by": "r", "scope": "s", "reversible": "true"}}),
    }
    read = packages.read(spark.createDataFrame(list(raws.items()), "pkg string, raw string")).cache()
    assert {r.pkg for r in read.where("refused is null").collect()} == {"good"}
    assert read.where("pkg = 'good'").first().unrecognised == ["extra"]
    assert {r.pkg: r.refused for r in read.collect()}["number"].startswith("items[0].text")
    told = read.where("pkg = 'good'").first()
    assert told.declares_protection is False
    assert [r.text for r in packages.items_of(read).collect()] == ["abc"]


def test_sinks_and_recheck(spark):
    contexts = ["It weighs 12 kg. <b>"]
    r = report_of(spark, "It weighs 12 mg & more. It has 4 feet.", contexts)
    document = sinks.report_document(r.asDict(True))
    assert json.loads(json.dumps(document))["counts"]["segments"]["contradicted"] == 1
    assert sinks.findings(r.asDict(True)) == ["seg_001", "seg_002"]
    told = sinks.explanation(r.asDict(True), "seg_001", "12 mg")
    assert "12 kg" in told and "contradicted" in told
    with pytest.raises(ValueError):
        sinks.explanation(r.asDict(True), "seg_009")
    page = sinks.page(r.asDict(True))
    assert "&amp;" in page and "<b>" not in page
    statement = sinks.statement(r.asDict(True), "answer.txt")
    assert statement["subject"][0]["digest"] == {"sha256": r.audited.response_hash.split(":")[1]}
    old, new = (spark.createDataFrame([(1, json.dumps(d))], "audit long, document string") for d in (document, document | {"report_id": "x"}))
    assert [(d.path, d.fresh) for d in plan.recheck(plan.leaves(old), plan.leaves(new)).collect()] == [("report_id", '"x"')]
    assert plan.recheck(plan.leaves(old), plan.leaves(old)).count() == 0


def test_claims_and_judging(spark):
    reports, _ = plan.evaluate_frame(spark.createDataFrame([(1, "It is 5 kg. It is 9 m. Plain words.", ["It is 5 kg."])], "audit long, answer string, contexts array<string>"))
    assert [(c.n, c.particular) for c in plan.claims(reports).orderBy("n").collect()] == [(1, "9 m"), (2, None)]
    assert plan.claims(reports, with_grounded=True).count() == 3
    contexts = spark.createDataFrame([(1, 0, "0.1"), (1, 1, "0.9"), (1, 2, "0.9")], "audit long, item long, premise string")
    judged = plan.judge(plan.claims(reports), contexts, lambda premise, claim: premise.cast("double")).collect()
    assert {(j.standing, j.item) for j in judged} == {("supported", 1)}
    rows = plan.judge(plan.claims(reports), contexts, lambda premise, claim: premise.cast("double"), model="m", scope="English only")
    whole = plan.with_judgements(reports, rows, plan.claims(reports)).first()
    assert [j.standing for j in whole.judged] == ["supported", "supported"] and whole.limits[-1] == "English only" and whole.report_id == reports.first().report_id
    assert "Judged by a model" in sinks.text_report(whole.asDict(True)) and "MAX_CLAIMS" not in {b.name for b in whole.bounds}
    assert plan.with_judgements(reports, rows.where("false")).first().judged == []
    with pytest.raises(ValueError):
        plan.judge(plan.claims(reports), contexts, lambda premise, claim: premise, supported=0.2, unsupported=0.5)


def test_assertions(spark):
    good = {"answer": "It is 5 kg, not 6 kg.", "contexts": ["It is 5 kg."]}
    assert testing.assert_grounded(spark, at_least=0.5, **good).grounded_share == 0.5
    assert testing.assert_grounded(spark, at_least=1, allow_floating=["6 kg"], **good)
    for bad in ({"at_least": 0.6}, {"at_least": 0.5, "allow_floating": ["5 kg"]}):
        with pytest.raises(testing.GroundingError):
            testing.assert_grounded(spark, **bad, **good)
    with pytest.raises(testing.GroundingError):
        testing.assert_grounded(spark, answer="Words.", contexts=["Words."], at_least=0.1)


def test_script_labels_agree_with_the_query_form(spark):
    from groundwork.functions.segmenting import script_of
    from groundwork.functions.kernels import folded
    from groundwork.functions.folding import fold

    texts = ["Straße １２", "plain  TEXT\t1", "かな", " a ", "", "Ａ b", "\x1c x \x1f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded(F.col("t")).alias("f")).collect()
    assert all(r.f == fold(r.t).text for r in rows) and script_of("かな") == "ja"


def test_results_of_a_report(spark):
    rows = [(1, "It is 5 kg. It is 6 kg and 6 kg. Fine words.", ["It is 5 kg and 9 m.", "Again 5 kg."])]
    reports, _ = plan.evaluate_frame(spark.createDataFrame(rows, "audit long, answer string, contexts array<string>"))
    got = results.accessors(reports).first()
    assert (got.grounded, got.floating, got.nearby) == (["5 kg"], ["6 kg", "6 kg"], {"6 kg": ["5 kg", "9 m", "5 kg"]})
    assert got.unchecked == ["seg_003: no_particulars"] and got.has_findings and got.examined == 3
    traced = results.traced(reports).collect()
    assert [(t.text, t.places) for t in traced] == [("5 kg", ["context 1[6:10]", "context 2[6:10]"])]
    assert results.summaries(reports).first().summary == "1 of 3 segments not checked; 1 of 3 tokens grounded; 1 findings"


def test_published_documents_become_rows_again(spark):
    r = report_of(spark, "It weighs 12 mg & more. It has 4 feet. It is 5 kg.", ["It weighs 12 kg.", "It is 5 kg."]).asDict(True)
    again = sinks.report_row(json.loads(json.dumps(sinks.report_document(r))))
    assert sinks.page(again) == sinks.page(r) and sinks.text_report(again) == sinks.text_report(r)
    assert sinks.explanation(again, "seg_001") == sinks.explanation(r, "seg_001")
    assert all(title in sinks.text_report(r) for title in ("Not checked", "Findings", "Traced", "Coverage", "Provenance", "Limits"))


def test_tokens_without_words_meet_items_by_their_text(spark):
    answers = spark.createDataFrame([(1, 1, "主治医师为李医生。重5公斤。")], "audit long, pkg long, answer string")
    items = spark.createDataFrame([(1, k, f"i{k}", f"d{k}", None, None, 0, 9, None, "", t) for k, t in enumerate(["李医生来了。", "重5公斤。", "王"])], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    _, _, tokens = plan.audited(answers, items)
    assert {t.text: [x.item for x in t.locations] for t in tokens.collect()} == {"李": [0], "5公斤": [1]}


def test_shares_without_reports_equal_those_of_reports(spark):
    answers = spark.createDataFrame([(1, 1, "It is 5 kg. It is 6 kg."), (2, 1, "Words."), (3, 2, "It is 5 kg.")], "audit long, pkg long, answer string")
    items = spark.createDataFrame([(1, 0, "i", "d", None, None, 0, 11, None, "", "It is 5 kg.")], "pkg long, item int, item_id string, document_id string, source_path string, section string, start int, `end` int, layer string, producer string, text string")
    rows = plan.shares(answers, items)
    assert {tuple(r) for r in rows.collect()} == {(1, 1, 1), (2, 0, 0), (3, 0, 1)}
    assert plan.pooled_shares(rows).first() == plan.pooled(plan.audit(answers, items)).first()
