"""Steps that the registered audits share: what is worked out once, what stays off the driver, and what isn't cut."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwork import catalog, registry, runtime
from groundwork.functions import kernels
from groundwork.operators import evaluation as ev
from groundwork.operators import grounding as g
from groundwork.plans import audit as plan
from groundwork.sources import packages

SF = "/root/testdata/sf0.001"
ITEM = "pkg int, item int, item_id string, document_id string, source_path string, section string, start int, end int, layer string, producer string, text string"


def _items(spark, texts, pkg=1):
    return spark.createDataFrame([(pkg, k, f"i{k}", f"d{k}", None, None, 0, len(t), None, "", t) for k, t in enumerate(texts)], ITEM)


def _segs(spark, *answers):
    rows = spark.createDataFrame([(k, 1, a) for k, a in enumerate(answers)], "audit int, pkg int, answer string")
    return plan.segments_of(plan.admit(rows))


def test_f26_conflicts_beyond_32_documents_are_counted(spark):
    """A value that stands in 40 documents has rivals in all of them."""
    items = _items(spark, ["It is 7 kg."] * 40 + ["It is 8 kg."])
    tokens = g.placed_tokens(_segs(spark, "It is 7 kg."), items, capped=False)
    assert ev.conflict_counts(tokens, g.source_index(items)).agg(F.sum("rivals"), F.count("*")).first() == (40, 40)


def test_f8_reports_meet_without_a_broadcast(spark):
    """Small as it looks to the planner, no side of a report's joins goes through the driver."""
    answers = spark.createDataFrame([(1, 1, "It is 7 kg. It is 9 m."), (2, 1, "It is 8 kg.")], "audit int, pkg int, answer string")
    plans = plan.audit(answers, _items(spark, ["It is 7 kg."]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plans and "SortMergeJoin" in plans


def test_f13_texts_stay_beside_their_segments(spark):
    assert "Join" not in registry.QUERIES["segment_tiling_violations"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_f7_a_text_that_a_batch_repeats_is_cut_once(monkeypatch):
    cut, run = [], []
    monkeypatch.setattr(kernels, "segments_with_tokens", lambda text, *how: cut.append(text) or [])
    monkeypatch.setattr(kernels.F, "arrow_udf", lambda f, kind: run.append(f))
    kernels.segment_function()
    assert run[0](pa.array(["a.", None, "b.", "a."])).to_pylist() == [[], None, [], []] and cut == ["a.", "b."]


@pytest.mark.parametrize("more", [0, g.FEW])
def test_few_and_many_forms_of_a_package_find_the_same(spark, more):
    """Forms that go to all items of their package, and forms that meet items by their words."""
    answer = " ".join(["It is 7 kg, ２.5 m on 2024-01-02 for $1,200."] + [f"It holds {k + 1000} bolts." for k in range(more)])
    items = _items(spark, ["It is 7 kg.", "It is 17 kg. 2.5 m", "On 2024-01-02 it cost $1,200 or ７ kg.", "Nothing."])
    found = g.placed_tokens(_segs(spark, answer), items).where("seg = 0").select("text", F.transform("locations", lambda x: x["item"]).alias("at")).collect()
    assert {r.text: r["at"] for r in found} == {"7 kg": [0, 2], "２.5 m": [1], "2024-01-02": [2], "$1,200": [2]}


def test_f6_contradictions_are_the_same_with_and_without_neighbours(spark):
    """Items that hold no floating token's digits aren't cut, which changes no verdict."""
    segs = _segs(spark, "It is 7 mg.", "It is 8 kg and 5 mg.", "It is 9 mg.", "It is ３ mg.")
    items = _items(spark, ["It is 7 kg.", "It is 5 kg and 8 kg.", "It is 5 t.", "It is ９ kg.", "It is 3 kg.", "Nothing."])
    told = [
        {(r.audit, r.tok, r.c) for r in g.checked_tokens(segs, items, neighbours=near).select("audit", "tok", F.col("contradiction.text").alias("c")).collect()} for near in (True, False)
    ]
    assert told[0] == told[1] and {c for _, _, c in told[0]} >= {"7 kg", "９ kg"}


def test_f18_documents_compared_in_a_row_equal_their_leaves_joined(spark):
    kind = "audit int, document string"
    a = spark.createDataFrame([(1, json.dumps({"a": [1, {}], "b": None})), (2, "[]"), (3, '{"x": 1}')], kind)
    b = spark.createDataFrame([(1, json.dumps({"a": [2, {}, 3]})), (2, "[]"), (4, '{"x": 1}')], kind)
    assert plan.recheck_documents(a, b).collect() == plan.recheck(plan.leaves(a), plan.leaves(b)).collect() != []


def test_f35_refusals_need_no_audit(spark):
    rows = [(1, "", ["x"]), (2, "It is 5 kg.", ["It is 5 kg."]), (3, "Paid to <PERSON_1>.", ["x"]), (4, None, ["x"]), (5, "a", [" "])]
    frame = spark.createDataFrame(rows, "audit long, answer string, contexts array<string>")
    assert sorted(plan.refusals(frame).collect()) == sorted(plan.evaluate_frame(frame)[1].collect())
    assert "MapInArrow" not in (text := plan.refusals(frame)._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in text


def test_f30_deep_packages_are_refused_still(spark):
    raws = [(1, "[" * 70 + "]" * 70), (2, json.dumps({"contract": "x.context-package/1", "package_id": "p", "items": [], "query": "[" * 70}))]
    assert [r.refused for r in packages.read(spark.createDataFrame(raws, "pkg int, raw string")).orderBy("pkg").collect()] == ["the document is nested too deeply", None]


def test_f25_passages_inside_words_and_with_other_white_space(spark, tmp_path):
    """The SQL holds a passage for a literal: inside a word too, and only plain white space is one with a space."""
    docs = ["xThe quick  brown\nfox jumps", "the quick brown foxes", "the quick\u00a0brown fox", "the quick brown", "a ½ b", "a 1⁄2 b", "ab", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(1, "The quick brown FOX"), (2, "quick brown"), (3, "B"), (4, "a 1⁄2 b")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["benchmark_in_documents"]).fetchall())
    assert sorted(map(tuple, catalog.benchmark_in_documents(spark, str(tmp_path)).collect())) == want


def test_what_no_plan_holds_is_removed(spark):
    import gc
    import os

    held = runtime.stored(spark.range(5))
    at = held.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(at) and held.count() == 5
    derived = held.where("id > 1")
    del held
    gc.collect()
    spark._jvm.System.gc()
    runtime.stored(spark.range(1))
    assert derived.count() == 3
