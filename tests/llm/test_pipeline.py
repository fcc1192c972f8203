"""Pipeline stages and registered queries: hard rows, empty tables, decisions that take effect, and SQL twins."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from groundwork.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a folder with rows that stages must stand: nulls, blanks, copies, long texts."""
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    first = docs.orderBy("doc_id").first()
    prose = " ".join(f"the and of {k} that with" for k in range(40))
    near = prose.replace("17 ", "seventeen ")
    rows = [
        (9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456 !!", None, "s", 3), (None, "the and of to that with this from", None, None, None),
        (9005, prose, "en", "s", 1), (9006, near, "en", None, 1), (9007, first.text, "en", "s", 1), (9008, "the other was here and " + item.upper() + " with the rest of that", "en", "s", 1),
        (9009, "the and of that with " * 20000, None, "s", 1), (9005, prose, "en", "s", 1),
    ]
    docs.union(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{root}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return root


def test_stages_in_order_keep_columns_and_decide(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mix"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    read = lambda df: {r.doc_id: r for r in df.collect()}
    named = corpus_pipeline.language_id(spark, docs, folder)
    got = read(named)
    assert named.columns == COLUMNS and not {9001, 9002, 9003} & set(got) and {9005, 9006, 9009, None} <= set(got)
    assert {r.lang for r in got.values()} <= {"en", "de", "fr", "es"}
    lines = corpus_pipeline.line_dedup(spark, docs, folder)
    got = read(lines)
    assert lines.columns == COLUMNS and 9001 in got and all(r.text is None or r.n_chars == len(r.text) for r in got.values())
    near = corpus_pipeline.near_dedup(spark, docs, folder)
    ids = [r.doc_id for r in near.collect()]
    assert near.columns == COLUMNS and 9005 in ids and 9006 not in ids and 9007 not in ids and ids.count(9005) == 1 and ids.count(None) == 1
    clean = corpus_pipeline.decontamination(spark, docs, folder)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS and 9008 not in ids and {9001, 9002, 9005, 9009} <= ids
    mixed = corpus_pipeline.mix(spark, docs, folder)
    assert mixed.columns == [*COLUMNS, "mix_rate", "mix_copies", "mix_off"] and mixed.where("mix_copies < 1").count() == 0


def test_language_stage_rejects_a_fifth_language_and_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), n))
    strange = [
        "każdego ranka wychodzę z domu bardzo wcześnie żeby zdążyć na pociąg który jedzie do miasta gdzie pracuję od lat",
        "tänään on kaunis päivä ja lähdemme metsään kävelemään koska haluamme nähdä lintuja ja kuunnella hiljaisuutta",
        "сегодня утром мы пошли в лес чтобы собрать грибы и ягоды", letters(60), letters(300), letters(3000),
    ]
    clean = ["the and of that with", "The of it.", "THE AND OF THAT WITH", 'the and of token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" that with']
    rows = [(9100 + k, t, None, "s", 1) for k, t in enumerate(strange)] + [(9200 + k, t, None, "s", 1) for k, t in enumerate(clean)]
    got = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(rows, docs.schema)), SF).collect()}
    assert {i for i in got if i >= 9100} == {9200 + k for k in range(len(clean))}
    assert {i for i in got if i < 9100} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_is_the_stages_one_after_another(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    assert found.columns[:5] == COLUMNS and not {9001, 9002, 9003, 9008} & ids


def _rows(rows, columns):
    return sorted(tuple(map(str, (r[c] for c in columns))) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    names = [d[0] for d in want.description]
    assert _rows(got.collect(), columns) == _rows([dict(zip(names, r, strict=True)) for r in want.fetchall()], columns)


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_operators_only_use_functions_where_they_are_native(spark):
    for name in ("op2_mixing", "op6_url_filter"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert queries.op2_mixing(spark, SF).where(F.col("rate") < 0).count() == 0
