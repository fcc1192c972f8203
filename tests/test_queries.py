"""Registered queries against their SQL at the smallest size; those that audit every order answer are left to larger runs."""

from __future__ import annotations

import duckdb
import pytest

from groundwork import catalog, catalog_made, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = (
    "script_of_documents", "line_kinds_documents", "benchmark_in_documents", "grounded_share_pooled", "admission_outcomes", "markup_documents", "locations_orders", "unverifiable_orders",
    "languages_orders", "sources_cap_orders", "claims_cap_suppliers", "unjudgeable_suppliers", "package_refusals", "package_omissions", "protection_records", "archived_reports",
    "unreachable_sources_orders", "generated_plants", "generated_packages", "generated_drift", "corpus_cases", "draft_triage", "error_catalogue", "tokens_golden", "segments_golden", "folds_golden", "places_golden",
)


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    columns = sorted(names)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda listed: sorted(tuple(map(str, (r[c] for c in columns))) for r in listed)
    assert rows(got.collect()) == rows([dict(zip(names, r, strict=True)) for r in want.fetchall()])
