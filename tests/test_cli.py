"""The command line's results and exit codes, refusals, settings."""

from __future__ import annotations

import json

import pytest

from groundwork import cli, problems


@pytest.fixture
def files(tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body))
        return str(tmp_path / name)

    item = {"item_id": "i", "text": "It is 5 kg.", "anchor": {"document_id": "d", "start": 0, "end": 11}}
    package = {"contract": "x.context-package/1", "package_id": "p", "items": [item], "omissions": [{"rule": "below_threshold", "reason": "r", "anchor": {"document_id": "d", "start": 3, "end": 1}}]}
    return put, put("package.json", package), put("good.txt", "It is 5 kg."), put("bad.txt", "It is 6 kg.")


def test_audit_recheck_and_exit_codes(spark, files, capsys):
    put, package, good, bad = files
    assert cli.main(["audit", "--package", package, "--response", good, "--format", "json"], spark) == 0
    document = json.loads(capsys.readouterr().out)
    assert document["counts"]["grounded_share"] == 1.0
    archived = put("report.json", document)
    assert cli.main(["recheck", archived, "--package", package], spark) == 0
    assert cli.main(["recheck", put("changed.json", document | {"report_id": "x"}), "--package", package], spark) == 5
    assert cli.main(["audit", "--package", package, "--response", bad, "--fail-on-findings"], spark) == 3
    assert "6 kg [6:10] is in none of the evidence" in capsys.readouterr().out
    assert cli.main(["audit", "--contexts", put("contexts.json", ["It is 5 kg."]), "--response", good], spark) == 0
    assert cli.main(["audit", "--contexts", put("sample.json", {"output": "It is 5 kg.", "context": ["It is 5 kg."]})], spark) == 0
    assert cli.main(["audit", "--contexts", put("empty.json", [" "]), "--response", good], spark) == 1
    assert cli.main(["audit", "--package", put("not.json", "[]"), "--response", good], spark) == 1
    assert cli.main(["audit", "--package", package], spark) == 2
    assert cli.main(["audit"], spark) == cli.main(["nothing"], spark) == 2
    capsys.readouterr()
    assert cli.main(["audit", "--package", package, "--response", bad, "--format", "json"], spark) == 0
    found = put("bad.json", capsys.readouterr().out)
    assert cli.main(["explain", found], spark) == 0 and "seg_001" in capsys.readouterr().out
    assert cli.main(["explain", found, "--segment", "seg_001", "--particular", "6 kg"], spark) == 0 and "5 kg" in capsys.readouterr().out
    assert cli.main(["explain", found, "--segment", "seg_009"], spark) == 2
    out = put("page.html", "") + ".new"
    assert cli.main(["certificate", found, "--out", out], spark) == 0 and "<mark" in open(out).read()
    assert cli.main(["certificate", found, "--out", out], spark) == 1 and cli.main(["certificate", found, "--out", out, "--force"], spark) == 0
    assert cli.main(["certificate", put("junk.json", "{}")], spark) == 1
    assert cli.main(["doctor"]) == 0 and cli.main(["errors", "--by", "me"], spark) == 0


def test_eval_gate(spark, tmp_path, capsys):
    from tests.test_evaluation import write_case

    write_case(tmp_path, "en-a-01", "It is 5 kg.", [{"kind": "digit_drift", "text": "5 kg"}], ["It is 5 kg."])
    assert cli.main(["eval", str(tmp_path)], spark) == 0
    assert cli.main(["eval", str(tmp_path), "--gate"], spark) == 4
    (tmp_path / "marked").mkdir()
    (tmp_path / "marked" / "en-a-01.md").write_text("It is {{P:quantity}}5 kg{{/P}}.")
    capsys.readouterr()
    assert cli.main(["eval", str(tmp_path), "--marked", str(tmp_path / "marked"), "--json"], spark) == 0
    told = json.loads(capsys.readouterr().out)
    assert {f["metric"]: f["share"] for f in told["floors"]}["extraction precision"] == 1.0 and told["extraction"] and told["rates"]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "pyproject.toml").write_text('[tool.groundwork]\nmatcher = "exact"\nlanguages = ["en"]\n')
    assert problems.settings(str(tmp_path)) == problems.Settings("exact", ("en",))
    monkeypatch.setenv("GROUNDWORK_LANGUAGES", "ja,zh")
    assert problems.settings(str(tmp_path), matcher="normalized").languages == ("ja", "zh")
    (tmp_path / "groundwork.toml").write_text("colour = 1\n")
    with pytest.raises(ValueError):
        problems.settings(str(tmp_path))
    with pytest.raises(ValueError):
        problems.catalogue(None, "")


def test_registered_queries_have_twins_over_known_names():
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(map(callable, queries.values()))
