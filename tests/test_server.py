"""The line protocol: replies, refusals and faults."""

from __future__ import annotations

import io
import json

from groundwork import server

PACKAGE = {"contract": "x.context-package/1", "package_id": "p", "items": [{"item_id": "i", "text": "It is 5 kg.", "anchor": {"document_id": "d", "start": 0, "end": 11}}], "omissions": []}


def ask(spark, *messages):
    lines = [m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0", "id": k + 1} | m) for k, m in enumerate(messages)]
    out = io.StringIO()
    assert server.serve(spark, io.StringIO("\n".join(lines)), out) == 0
    return [json.loads(x) for x in out.getvalue().splitlines()]


def tool(name, **arguments):
    return {"method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_tools_answer(spark):
    (made,) = ask(spark, tool("audit", answer="It is 5 kg and 6 kg.", package=PACKAGE))
    report = made["result"]["structuredContent"]
    assert report["counts"]["grounded_share"] == 0.5 and "Findings" in made["result"]["content"][0]["text"] and not made["result"]["isError"]
    same, other, told, missing = ask(
        spark, tool("recheck", report=report, answer="It is 5 kg and 6 kg.", package=PACKAGE), tool("recheck", report=report, answer="No.", package=PACKAGE),
        tool("explain", report=report, segment_id="seg_001", particular="6 kg"), tool("explain", report=report, segment_id="seg_009"),
    )
    assert same["result"]["structuredContent"] == {"matches": True, "differences": []} and other["result"]["isError"]
    assert "none of the evidence" in told["result"]["content"][0]["text"] and missing["result"]["isError"]


def test_refusals_are_results_and_faults_are_errors(spark):
    shielded = PACKAGE | {"provenance": {"protection": {"by": "r", "scope": "s", "reversible": False}}}
    record = {"contract": "x.protection-scope/1", "by": "other", "scope": "s", "reversible": False}
    refused, differ, empty = ask(
        spark, tool("audit", answer="Paid to <PERSON_1>.", package=PACKAGE), tool("audit", answer="Paid.", package=shielded, protection=record), tool("audit", answer="It is 5 kg.", contexts=[" "]),
    )
    assert all(x["result"]["isError"] for x in (refused, differ, empty))
    codes = [
        x["error"]["code"]
        for x in ask(
            spark, "junk", "[" * 70 + "]" * 70, "[]", json.dumps({"method": 5, "id": 1}), json.dumps({"method": "x", "id": 1.5}), {"method": "nothing"}, tool("nothing"), tool("audit", answer="a"),
            tool("audit", answer="a", package=PACKAGE, more=1), tool("audit", answer=5, package=PACKAGE), tool("audit", answer="a", contexts=["x"], matcher="fuzzy"),
            {"method": "tools/list", "params": {"_meta": {server.REVISION_KEY: "1999-01-01"}}},
        )
    ]
    assert codes == [-32700, -32700, -32600, -32600, -32600, -32601, -32601, -32602, -32602, -32602, -32602, -32022]


def test_discovery_and_notifications(spark):
    found, begun, old, listed = ask(
        spark, {"method": "server/discover"}, {"method": "initialize", "params": {"protocolVersion": "2026-07-28"}}, {"method": "initialize", "params": {"protocolVersion": "1"}},
        json.dumps({"method": "notifications/initialized"}), {"method": "tools/list"},
    )
    assert found["result"]["supportedVersions"] == list(server.REVISIONS) and begun["result"]["protocolVersion"] == "2026-07-28" and old["result"]["protocolVersion"] == "2025-06-18"
    assert [t["name"] for t in listed["result"]["tools"]] == ["audit", "recheck", "explain"]
    assert server.depth('{"a": "[[[", "b\\"": [1]}') == 2
