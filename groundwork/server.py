"""Audits over JSON-RPC, one message a line: a client that holds an answer and its evidence asks, and nothing is kept between requests.

No path is read: whoever chooses the arguments mustn't choose files.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from typing import IO, Any

from pyspark.sql import SparkSession

from . import problems, sinks
from .plans import single

# Revisions of the protocol, the newest first, and its error codes.
REVISIONS = ("2026-07-28", "2025-06-18")
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL_ERROR, UNKNOWN_REVISION = -32700, -32600, -32601, -32602, -32603, -32022
REVISION_KEY, SERVER_KEY = "io.modelcontextprotocol/protocolVersion", "io.modelcontextprotocol/serverInfo"
MAX_DEPTH = 64
SERVER = {"name": "groundwork", "version": single.VERSION}
INSTRUCTIONS = "Looks up every checkable token of an answer in the evidence it was written from. Floating means that a token is in none of it, not that it is false; read what wasn't checked before any share."

_TEXT, _OBJECT, _TEXTS = {"type": "string"}, {"type": "object"}, {"type": "array", "items": {"type": "string"}}
#: By tool: what it does, its arguments, those that must be given.
TOOLS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "audit": (
        "A report on an answer: where each token stands, what contradicts it, what wasn't checked.",
        {"answer": _TEXT, "package": _OBJECT, "contexts": _TEXTS, "question": _TEXT, "languages": _TEXTS, "protection": _OBJECT, "restored_by": _TEXT, "matcher": _TEXT}, ("answer",),
    ),
    "recheck": (
        "Derives a report again from its inputs and lists what comes out otherwise.",
        {"report": _OBJECT, "answer": _TEXT, "package": _OBJECT, "contexts": _TEXTS, "protection": _OBJECT, "restored_by": _TEXT}, ("report", "answer"),
    ),
    "explain": ("All that a report knows of one segment, from the report alone.", {"report": _OBJECT, "segment_id": _TEXT, "particular": _TEXT}, ("report", "segment_id")),
}
_PYTHON = {"string": str, "object": dict, "array": list}


class Fault(Exception):
    """A request that can't be answered: code, message and, for some, data."""

    def __init__(self, code: int, message: str, data: Any = None) -> None:
        super().__init__(message)
        self.body = {"code": code, "message": message} | ({} if data is None else {"data": data})


def depth(line: str) -> int:
    """Greatest nesting of a JSON text, counted before anything is parsed; brackets in strings don't count."""
    now = most = 0
    inside = escaped = False
    for c in line:
        if inside:
            inside, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            now += 1
            most = max(most, now)
        elif c in "]}":
            now -= 1
    return most


def read(line: str) -> tuple[str, dict, str | int | None]:
    """(method, params, id) of a line; a notification has no id."""
    if depth(line) > MAX_DEPTH:
        raise Fault(PARSE_ERROR, f"nested deeper than {MAX_DEPTH}")
    try:
        message = json.loads(line)
    except ValueError as error:
        raise Fault(PARSE_ERROR, f"not JSON: {error}") from error
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        raise Fault(INVALID_REQUEST, "a request is an object with a method")
    number = message.get("id")
    if number is not None and (isinstance(number, bool) or not isinstance(number, (str, int))):
        raise Fault(INVALID_REQUEST, "an id is a text or a whole number")
    params = message.get("params")
    return message["method"], params if isinstance(params, dict) else {}, number


def arguments_of(tool: str, given: dict) -> dict:
    """The arguments of a tool, checked against what it takes."""
    _, known, needed = TOOLS[tool]
    if lacking := [n for n in needed if given.get(n) is None]:
        raise Fault(INVALID_PARAMS, f"{tool} needs {', '.join(lacking)}")
    if strange := sorted(set(given) - set(known)):
        raise Fault(INVALID_PARAMS, f"{tool} takes no {', '.join(strange)}")
    for name, value in given.items():
        kind = known[name]["type"]
        if value is not None and (not isinstance(value, _PYTHON[kind]) or (kind == "array" and not all(isinstance(x, str) for x in value))):
            raise Fault(INVALID_PARAMS, f"{name} is of another type than {kind}")
    return {k: v for k, v in given.items() if v is not None}


def _evidence(given: dict) -> dict:
    if ("package" in given) == ("contexts" in given):
        raise Fault(INVALID_PARAMS, "give a package or contexts")
    whole = {"package": json.dumps(given["package"])} if "package" in given else {"sample": {"contexts": given["contexts"], "question": given.get("question")}}
    return whole | {"record": json.dumps(given["protection"]) if "protection" in given else None, "restored_by": given.get("restored_by")}


def call(spark: SparkSession, tool: str, given: dict) -> tuple[str, dict | None]:
    """(text, document) of a tool's result."""
    if tool == "audit":
        try:
            settings = problems.settings(matcher=given.get("matcher"), languages=given.get("languages"))
        except ValueError as error:
            raise Fault(INVALID_PARAMS, str(error)) from error
        row = single.audit_one(spark, given["answer"], settings=settings, **_evidence(given)).asDict(True)
        return sinks.text_report(row), sinks.report_document(row)
    if tool == "recheck":
        found = single.recheck_one(spark, json.dumps(given["report"]), given["answer"], **_evidence(given))
        lines = [f"{d.path}: {d.archived} -> {d.fresh}" for d in found]
        return "\n".join(lines or ["the report comes out the same"]), {"matches": not found, "differences": lines}
    row = sinks.report_row(single.archived(spark, json.dumps(given["report"])))
    return sinks.explanation(row, given["segment_id"], given.get("particular")), None


def answer(spark: SparkSession, method: str, params: dict) -> dict:
    """The result of one request."""
    meta = params.get("_meta") if isinstance(params.get("_meta"), dict) else {}
    asked = meta.get(REVISION_KEY)
    if asked is not None and asked not in REVISIONS:
        raise Fault(UNKNOWN_REVISION, "unsupported protocol version", {"supported": list(REVISIONS), "requested": asked})
    about = {"capabilities": {"tools": {}}, "instructions": INSTRUCTIONS}
    if method == "server/discover":
        body: dict = about | {"supportedVersions": list(REVISIONS)}
    elif method == "initialize":
        wanted = params.get("protocolVersion")
        body = about | {"protocolVersion": wanted if wanted in REVISIONS else REVISIONS[-1], "serverInfo": SERVER}
    elif method == "tools/list":
        shape = lambda known, needed: {"type": "object", "properties": known, "required": list(needed), "additionalProperties": False}
        body = {"tools": [{"name": n, "description": what, "inputSchema": shape(known, needed)} for n, (what, known, needed) in TOOLS.items()]}
    elif method == "tools/call":
        tool, given = params.get("name"), params.get("arguments")
        if tool not in TOOLS:
            raise Fault(NO_METHOD if isinstance(tool, str) else INVALID_PARAMS, f"no tool {tool!r}")
        checked = arguments_of(tool, given if isinstance(given, dict) else {})
        try:
            text, document = call(spark, tool, checked)
            content = [{"type": "text", "text": text}] + ([] if document is None else [{"type": "text", "text": json.dumps(document, ensure_ascii=False, default=str)}])
            body = {"content": content, "isError": False} | ({} if document is None else {"structuredContent": json.loads(content[1]["text"])})
        except (single.Refused, ValueError) as refusal:  # an answer that whoever asked can act on
            body = {"content": [{"type": "text", "text": f"refused: {refusal}"}], "isError": True}
    else:
        raise Fault(NO_METHOD, f"no method {method!r}")
    return {"resultType": "complete", **body, "_meta": {SERVER_KEY: SERVER}}


def replies(spark: SparkSession, lines: IO[str]) -> Iterator[dict]:
    """A reply for each line that asks for one; a line that can't be read is answered and the next one is read."""
    for line in filter(str.strip, lines):
        number = None
        try:
            method, params, number = read(line)
            if number is not None:
                yield {"jsonrpc": "2.0", "id": number, "result": answer(spark, method, params)}
        except Fault as fault:
            yield {"jsonrpc": "2.0", "id": number, "error": fault.body}
        except Exception as error:  # whatever it is, the client waits for a reply
            yield {"jsonrpc": "2.0", "id": number, "error": Fault(INTERNAL_ERROR, f"{type(error).__name__}: {error}").body}


def serve(spark: SparkSession, lines: IO[str] | None = None, out: IO[str] | None = None) -> int:
    """Read requests until they end; nothing but replies is written."""
    for stream in (sys.stdin, sys.stdout):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", newline="")
    target = out or sys.stdout
    for reply in replies(spark, lines or sys.stdin):
        target.write(json.dumps(reply, ensure_ascii=False, separators=(",", ":")) + "\n")
        target.flush()
    return 0
