"""Kinds of refusal, what is the matter in the installation, and settings."""

from __future__ import annotations

import importlib.util
import os
import sys
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.languages import PACKS
from .functions.matching import MATCHERS

#: Kind, outcome, whether asking again can help, what it means.
CATALOGUE = (
    ("surrogate_record", "refused", False, "The record says that real values were replaced by invented ones, which nothing can tell apart."),
    ("protection_mismatch", "refused", False, "The package and the record disagree on who protected the answer, how far, or whether it can be undone."),
    ("protected_response", "refused", False, "The answer holds placeholders and nothing gives the values back."),
    ("contract", "refused", False, "A document isn't what its contract says, or its contract isn't one that is read."),
    ("segmentation", "refused", False, "The segments don't cover the answer exactly once."),
    ("judge_unavailable", "unavailable", False, "A judge was asked for and none is installed."),
    ("judge_refused", "failed", True, "A judge didn't answer, or not once for each claim."),
    ("other", "refused", False, "Refused for the reason given, which has no kind of its own."),
)
STATUS = 1  # the exit code of whatever can't be audited


def catalogue(spark: SparkSession, by: str) -> DataFrame:
    """(by, kind, status, outcome, retryable, detail): every kind of refusal, under the name of who asks."""
    if not by:
        raise ValueError("say who asks")
    rows = [(by, kind, STATUS, outcome, again, detail) for kind, outcome, again, detail in CATALOGUE]
    return spark.createDataFrame(rows, "by string, kind string, status int, outcome string, retryable boolean, detail string")


def doctor() -> dict[str, str]:
    """What this installation has: versions, packs, matchers and optional modules."""
    import pyspark

    found = {"python": sys.version.split()[0], "pyspark": pyspark.__version__, "packs": ",".join(sorted(PACKS)), "matchers": ",".join(MATCHERS)}
    return found | {name: "present" if importlib.util.find_spec(name) else "absent" for name in ("pyarrow", "pandas", "numpy", "xxhash")}


@dataclass(frozen=True)
class Settings:
    matcher: str = "normalized"
    languages: tuple[str, ...] | None = None
    fail_on_findings: bool = False


def settings(folder: str = ".", **given) -> Settings:
    """Settings from pyproject.toml, then groundwork.toml, then GROUNDWORK_ variables, then ``given``; unknown keys are refused."""
    known = {f.name for f in fields(Settings)}
    found: dict = {}
    root = Path(folder)
    for path, inner in ((root / "pyproject.toml", ("tool", "groundwork")), (root / "groundwork.toml", ())):
        if path.is_file():
            body = tomllib.loads(path.read_text(encoding="utf-8"))
            for key in inner:
                body = body.get(key, {})
            found |= body
    for name in known & {k.removeprefix("GROUNDWORK_").lower() for k in os.environ if k.startswith("GROUNDWORK_")}:
        value = os.environ[f"GROUNDWORK_{name.upper()}"]
        found[name] = value.split(",") if name == "languages" else value.lower() in ("1", "true", "yes") if name == "fail_on_findings" else value
    found |= {k: v for k, v in given.items() if v is not None}
    if unknown := set(found) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if found.get("matcher", "normalized") not in MATCHERS:
        raise ValueError(f"no matcher {found['matcher']!r}")
    if found.get("languages") is not None:
        found["languages"] = tuple(found["languages"])
    return Settings(**found)
