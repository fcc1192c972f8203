"""Assertions for test suites: an answer must be grounded to a share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Row, SparkSession

from .plans import audit as plan


class GroundingError(AssertionError):
    """An answer that isn't grounded enough; ``report`` has its audit."""

    def __init__(self, message: str, report: Row) -> None:
        super().__init__(message)
        self.report = report


def _tokens(report: Row) -> tuple[list[str], list[str]]:
    every = [t for s in report.segments or [] for t in s.tokens]
    return [t.text for t in every if t.locations], [t.text for t in every if not t.locations]


def evaluate(spark: SparkSession, *, answer: str, contexts: Sequence[str], question: str | None = None, **options) -> Row:
    """The report of one answer; what can't be audited raises ValueError with the reason."""
    if isinstance(contexts, str):
        raise ValueError("contexts are a list of texts, not one text")
    frame = spark.createDataFrame([(0, answer, list(contexts), question)], "audit long, answer string, contexts array<string>, question string")
    reports, refused = plan.evaluate_frame(frame, **options)
    if bad := refused.take(1):
        raise ValueError(bad[0].refused)
    return reports.first()


def assert_grounded(spark: SparkSession, *, answer: str, contexts: Sequence[str], at_least: float, allow_floating: Sequence[str] = (), **options) -> Row:
    """Fail if fewer of the tokens than ``at_least`` are in the contexts; tokens in ``allow_floating`` don't count, and must float."""
    if not 0 <= at_least <= 1:
        raise ValueError("at_least is a share between 0 and 1")
    report = evaluate(spark, answer=answer, contexts=contexts, **options)
    up, down = _tokens(report)
    if stale := [x for x in allow_floating if x not in down]:
        raise GroundingError(f"allowed to float, but doesn't: {', '.join(stale)}", report)
    left = [x for x in down if x not in allow_floating]
    if not up and not left:
        raise GroundingError("the answer holds nothing that can be checked", report)
    share = len(up) / (len(up) + len(left))
    if share < at_least:
        raise GroundingError(f"grounded share {share:.3f} is below {at_least:.3f}; in none of the contexts: {', '.join(left)}", report)
    return report
