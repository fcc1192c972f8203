"""Mixing to target weights: soft domain membership and nonnegative document rates; built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written


def words_of(text: Column) -> Column:
    """Letters-and-digits words of a text in lower case; an empty one may stand at either end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def symbols_of(text: Column) -> Column:
    """Runs of marks other than common punctuation; an empty one may stand at either end."""
    return F.split(F.coalesce(text, F.lit("")), r"[\p{L}\p{N}\s.,;:'\"()-]+")


def word_count(words: Column) -> Column:
    n = F.size(words)
    lead, tail = (F.element_at(words, 1) == "").cast("int"), ((n > 1) & (F.element_at(words, -1) == "")).cast("int")
    return (n - lead - tail).cast("long")


#: Documents of overall behaviour that every domain's counts are mixed with.
_STRENGTH = 20.0
#: A Poisson deviance that one token in 100,000 reaches by chance.
_CLEAR = 9.0


@dataclass
class Classifier:
    """Naive Bayes over presence and absence of telling tokens; soft posteriors by domain."""

    domains: list[str]
    tokens: list[str]
    weights: list[list[float]]  # by domain: bias, then one for each token

    def scores(self, features: Column) -> Column:
        """array<double>: log-probability of each domain with a text's tokens, which are looked up in place."""
        bias = F.array(*(F.lit(w[0]) for w in self.weights))
        if not self.tokens:
            return bias
        listed = F.array(*map(F.lit, self.tokens))
        table = F.array(*(F.array(*map(F.lit, column)) for column in zip(*(w[1:] for w in self.weights), strict=True)))
        at = F.transform(F.array_intersect(features, listed), lambda t: F.array_position(listed, t).cast("int"))
        return F.aggregate(at, bias, lambda a, k: F.zip_with(a, F.element_at(table, k), lambda x, y: x + y))


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    domains: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 4000,
) -> Classifier:
    """From a bounded sample of labelled documents, whole texts; ``domain`` is a column of ``labels``.

    The sample is the ``max_labelled`` labelled ids with the least hashes among those that ``docs`` holds. Token counts
    are summed on the cluster; the tokens that a domain holds more often than chance explains come to the driver, all of
    them, so that the sample alone bounds their number: those whose count is as far above what its overall count
    predicts as one token in a hundred thousand is by chance, or, where a small sample has none so clear, the clearest.
    Labels with null id or domain, or one not in ``domains``, don't count; of labels for one id the least counts.
    """
    key = labels.select(F.col(id_col).alias("id"), domain.alias("domain"))
    known = key.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
    present = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    sample = present.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    text = F.col("body")
    tokens = F.array_distinct(F.concat(words_of(text), symbols_of(text)))
    taken = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).join(F.broadcast(sample), "id")
    features = checkpointed(taken.select("domain", tokens.alias("tokens")))
    held = {r[0]: r[1] for r in features.groupBy("domain").count().collect()}
    n = [held.get(d, 0) for d in domains]
    counts = features.select("domain", F.explode("tokens").alias("token")).where("token <> ''").groupBy("token").agg(
        *(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)), F.count("*").alias("n")
    )
    total = max(1, sum(n))

    def shrunk(k: int) -> Column:
        """Share of domain k's documents that hold the token, drawn to its share of all by _STRENGTH documents."""
        return (F.col(f"n{k}") + F.col("n") * (_STRENGTH / total)) / (n[k] + _STRENGTH)

    def surprise(k: int) -> Column:
        """Poisson deviance of the token's count in domain k, where that is above what its overall count predicts."""
        got, due = F.col(f"n{k}"), F.col("n") * (max(n[k], 1e-9) / total)
        return F.when(got > due, got * F.log(got / due) - got + due).otherwise(0.0)

    telling = F.greatest(*(surprise(k) for k in range(len(domains))), F.lit(0.0))
    judged = checkpointed(counts.withColumn("telling", telling).where("telling > 0"))
    clearest = judged.agg(F.max("telling")).first()[0] or 0.0
    best = (
        judged.where(F.col("telling") >= min(_CLEAR, clearest)).orderBy(F.col("telling").desc(), "token")
        .select("token", *(F.least(shrunk(k), F.lit(0.999)).alias(f"p{k}") for k in range(len(domains)))).collect()
    )
    weights = []
    for k in range(len(domains)):
        share = [r[f"p{k}"] for r in best]
        bias = math.log((n[k] + 0.5) / (total + 0.5 * len(domains))) + sum(math.log(1 - x) for x in share)
        weights.append([bias, *(math.log(x) - math.log(1 - x) for x in share)])
    return Classifier(list(domains), [r["token"] for r in best], weights)


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with tokens and p array<double> added: words and domain posteriors, over the whole text."""
    text, kept = F.col(text_col).cast("string"), docs.columns
    split = docs.select(*kept, words_of(text).alias("__words"), symbols_of(text).alias("__symbols"))
    scored = split.select(
        *kept, word_count(F.col("__words")).alias("tokens"), model.scores(F.concat("__words", "__symbols")).alias("__scores")
    )
    top = scored.select(*kept, "tokens", "__scores", F.array_max("__scores").alias("__top"))
    raw = top.select(*kept, "tokens", F.transform("__scores", lambda x: F.exp(x - F.col("__top"))).alias("__raw"))
    whole = raw.select(*kept, "tokens", "__raw", F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x).alias("__whole"))
    return whole.select(*kept, "tokens", F.transform("__raw", lambda x: x / F.col("__whole")).alias("p"))


def rate_of(p: Column, history: list[list[float]]) -> Column:
    """The rate after the steps so far: from 1, each subtracts the step's weight for the domains, never below 0."""
    rate = F.lit(1.0)
    for step in history:
        moved = F.lit(0.0)
        for k, g in enumerate(step):
            moved = moved + p[k] * F.lit(g)
        rate = F.greatest(F.lit(0.0), rate - moved)
    return rate


_LEAST_DAMPING = 1e-6


@dataclass
class Fit:
    """The steps that rates follow from, and how far the expected shares of the domains are from their targets at most."""

    steps: list[list[float]]
    off: float | None


def fit_rates(members: DataFrame, targets: list[float], passes: int = 48, tolerance: float = 5e-4) -> Fit:
    """Scaled projected gradient descent for ``members(tokens, p)``, of which rows with the same posteriors count as one.

    Least squares over domains of expected tokens less target, as shares of all tokens; rates are at least 0.
    Gradients are taken in the metric of the documents' tokens, so a document's step depends on its posteriors
    only, and its rate is a function of the few numbers of each step. A pass over the table sums, for the steps so
    far, the domain totals and the second moments of the documents whose rate isn't 0; the latter scale the next
    step, damped the more the oftener a step failed to come nearer, down to a plain gradient step. It ends within
    ``tolerance`` or when two steps on end gain a thousandth or less. What is returned has been evaluated. Nothing but those sums comes to the driver. Where no rates meet the targets, as with posteriors
    that don't tell domains apart, ``off`` says so.
    """
    k = len(targets)
    n, p, rate = F.col("tokens"), F.col("p"), F.col("rate")
    goal = np.array(targets) / max(sum(targets), 1e-300)
    found, best, damping = Fit([], None), math.inf, _LEAST_DAMPING
    steps: list[list[float]] = []
    gram, off, slow = np.eye(k), np.zeros(k), 0
    alike = checkpointed(members.groupBy("p").agg(F.sum("tokens").alias("tokens")))
    for _ in range(passes):
        rated = alike.select(n, p, rate_of(p, steps).alias("rate"))
        got = rated.agg(
            F.sum("tokens").alias("n"),
            *(F.sum(n * p[i] * rate).alias(f"t{i}") for i in range(k)),
            *(F.sum(F.when(rate > 0, n * p[i] * p[j])).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)),
        ).first()
        total = float(got["n"] or 0)
        if not total:
            break
        now = np.array([got[f"t{i}"] / total for i in range(k)]) - goal
        far = float(now @ now)
        if far < best:
            gained, best, off = best - far, far, now
            found = Fit(steps, float(np.abs(off).max()))
            gram = np.array([[(got[f"m{max(i, j)}_{min(i, j)}"] or 0) / total for j in range(k)] for i in range(k)])
            slow = slow + 1 if gained < 1e-3 * far else 0
            if found.off <= tolerance or slow == 2:
                break
            damping = max(damping / 10, _LEAST_DAMPING)
        else:
            damping *= 10
            if damping > 1e3:
                break
        steps = [*found.steps, np.linalg.solve(gram + damping * np.eye(k), off).tolist()]
    return found


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    **bounds: int,
) -> DataFrame:
    """(id, tokens, p, rate, off), one row per row of ``docs``: how often each document should be taken.

    ``targets`` gives every domain its share of the tokens; the sum over documents of rate * tokens * p nears
    share * all tokens. ``off``, the same in all rows, is how far the farthest domain's expected share is from its
    target: above 0.0005 the targets are out of reach of these documents and labels. Null and empty texts have no
    words and the posteriors of a text without telling tokens; texts may be of any length; null ids are kept, repeated
    rows are rows like any other; an empty table gives none; with no usable labels all posteriors are alike.
    """
    names = list(targets)
    model = fit_classifier(docs, labels, domain, names, id_col, text_col, **bounds)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    members = checkpointed(memberships(texts, model, "body").drop("body"))
    fit = fit_rates(members, [targets[d] for d in names])
    return members.select("id", "tokens", "p", rate_of(F.col("p"), fit.steps).alias("rate"), F.lit(fit.off).cast("double").alias("off"))


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domain: Column,
    targets: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    **bounds: int,
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``mix_rate``, ``mix_copies`` and ``mix_off`` added; see ``mixing_rates``.

    Texts are scored once and written with their posteriors, of which the fit reads no more than it needs. Rows of no
    copies leave; a row isn't repeated but says how often it counts. Columns of ``docs`` pass through; those named
    like the three that are added are refused.
    """
    names, columns, added = list(targets), docs.columns, ("mix_rate", "mix_copies", "mix_off")
    if taken := set(added) & set(columns):
        raise ValueError(f"the table has {', '.join(sorted(taken))} already")
    model = fit_classifier(docs, labels, domain, names, id_col, text_col, **bounds)
    at = {c: f"c{k}" for k, c in enumerate(columns)}
    scored = written(memberships(docs.select(*(F.col(c).alias(at[c]) for c in columns)), model, at[text_col]))
    fit = fit_rates(scored.select("tokens", "p"), [targets[d] for d in names])
    rated = scored.withColumn("mix_rate", rate_of(F.col("p"), fit.steps))
    kept = rated.withColumn("mix_copies", copies_of(F.col("mix_rate"), F.col(at[id_col]))).where("mix_copies > 0")
    return kept.select(*(F.col(at[c]).alias(c) for c in columns), "mix_rate", "mix_copies", F.lit(fit.off).cast("double").alias("mix_off"))


def copies_of(rate: Column, key: Column) -> Column:
    """A whole number of copies whose mean over documents is the rate: a hash of the id rounds it up or down."""
    return F.floor(rate + F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 20)) / float(1 << 20)).cast("long")
