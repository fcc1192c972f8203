"""URL filters: host and path rules, then a split-block Bloom filter in front of an exact hash join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LANES = 8
#: A filter has at most so many blocks of 64 bytes: 4 MB, whatever the list holds.
MAX_BLOCKS = 1 << 16
_BITS_PER_KEY = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for the addresses of a page: no scheme, no www. or m., no query, no trailing / or .html."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?:\.html)?/*$", ""))


def match_rule(rules: list[Rule], host: Column, path: Column, field: str) -> Column:
    """``field`` of the longest rule that fits, of equally long ones the first; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        here = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(here & F.startswith(path, F.lit(rule.path)), F.lit(getattr(rule, field))).otherwise(found)
    return found


def _bit(hashed: Column, k: int) -> Column:
    """One bit of lane ``k``, from six bits of the key's hash that no other lane uses."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * k).bitwiseAND(63).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, l0 .. l7) of ``listed(key)``: every key sets one bit in each of its block's eight lanes."""
    hashed = listed.select(_block(F.col("key"), blocks).alias("block"), F.xxhash64("key").alias("h"))
    return hashed.groupBy("block").agg(*(F.bit_or(_bit(F.col("h"), k)).alias(f"l{k}") for k in range(_LANES)))


def passes(key_hash: Column) -> Column:
    """Whether all eight bits of a key are set in the block it was joined to."""
    out = F.lit(True)
    for k in range(_LANES):
        out = out & (F.col(f"l{k}").bitwiseAND(_bit(key_hash, k)) != 0)
    return F.coalesce(out, F.lit(False))


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``; built-in functions only.

    ``listed(key)`` holds canonical addresses to block; nulls in it don't count, repeats count once. A rule
    decides where one fits. Other addresses meet the filter, of a fixed greatest size and so broadcast; those
    that pass go on to an exact shuffled hash join with the list, which takes false positives out. A key that
    many pages share is split by the skew handling of that join. Null addresses and those without ``://``
    have empty host and path and are allowed.
    """
    keys = checkpointed(listed.select(F.col("key").cast("string")).where("key is not null").distinct())
    wanted = max(1, -(-keys.count() * _BITS_PER_KEY // (64 * _LANES)))
    blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    host, path = F.col("host"), F.col("path")
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # Addresses are parsed once; both ways below read the result.
    ruled = written(
        parsed.select(
            "id", "host", "path", match_rule(rules, host, path, "name").alias("rule"), match_rule(rules, host, path, "verdict").alias("verdict"),
            canonical(host, path).alias("key"),
        )
    )
    probed = ruled.withColumn("block", F.when(F.col("rule").isNull() & (host != ""), _block(F.col("key"), blocks))).join(
        F.broadcast(bloom(keys, blocks)), "block", "left"
    )
    hit = passes(F.xxhash64("key"))
    clear = probed.where(~hit).select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    exact = keys.select(F.col("key").alias("listed")).hint("shuffle_hash")
    likely = probed.where(hit).select("id", "host", "path", "rule", "key")
    judged = likely.join(exact, F.col("key") == F.col("listed"), "left").select(
        "id", "host", "path", "rule", F.when(F.col("listed").isNotNull(), "block").otherwise("allow").alias("verdict")
    )
    return clear.unionByName(judged)
