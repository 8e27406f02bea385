"""URL rules and a listed-URL filter made of DataFrame functions only.

Listed URLs are known by their canonical form. A blocked Bloom filter of the
list, one row per 512-bit block, passes pages that may be listed to an exact
join on the canonical URL, which removes false positives.

Cases: a null url or one without ``://`` has empty host and path, fits no rule
and is never listed; repeated pages and repeated list entries give one row per
page; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8
BLOCK_BITS = 64 * LANES
BITS_PER_KEY = 16
ROW_BYTES = 8 * (LANES + 1) + 16
BROADCAST_BYTES = 64 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, a leading ``www.`` and closing slashes do not count."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, NULL without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = (F.concat(F.lit("."), host).endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _masks(key: Column) -> list[Column]:
    """One bit for each 64-bit lane of the key's block."""
    second = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("bigint")
    places = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]
    return [F.call_function("shiftleft", one, place) for place in places]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, lane0 .. lane7), at most ``blocks`` rows; combined before the shuffle."""
    masked = keys.select(
        _block(F.col(key), blocks).alias("block"),
        *[mask.alias(f"lane{i}") for i, mask in enumerate(_masks(F.col(key)))],
    )
    return masked.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def in_list(
    rows: DataFrame, listed: DataFrame, key: str, row_id: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Add boolean ``listed``: whether ``rows.key`` is among ``listed.key``.

    The filter is broadcast only when its known size is at most
    ``broadcast_bytes``; a larger one is joined by block.
    """
    keys = listed.where(F.col(key).isNotNull()).select(key).distinct()
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    bloom = blocked_bloom(keys, key, blocks)
    if blocks * ROW_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    bloom = bloom.withColumnRenamed("block", "_block")
    possible = F.lit(True)
    for i, mask in enumerate(_masks(F.col(key))):
        possible = possible & (F.col(f"lane{i}").bitwiseAND(mask) == mask)
    # A null key spreads by row id, here and in the exact join.
    spread = F.xxhash64(F.col(row_id))
    block = F.coalesce(_block(F.col(key), blocks), -F.abs(spread % (1 << 40)) - 1)
    probed = rows.withColumn("_block", block).join(bloom, "_block", "left")
    probed = probed.withColumn("_possible", F.coalesce(possible, F.lit(False)))
    probed = probed.withColumn("_slot", F.when(F.col("_possible"), F.xxhash64(key)).otherwise(spread))
    exact = keys.select(F.xxhash64(key).alias("_slot"), F.col(key).alias("_listed"))
    joined = probed.join(
        exact,
        (probed["_slot"] == exact["_slot"]) & probed["_possible"] & (probed[key] == exact["_listed"]),
        "left",
    )
    return joined.select(*[probed[c] for c in rows.columns], F.col("_listed").isNotNull().alias("listed"))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for ``pages(page_id, url)``.

    ``listed`` has a ``url`` column. A rule decides where one fits; elsewhere a
    listed page is blocked and any other allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    keys = listed.select(canonical(*host_and_path(F.col("url"))).alias("canonical"))
    marked = in_list(rows, keys, "canonical", "page_id")
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), "listed"
    )
