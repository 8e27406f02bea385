"""Privacy events: identity hashes, retention, namespaces, envelopes, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import ordered

BATCH_SIZE = 100
SCHEMA_VERSION = 1


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _json_text(value: Column) -> Column:
    """A JSON string literal with quotes, backslashes and control characters escaped."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def canonical_attributes(attributes: Column) -> Column:
    """JSON object of a ``map<string,string>`` with sorted keys and no spaces."""
    entries = F.array_sort(F.map_entries(attributes))
    pairs = F.transform(
        entries, lambda e: F.concat(_json_text(e["key"]), F.lit(":"), _json_text(e["value"]))
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def event_identity(namespace: Column, event_type: Column, entity: Column, attributes: Column) -> Column:
    """Struct of ``event_id`` and ``content_hash``."""
    attrs = canonical_attributes(attributes)
    parts = F.concat_ws(",", _json_text(namespace), _json_text(event_type), _json_text(entity), attrs)
    canonical = F.concat(F.lit("["), parts, F.lit("]"))
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        content_hash(canonical).alias("event_id"),
        content_hash(attrs).alias("content_hash"),
    )


def namespace(product: Column, environment: Column, tenant: Column) -> Column:
    """``product.environment.tenant`` when valid, else NULL."""
    value = F.concat_ws(".", product, environment, tenant)
    return F.when((F.octet_length(value) <= 256) & value.rlike(r"\A[A-Za-z0-9._:-]+\z"), value)


def retain(events: DataFrame, as_of: Column, max_age_days: int, column: str = "observed_at") -> DataFrame:
    """Events observed no earlier than the retention window before ``as_of``."""
    oldest = as_of - F.make_dt_interval(days=F.lit(max(max_age_days, 0)))
    return events.where(F.col(column) >= oldest)


def validate_envelope(text: Column, threshold: float) -> Column:
    """accept / escalate / reject with a reason, as one label."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    version = F.try_variant_get(value, "$.schema_version", "variant")
    whole = (F.schema_of_variant(version) == "BIGINT") & (
        F.try_variant_get(value, "$.schema_version", "bigint") == SCHEMA_VERSION
    )
    run_kind = F.schema_of_variant(F.try_variant_get(value, "$.run", "variant"))
    return (
        F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "reject: run envelope must be a JSON object")
        .when(~F.coalesce(whole, F.lit(False)), "reject: unsupported or missing schema_version")
        .when(
            ~F.coalesce(run_kind.startswith("OBJECT"), F.lit(False)),
            "reject: run envelope must contain an object-valued run",
        )
        .when(F.lit(threshold < 0.5), "escalate: validation threshold is below the safe minimum")
        .otherwise("accept")
    )


def batches(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = BATCH_SIZE
) -> DataFrame:
    """Events with ``batch_no`` (from 0, per key); a full batch rolls over to the next."""
    placed = ordered.place(events, [*keys, *order])
    counted = ordered.running_sums(placed, {"_n": F.lit(1)}, keys)
    return counted.withColumn("batch_no", F.floor((F.col("_n") - 1) / size).cast("bigint"))


def idempotency_keys(batched: DataFrame, keys: Sequence[str], event_id: str) -> DataFrame:
    """Hash of the newline-joined event ids of each batch (at most ``size`` ids)."""
    listed = batched.groupBy(*keys, "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("_n", F.col(event_id).cast("string").alias("e")))).alias("_ids")
    )
    return listed.select(
        *keys, "batch_no", F.size("_ids").cast("bigint").alias("events"),
        content_hash(F.array_join(F.transform("_ids", lambda i: i["e"]), "\n")).alias("idempotency_key"),
    )
