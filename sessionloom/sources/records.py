"""Turning JSON records and text lines into log-entry columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names tried for content, in order.
CONTENT_FIELDS = ("content", "message", "text", "body", "msg")
TIME_FIELDS = ("timestamp", "ts")
# Fixed value: larger whole numbers are milliseconds, others seconds.
MILLIS_ABOVE = 1_000_000_000_000
# Fixed value: the stamp that may lead a line. With (?d) only \n ends a line, so a
# carriage return or a Unicode line separator belongs to the text.
LINE_STAMP = (
    r"(?d)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)(?U)\s*(.*)$"
)
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
NAIVE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"


def strict_json(text: Column) -> Column:
    """Variant of a complete JSON value, NULL otherwise.

    The parser ignores text after the first value, so the value is wrapped: the
    closing bracket makes trailing text an error.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(alone.isNotNull(), F.try_variant_get(wrapped, "$.v", "variant"))


def strict_json_array(text: Column) -> Column:
    wrapped = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.try_variant_get(F.try_parse_json(wrapped), "$.v", "array<variant>")


def field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "variant")


def string_field(record: Column, name: str) -> Column:
    """The field when it is a JSON string; other types count as absent."""
    value = field(record, name)
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def _whole_number(record: Column, name: str) -> Column:
    value = field(record, name)
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def count_field(record: Column, name: str) -> Column:
    value = _whole_number(record, name)
    return F.when(value >= 0, value)


def parse_rfc3339(text: Column) -> Column:
    return F.when(text.rlike(RFC3339), F.upper(text).try_cast("timestamp"))


def record_time(record: Column, fallback: Column) -> Column:
    """RFC 3339 text or epoch seconds / milliseconds, field by field, else ``fallback``."""
    choices = []
    for name in TIME_FIELDS:
        number = _whole_number(record, name)
        # Seconds outside a timestamp's range are ignored, not an error.
        epoch = F.when(number > MILLIS_ABOVE, F.when(number <= 8_210_266_876_799_000, F.timestamp_millis(number))).when(
            number >= -8_334_601_228_800, F.timestamp_seconds(number)
        )
        choices += [parse_rfc3339(string_field(record, name)), epoch]
    return F.coalesce(*choices, fallback)


def record_content(record: Column) -> Column:
    return F.coalesce(*[string_field(record, name) for name in CONTENT_FIELDS], F.lit(""))


def record_tool_calls(record: Column) -> Column:
    """Array of calls; items without a string ``tool_name`` are dropped."""
    items = F.try_variant_get(record, "$.tool_calls", "array<variant>")
    named = F.filter(items, lambda item: string_field(item, "tool_name").isNotNull())
    calls = F.transform(
        named,
        lambda item: F.struct(
            string_field(item, "tool_name").alias("tool_name"),
            F.coalesce(F.to_json(field(item, "parameters")), F.lit("null")).alias("parameters"),
            F.to_json(field(item, "result")).alias("result"),
            count_field(item, "duration_ms").alias("duration_ms"),
        ),
    )
    return F.coalesce(calls, F.expr("array()").cast("array<struct<tool_name:string,parameters:string,result:string,duration_ms:bigint>>"))


def entry_columns(record: Column, fallback_ts: Column) -> list[Column]:
    return [
        record_time(record, fallback_ts).alias("ts"),
        record_content(record).alias("content"),
        string_field(record, "model").alias("model"),
        string_field(record, "provider").alias("provider"),
        record_tool_calls(record).alias("tool_calls"),
        F.coalesce(count_field(record, "user_messages"), F.lit(0)).alias("user_messages"),
        F.coalesce(count_field(record, "assistant_messages"), F.lit(0)).alias("assistant_messages"),
    ]


def line_columns(line: Column, fallback_ts: Column) -> list[Column]:
    """Leading timestamp and text; a prefix no format parses keeps the whole line."""
    stamp = F.regexp_extract(line, LINE_STAMP, 1)
    parsed = F.coalesce(
        parse_rfc3339(stamp), F.when(stamp.rlike(NAIVE), F.concat(stamp, F.lit("Z")).try_cast("timestamp"))
    )
    return [
        F.coalesce(parsed, fallback_ts).alias("ts"),
        F.when(parsed.isNotNull(), F.regexp_extract(line, LINE_STAMP, 2)).otherwise(line).alias("content"),
    ]
