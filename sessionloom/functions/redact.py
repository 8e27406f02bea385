"""Secret and personal-data redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement), applied in this order.
REDACTIONS = (
    (
        r"(?i)((?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|password|authorization)"
        r"\s*[:=]\s*(?:bearer\s+)?)[^\s,;\"']+",
        "$1[REDACTED]",
    ),
    (r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_JWT]"),
    (
        r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{20,})\b",
        "[REDACTED_TOKEN]",
    ),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"/(?:home|Users)/[^/\s]+", "/home/[REDACTED_USER]"),
)

# An attribute whose key contains one of these is dropped.
SENSITIVE_KEY_PARTS = ("prompt", "secret", "token", "credential", "password", "raw", "content")


def redact_text(text: Column) -> Column:
    """Apply every rule in turn; (?U) gives \\b and \\s their Unicode meaning."""
    return reduce(
        lambda value, rule: F.regexp_replace(value, "(?U)" + rule[0], rule[1]), REDACTIONS, text
    )


def redact_attributes(attributes: Column) -> Column:
    """Keep string values under harmless keys of a ``map<string, variant>``."""
    risky = "|".join(SENSITIVE_KEY_PARTS)
    kept = F.map_filter(
        attributes,
        lambda key, value: ~F.lower(key).rlike(risky) & (F.schema_of_variant(value) == "STRING"),
    )
    return F.transform_values(kept, lambda _, value: F.variant_get(value, "$", "string"))
