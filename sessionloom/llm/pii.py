"""Personal data in texts: patterns propose spans, checksums confirm, context words adjust.

Offsets are code points, end exclusive, leftmost and non-overlapping per kind.
The four base kinds (email, ip, card, phone) are kept whenever they pass their
own check. Further kinds (iban, account, secret) must reach ``ACCEPT`` points:
so many for the pattern, more for a passed checksum, more for a context word
within ``NEAR`` characters.

Cases: null and empty texts have no spans; a text of any length is searched
whole, in time linear in its length; repeated values are repeated spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from sessionloom.llm.workers import slices, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
NEAR, ACCEPT = 40, 0.6
MASK_BYTES = 1 << 20
POINTS = {"email": 0.9, "ip": 0.7, "card": 0.4, "phone": 0.6, "iban": 0.3, "account": 0.1, "secret": 0.4}
CHECKED = {"card": 0.4, "iban": 0.4, "account": 0.3}
CONTEXT_POINTS = 0.3
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "bank", "konto", "compte", "cuenta"),
    "account": ("account", "card", "amex", "konto", "compte", "cuenta"),
    "secret": ("token", "secret", "password", "key", "api"),
}
EXTRA_SCHEMA = "array<struct<kind:string,start:int,end:int,score:double,checked:boolean>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    checked: bool


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def finder():
    """A function text -> spans; patterns are compiled here, once a task."""
    # Possessive: every run is consumed whole, so no run is scanned twice. The
    # quantified classes exclude what follows them, hence the same matches.
    domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
    dotted = re.compile(r"[0-9]++(?:\.[0-9]++){3}|[0-9]++")
    number = re.compile(r"[0-9](?:[ -]?[0-9])++")
    phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
    iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    secret = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")
    context = {kind: re.compile("|".join(words), re.IGNORECASE) for kind, words in CONTEXT.items()}

    def emails(text: str) -> Iterator[tuple[int, int]]:
        free, at = 0, text.find("@")
        while at >= 0:
            before = text[free:at]
            start = free + len(before.rstrip(LOCAL))
            found = domain.match(text, at + 1) if start < at else None
            free = at + 1
            if found:
                yield start, found.end()
                free = found.end()
            at = text.find("@", free)

    def octet(part: str) -> bool:
        part = part.lstrip("0")
        return len(part) <= 3 and int(part or 0) <= 255

    def proposals(text: str) -> Iterator[tuple[str, int, int, bool | None]]:
        """(kind, start, end, passed checksum or None where there is none)."""
        for start, end in emails(text):
            yield "email", start, end, None
        for found in dotted.finditer(text):
            parts = found.group().split(".")
            if len(parts) == 4 and all(map(octet, parts)):
                yield "ip", *found.span(), None
        for found in number.finditer(text):
            digits = found.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19:
                if luhn(digits):
                    yield "card", *found.span(), True
            elif 12 <= len(digits) <= 15:
                yield "account", *found.span(), luhn(digits)
        if "+" in text:
            for found in phone.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in found.group()) <= 15:
                    yield "phone", *found.span(), None
        for found in iban.finditer(text):
            yield "iban", *found.span(), mod97(found.group().replace(" ", ""))
        for found in secret.finditer(text):
            yield "secret", *found.span(), None

    def spans(text: str) -> list[Span]:
        out = []
        for kind, start, end, checked in proposals(text):
            score = POINTS[kind] + (CHECKED[kind] if checked else 0.0)
            around = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
            if context[kind].search(around):
                score += CONTEXT_POINTS
            if kind in BASE or score >= ACCEPT:
                out.append(Span(kind, start, end, round(min(score, 1.0), 3), bool(checked)))
        return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))

    return spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with an array column ``name`` of spans."""

    @pandas_udf(EXTRA_SCHEMA)
    def search(texts: pd.Series) -> pd.Series:
        spans = finder()
        return texts.map(lambda t: [s._asdict() for s in spans(t or "")])

    return docs.withColumn(name, search(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` masked; a null text stays null."""

    docs = docs.withColumn(text, F.col(text).cast("string"))

    def mask(batches):
        spans = finder()
        for batch in slices(batches, text, MASK_BYTES):
            place = batch.schema.get_field_index(text)
            texts = [t if not t else masked(t, spans(t)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(mask, docs.schema)


DIGEST = pa.schema(
    [("doc_id", pa.int64())]
    + [(f"n_{kind}", pa.int64()) for kind in BASE]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)
DIGEST_SQL = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    "base_sha256 string, spans string, n_added bigint"
)


def digests(docs: DataFrame) -> DataFrame:
    """Per document the counts, the base spans' hash and all spans as text."""

    def search(batches):
        spans = finder()
        for batch in batches:
            found = [spans(t or "") for t in batch.column("text").to_pylist()]
            base = [[s for s in row if s.kind in BASE] for row in found]
            columns = {
                "doc_id": batch.column("doc_id"),
                "base_sha256": [hashlib.sha256(joined(row).encode()).hexdigest() for row in base],
                "spans": [joined(row) for row in found],
                "n_added": [len(a) - len(b) for a, b in zip(found, base)],
            }
            columns |= {f"n_{kind}": [sum(s.kind == kind for s in row) for row in base] for kind in BASE}
            yield table(columns, DIGEST)

    return docs.select("doc_id", "text").mapInArrow(search, DIGEST_SQL)
