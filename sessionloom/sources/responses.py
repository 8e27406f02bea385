"""Parsing model responses into the eight finding tables.

A response is accepted or rejected as a whole, so everything is decided row by
row on the response's own JSON; exploding into findings is the only fan-out. Only
(batch, row, count) is ordered, to number the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.prose_numbers import parse_number
from sessionloom.functions.text import bound, computed_once
from sessionloom.operators import ordered
from sessionloom.session import cut_lineage

# Per kind its fields as (name, type, default for a shorthand string);
# the field with default None receives the shorthand text.
KINDS = {
    "model_failures": [
        ("model", "text", "unknown"), ("issue", "text", None), ("frequency", "count", 1), ("example", "text", ""),
    ],
    "harness_friction": [("harness", "text", "unknown"), ("issue", "text", None), ("severity", "number", 0.5)],
    "missing_tooling": [
        ("tool_name", "text", "candidate-capability"), ("purpose", "text", None), ("estimated_value", "number", 0.5),
    ],
    "workflow_bottlenecks": [
        ("description", "text", None), ("frequency", "count", 1), ("time_impact_minutes", "number", 0.0),
    ],
    "repeated_commands": [("command", "text", None), ("frequency", "count", 1), ("context", "text", "")],
    "repeated_prompts": [
        ("prompt_pattern", "text", None), ("frequency", "count", 1), ("suggested_improvement", "text", ""),
    ],
    "context_loss": [("description", "text", None), ("affected_segments", "list", [])],
    "automation_opportunities": [
        ("description", "text", None), ("estimated_time_saved", "number", 0.0), ("confidence", "number", 0.5),
    ],
}

NUMERIC_FIELDS = (
    "frequency|severity|estimated_value|time_impact_minutes|estimated_time_saved|confidence"
)
# Any value of a numeric field, quoted or bare, up to the next comma, brace or line end.
NUMERIC_VALUE = (
    # The first letters of the names, looked at first: most places fail on them.
    rf'(?i)(?=["fsetc])(?:"({NUMERIC_FIELDS})"|({NUMERIC_FIELDS}))'
    # A quote in single quotes cannot be put into double ones; such a value stays as it is.
    r"""\s*:\s*(?:"([^"]*)"|'([^'"]*)'|(?!')([^,}\n"\\]+)[^,}\n]*)"""
)
LENIENT = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowComments": "true"}
_LITERAL = r'"(?:[^"\\]++|\\.)*+"|\'(?:[^\'\\]++|\\.)*+\''
_WHOLE_LITERAL = _LITERAL.replace(".)", r"[^\n\r\u2028\u2029])")  # on one line
_COMMENT = r"//[^\n\r]*+|/\*.*?\*/"
_STRICT_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w$.])"
# Stretches that strict JSON has as well (bounded, because the matcher recurses); literals that go
# over a line; a comma with nothing but space before a closing bracket; names that look like
# numbers; numbers in any form; anything else.
TOKEN = (
    rf"(?s)((?:{_WHOLE_LITERAL}|{_COMMENT}|,(?!\s*[}}\]])|{_STRICT_NUMBER}|(?!Infinity\b|NaN\b)[A-Za-z_$][\w$]*+"
    r"""|[^\w$"'/,+.\-]){1,100}+"""
    rf"|{_LITERAL}|,\s*[}}\]]|(?:Infinity|NaN)\s*:"
    r"|[+-]?(?:0[xX][0-9A-Fa-f]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity|NaN)(?![\w$.])"
    r"|[\w$]+|.)"
)


def json_object_text(text: Column) -> Column:
    """From the first "{" to the last "}", NULL when there is no such span."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def quote_numbers(text: Column) -> Column:
    """Numeric fields become strings, so prose such as ``12-plus`` survives parsing."""
    return F.regexp_replace(text, NUMERIC_VALUE, '"$1$2":"$3$4$5"')


def _as_strict(token: Column) -> Column:
    """One token as strict JSON has it."""
    # A line continued inside a literal: pairs before it are passed over, as \\\\ ends first.
    joined = F.regexp_replace(token, r"(?s)(\\[^\n\r\u2028\u2029])|\\(?:\r\n|[\n\r\u2028\u2029])", "$1")
    sign = F.when(token.startswith("-"), "-").otherwise("")
    hexadecimal = F.concat(sign, F.conv(F.regexp_extract(token, "^[+-]?0[xX](.*)$", 1), 16, 10))
    led = F.regexp_replace(F.regexp_replace(token, r"^\+", ""), r"^(-?)\.", "$10.")
    number = (
        F.when(token.rlike(r"^,\s*[}\]]$"), F.regexp_replace(token, "^,", ""))
        .when(token.rlike("^[+-]?(Infinity|NaN)$"), F.lit("null"))
        .when(token.rlike("^[+-]?0[xX][0-9A-Fa-f]+$"), hexadecimal)
        .when(token.rlike(r"^[+-]?[.0-9][0-9.eE+-]*$") & (token != "."), F.regexp_replace(led, r"\.(?![0-9])", ".0"))
        .otherwise(token)
    )
    return (
        F.when(token.rlike("^[-+.0-9IN,]"), number)
        .when(token.rlike(r"\\[\n\r\u2028\u2029]"), joined)
        .otherwise(token)
    )


def as_strict_json(text: Column) -> Column:
    """Forms of JSON5 that Spark's parser lacks, rewritten token by token; literals keep their text.

    Signs before numbers, points without digits on one side, hexadecimal numbers, lines
    continued in literals and commas before a closing bracket. Infinity and NaN have no
    JSON number and become null.
    """
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), _as_strict), "")


def parse_object(text: Column) -> Column:
    """The response's JSON object; forms of JSON5 are forgiven."""
    quoted = quote_numbers(json_object_text(text))
    read = lambda text: F.from_json(text, "variant", LENIENT)
    return bound(quoted, lambda quoted: F.coalesce(read(quoted), read(as_strict_json(quoted))))


# A JSON value is carried as a struct of the variant and its type name, so the
# type is looked up once however many rules test it.


def _typed(value: Column) -> Column:
    return F.struct(
        value.alias("v"), F.coalesce(F.schema_of_variant(value), F.lit("ABSENT")).alias("type")
    )


def _string(value: Column) -> Column:
    return F.when(value["type"] == "STRING", F.try_variant_get(value["v"], "$", "string"))


def _as_text(value: Column) -> Column:
    """Strings as they are, other scalars and documents as JSON text, NULL for null."""
    other = F.when(~value["type"].isin("VOID", "ABSENT"), F.to_json(value["v"]))
    return F.coalesce(_string(value), other)


def _as_number(value: Column) -> Column:
    prose = F.when(value["type"] == "STRING", F.coalesce(parse_number(_string(value)), F.lit(0.0)))
    numeric = value["type"].rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    number = F.coalesce(prose, F.when(numeric, F.try_variant_get(value["v"], "$", "double")))
    return bound(number, lambda number: F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number))


def _whole(number: Column) -> Column:
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("bigint"))


def _as_list(value: Column) -> Column:
    items = F.transform(F.try_variant_get(value["v"], "$", "array<variant>"), _typed)
    texts = F.transform(items, _as_text)
    return F.when(F.forall(texts, lambda t: t.isNotNull()), texts)


READ = {"text": _as_text, "number": _as_number, "count": _as_number, "list": _as_list}


def _literal(value, kind: str) -> Column:
    if kind == "list":
        return F.array().cast("array<string>")
    return F.lit(value).cast("bigint") if kind == "count" else F.lit(value)


def _items(items: Column, fields: list[tuple]) -> Column:
    """Findings as structs; NULL where a field is missing or of the wrong type."""
    split = F.transform(
        items,
        lambda item: F.struct(
            _typed(item).alias("self"),
            *[_typed(F.try_variant_get(item, f"$.{name}", "variant")).alias(name) for name, _, _ in fields],
        ),
    )
    read = F.transform(
        split,
        lambda x: F.struct(
            F.regexp_replace(_string(x["self"]), r"(?U)^\s+|\s+$", "").alias("short"),
            x["self"]["type"].startswith("OBJECT").alias("whole"),
            *[READ[kind](x[name]).alias(name) for name, kind, _ in fields],
        ),
    )

    def finish(x: Column) -> Column:
        shorthand = F.struct(
            *[(x["short"] if default is None else _literal(default, kind)).alias(name) for name, kind, default in fields]
        )
        values = {name: _whole(x[name]) if kind == "count" else x[name] for name, kind, _ in fields}
        complete = x["whole"]
        for value in values.values():
            complete = complete & value.isNotNull()
        full = F.struct(*[value.alias(name) for name, value in values.items()])
        return F.when(x["short"] != "", shorthand).when(complete, full)

    return F.transform(read, finish)


def parse(responses: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({kind: findings}, rejected) from ``responses(batch_no bigint, text)``.

    Findings carry ``batch_no`` and ``ord``, their number in the order of batch then
    position: each response gets as many numbers as its longest list needs, after
    those of all responses before it.
    """
    parsed = responses.select("*", computed_once(parse_object(F.col("text"))).alias("_object"))
    findings = [
        _items(F.try_variant_get("_object", f"$.{kind}", "array<variant>"), fields).alias(kind)
        for kind, fields in KINDS.items()
    ]
    accepted = F.lit(True)
    for kind in KINDS:
        accepted = accepted & F.coalesce(F.forall(kind, lambda x: x.isNotNull()), F.lit(False))
    needed = F.greatest(*[F.coalesce(F.size(kind), F.lit(0)) for kind in KINDS]).cast("bigint")
    parsed = parsed.select("batch_no", "text", F.monotonically_increasing_id().alias("_row"), *findings)
    # Nine tables read the result; writing it parses each response once. A rejected one
    # keeps its text, an accepted one its findings.
    parsed = cut_lineage(
        parsed.select(
            "batch_no", "_row", needed.alias("_needed"), accepted.alias("_accepted"),
            F.when(~accepted, F.col("text")).alias("text"), *[F.when(accepted, F.col(k)).alias(k) for k in KINDS],
        )
    )
    placed = ordered.place(parsed.select("batch_no", "_row", "_needed"), ["batch_no", "_row"])
    numbered = ordered.running_sums(placed, {"_upto": F.col("_needed")})
    # Written: its size is known, so it is broadcast while it is small, and no finding moves.
    starts = cut_lineage(numbered.select("_row", (F.col("_upto") - F.col("_needed")).alias("_start")))
    tables = {}
    for kind in KINDS:
        own = parsed.where(F.col("_accepted") & (F.size(kind) > 0)).select("batch_no", "_row", kind).join(starts, "_row")
        exploded = own.select("batch_no", "_start", F.posexplode(kind).alias("_pos", "_f"))
        tables[kind] = exploded.select("batch_no", (F.col("_start") + F.col("_pos")).alias("ord"), "_f.*")
    return tables, parsed.where(~F.col("_accepted")).select("batch_no", "text")
