import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import prose_numbers, redact, scores, text
from sessionloom.operators.normalize import normalize_content
from sessionloom.sources import responses


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, value, make):
    return values(spark, [(value,)], "x string", make(F.col("x")))[0][0]


def test_tokens_split_identifiers_and_drop_stopwords(spark):
    got = one(spark, "The response.in_progress Événement, of API2!", text.tokens)
    assert got == ["response", "in", "progress", "événement", "api2"] or got == ["response", "progress", "événement", "api2"]
    assert "in" not in got
    assert one(spark, "", text.tokens) == []


def test_token_case_folding_happens_after_the_split(spark):
    assert one(spark, "İzmir", text.tokens) == ["i̇zmir"]


def test_jaccard_near_duplicates(spark):
    rows = [
        ("Responses API missing handler for function_call_arguments.delta events", "Responses API missing handler for in_progress events"),
        ("Responses API missing handler for function_call_arguments.delta events", "Docker healthcheck exceeds latency threshold repeatedly"),
        ("", "anything"),
    ]
    got = values(spark, rows, "a string, b string", text.jaccard(text.word_set(F.col("a")), text.word_set(F.col("b"))))
    assert got[0][0] > 0.4 and got[1][0] < 0.1 and got[2][0] == 0.0


def test_truncation(spark):
    assert one(spark, "aé🙂z", lambda c: text.truncate_chars(c, 3)) == "aé🙂"
    assert one(spark, "x" * 240, lambda c: text.truncate_bytes(c, 240)) == "x" * 240
    assert one(spark, "x" * 241, lambda c: text.truncate_bytes(c, 240)) == "x" * 239 + "…"
    cut = one(spark, "é" * 200, lambda c: text.truncate_bytes(c, 240))
    assert cut == "é" * 119 + "…"
    assert one(spark, "🙂" * 100, lambda c: text.truncate_bytes(c, 240)) == "🙂" * 59 + "…"


def test_normalisation_order(spark):
    assert one(spark, "  Hello  　 world\t\n ", normalize_content) == "Hello world"
    assert one(spark, "[system]  [debug]", normalize_content) == " "
    assert one(spark, "[system] x", normalize_content) == " x"
    assert one(spark, "[SYSTEM] x", normalize_content) == "[SYSTEM] x"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("12-plus", 12.0), ("high", None), ("three", 3.0), (" Ninety ", 90.0), ("-5 minutes", 5.0), ("-5", -5.0),
        ("about 20 min", 20.0), ("1.5h", 1.5), ("1e3", 1000.0), ("1.2.3", None), ("", None), ("twenty-five", 20.0),
        (".5", 0.5), ("inf", math.inf),
    ],
)
def test_prose_numbers(spark, given, expected):
    assert one(spark, given, prose_numbers.parse_number) == expected


def test_first_number(spark):
    assert one(spark, "1.5 hours/day", prose_numbers.first_number) == 1.5
    assert one(spark, "~22 min/day (evidence-based)", prose_numbers.first_number) == 22.0
    assert one(spark, "1.2.3 then 7", prose_numbers.first_number) == 7.0
    assert one(spark, "none", prose_numbers.first_number) == 0.0


def test_redaction(spark):
    raw = "api_key=abc123 mail bob@example.com at /home/alice/x; Authorization: Bearer zzz token = deadbeef"
    got = one(spark, raw, redact.redact_text)
    assert "abc123" not in got and "bob@" not in got and "alice" not in got and "zzz" not in got
    assert "token = deadbeef" in got
    assert one(spark, "ghp_" + "a" * 24, redact.redact_text) == "[REDACTED_TOKEN]"
    assert one(spark, ".".join(["a" * 20, "b" * 10, "c" * 10]), redact.redact_text) == "[REDACTED_JWT]"


def test_attribute_redaction(spark):
    attributes = F.try_variant_get(F.try_parse_json("x"), "$", "map<string,variant>")
    kept = one(spark, '{"model":"m","Prompt":"p","access_token":"t","n":1}', lambda _: redact.redact_attributes(attributes))
    assert kept == {"model": "m"}


def test_scores(spark):
    rows = [(float("nan"),), (float("inf"),), (-2.0,), (0.4,), (7.0,)]
    got = [r[0] for r in values(spark, rows, "x double", scores.finite_clamp(F.col("x"), 0.0, 1.0))]
    assert got == [0.0, 0.0, 0.0, 0.4, 1.0]
    rows = [(200.0, 20.0), (50.0, 5.0)]
    got = [r[0] for r in values(spark, rows, "f double, h double", scores.impact_score(F.col("f"), F.col("h")))]
    assert got == [1.0, 0.5]


def test_impact_label(spark):
    rows = [(22.0, "High"), (None, "Low"), (2.5, "Low"), (-3.0, "Low")]
    got = [r[0] for r in values(spark, rows, "m double, p string", scores.impact_label(F.col("m"), F.col("p")))]
    assert got == ["~22 min/day (evidence-based)", "Estimated impact: Low", "~2 min/day (evidence-based)", "~0 min/day (evidence-based)"]


def test_two_decimals_round_the_exact_binary_value(spark):
    rng = random.Random(1)
    numbers = [16.025, 2.675, 0.125, 0.375, 1.005, 0.005, 0.015, 0.025, 0.0] + [rng.randrange(9000) / 40 for _ in range(200)]
    got = [r[0] for r in values(spark, [(n,) for n in numbers], "x double", scores.two_decimals(F.col("x")))]
    assert got == [str(Decimal(n).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for n in numbers]


def test_trend_direction_and_bars(spark):
    rows = [(7.0, 0.0), (10.0, 10.0), (1.0, 20.0)]
    got = values(spark, rows, "c double, p double", scores.trend_direction(F.col("c"), F.col("p")), scores.trend_bars(F.col("c"), F.col("p")))
    assert [g[0] for g in got] == ["Increasing", "Stable", "Decreasing"]
    assert got[0][1] == " Current    7.00  " + "█" * 20 + "\nPrevious    0.00  "
    assert got[2][1] == " Current    1.00  █\nPrevious   20.00  " + "█" * 20


def test_repeated_values_are_worked_out_once(spark):
    df = spark.createDataFrame([("12-plus",), ("1e3",), (" Seven times",), ("about .5",), ("5\u0085",), ("nan",), (None,)], "x string")
    number = prose_numbers.parse_number(F.col("x"))
    assert str(number).count("lower") == 1
    got = [r[0] for r in df.select(number).collect()]
    assert got[:5] == [12.0, 1000.0, 7.0, 0.5, 5.0] and got[5] != got[5] and got[6] is None
    value = responses.parse_object(F.col("x"))
    assert str(value).count("nullif") == 1
