"""Numbers written as prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions.scores import mapped
from sessionloom.functions.text import bound, trim_all

# Number words that are understood.
NUMBER_WORDS = {
    "zero": 0.0, "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0,
    "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0,
    "thirteen": 13.0, "fourteen": 14.0, "fifteen": 15.0, "sixteen": 16.0, "seventeen": 17.0,
    "eighteen": 18.0, "nineteen": 19.0, "twenty": 20.0, "thirty": 30.0, "forty": 40.0,
    "fifty": 50.0, "sixty": 60.0, "seventy": 70.0, "eighty": 80.0, "ninety": 90.0,
}

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
EXACT_NUMBER = PLAIN_NUMBER.replace("^", r"\A").replace("$", r"\z")
NON_FINITE = r"^[+-]?(inf|infinity|nan)$"


def parse_number(text: Column) -> Column:
    """A float, else the first digit run, else a leading number word, else NULL."""
    cleaned = F.regexp_replace(F.lower(trim_all(text)), r"(-plus)+$", "")

    def read(cleaned: Column) -> Column:
        run = F.regexp_extract(cleaned, r"[0-9.]+", 0)
        return F.coalesce(
            F.when(cleaned.rlike(PLAIN_NUMBER) | cleaned.rlike(NON_FINITE), cleaned.try_cast("double")),
            bound(run, lambda run: F.when(run.rlike(PLAIN_NUMBER), run.try_cast("double"))),
            mapped(F.regexp_extract(cleaned, r"[a-z]+", 0), NUMBER_WORDS),
        )

    return F.when(text.rlike(EXACT_NUMBER), text.try_cast("double")).otherwise(bound(cleaned, read))


def first_number(label: Column) -> Column:
    """The first parsable digit-and-dot run inside a label, else 0."""
    runs = F.regexp_extract_all(label, F.lit(r"[0-9.]+"), 0)
    parsed = F.filter(runs, lambda run: run.rlike(PLAIN_NUMBER))
    return F.coalesce(F.get(parsed, 0).try_cast("double"), F.lit(0.0))
