"""Matching suggested names against a capability registry.

A name matches a tool when one of its keywords occurs anywhere in the tool's
searchable text. Keywords are purely alphanumeric, so an occurrence lies inside
one alphanumeric run of the text: the containment join becomes an equi-join
between a keyword's first characters and the character grams of distinct runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import WORD_BREAK
from sessionloom.session import cut_lineage, widen

GRAM = 4
MAX_MATCHES = 5
# Words too generic to search for.
GENERIC = ("tool", "manager", "assistant", "helper")


def keywords(name: Column) -> Column:
    lowered = F.transform(F.split(name, WORD_BREAK), lambda w: F.lower(w))
    return F.array_distinct(
        F.filter(lowered, lambda w: (F.octet_length(w) >= 4) & ~w.isin(*GENERIC))
    )


def _grams(run: Column, size: int) -> Column:
    last = F.length(run) - size + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def _probe_grams(run: Column) -> Column:
    """All 4-character grams, and shorter ones that still hold the minimum 4 bytes."""
    grams = _grams(run, GRAM)
    for size in range(1, GRAM):
        grams = F.concat(grams, F.filter(_grams(run, size), lambda g: F.octet_length(g) >= 4))
    return F.array_distinct(grams)


def matches(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, existing_matches): first five matching tools alphabetically.

    ``registry`` has ``tool`` and ``searchable`` (lowercase) columns.
    """
    runs = widen(registry).select("tool", F.explode(F.array_distinct(F.split("searchable", WORD_BREAK))).alias("run"))
    # The first tools of a keyword are among the first tools of the runs that hold it, so no more of a run's
    # tools are moved; Spark applies the limit before the shuffle. Equal rows of one tool share a place.
    by_tool = F.dense_rank().over(Window.partitionBy("run").orderBy("tool"))
    listed = runs.where(F.octet_length("run") >= 4).withColumn("_place", by_tool).where(F.col("_place") <= MAX_MATCHES)
    listed = cut_lineage(listed.select("run", "tool").distinct())
    wanted = names.select("name", F.explode(keywords(F.col("name"))).alias("keyword")).distinct()
    probes = listed.select("run").distinct().select(
        "run", F.explode(_probe_grams(F.col("run"))).alias("gram")
    )
    heads = wanted.select("keyword", F.left("keyword", F.lit(GRAM)).alias("gram")).distinct()
    hits = (
        probes.join(heads, "gram").where(F.contains("run", "keyword")).select("run", "keyword").distinct()
    )
    pairs = listed.join(hits, "run").select("tool", "keyword").distinct()
    # The first tools of a name are among the first tools of its keywords.
    place = F.row_number().over(Window.partitionBy("keyword").orderBy("tool"))
    first = pairs.withColumn("_place", place).where(F.col("_place") <= MAX_MATCHES).select("tool", "keyword")
    named = first.join(wanted, "keyword").select("name", "tool").distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("tool"))
    top = named.withColumn("_rank", rank).where(F.col("_rank") <= MAX_MATCHES)
    return top.groupBy("name").agg(F.array_sort(F.collect_list("tool")).alias("existing_matches"))
