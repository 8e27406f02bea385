"""TF-IDF weights and cosine between neighbouring documents.

Vectors stay in long form (document, term, weight), so a document set of any
size is a shuffle, never an in-memory matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import each_word, tokens, word_set
from sessionloom.operators.lookups import join_by_key
from sessionloom.session import cut_lineage

HOT_TERMS = 100_000  # a term and its count, some 10 MB to broadcast


def term_frequency(docs: DataFrame, ids: Sequence[str], text: str = "content") -> DataFrame:
    """(ids, term, occurrences, tf) where tf = occurrences / words in the document."""
    words = docs.select(*ids, tokens(F.col(text)).alias("_words"))
    words = words.withColumn("_total", F.size("_words"))
    return (
        words.select(*ids, "_total", each_word(F.col("_words")).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*ids, "term", "_total")
        .agg(F.count("*").alias("occurrences"))
        .withColumn("tf", F.col("occurrences") / F.greatest(F.col("_total"), F.lit(1)))
        .drop("_total")
    )


def document_frequency(docs: DataFrame, text: str = "content", within: Sequence[str] = ()):
    """(within, term, df): documents containing the term, counted map-side first."""
    return (
        docs.select(*within, each_word(word_set(F.col(text))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(*within, "term")
        .agg(F.count("*").alias("df"))
    )


def weights(
    docs: DataFrame, ids: Sequence[str], text: str = "content", corpus: DataFrame | None = None
) -> DataFrame:
    """(ids, term, weight) with idf = ln(n/df + 1) over ``corpus`` (default: ``docs``)."""
    corpus = docs if corpus is None else corpus
    # Texts move once, by their ids, instead of their words; then only words too rare to broadcast move.
    placed = docs.select(*ids, text).repartition(*ids)
    frequency = cut_lineage(term_frequency(placed, ids, text).select(*ids, "term", "tf"))
    terms = document_frequency(corpus, text)
    joined = join_by_key(frequency, terms, ["term"], "df", F.struct(*ids), max_hot=HOT_TERMS, stored=True)
    n = corpus.agg(F.count("*")).scalar()
    return joined.select(
        *ids, "term", (F.col("tf") * F.log(n / F.col("df") + 1.0)).alias("weight")
    )


def weights_within(
    docs: DataFrame, ids: Sequence[str], within: Sequence[str], text: str = "content"
) -> DataFrame:
    """As ``weights`` with each ``within`` group as its own corpus; needs a ``_n`` column."""
    frequency = term_frequency(docs, [*within, *ids, "_n"], text)
    joined = join_by_key(
        frequency,
        document_frequency(docs, text, within),
        [*within, "term"],
        "df",
        F.struct(*ids),
    )
    return joined.select(
        *within, *ids, "term", (F.col("tf") * F.log(F.col("_n") / F.col("df") + 1.0)).alias("weight")
    )


def neighbour_cosine(weighted: DataFrame, seq: str, within: Sequence[str] = ()) -> DataFrame:
    """(within, seq, cosine) between documents ``seq - 1`` and ``seq``.

    Each weight is sent to the pair on either side of it, so one shuffle by pair
    gives the dot product and both norms. Pairs sharing no term are absent or 0.
    """
    here = F.struct(F.col(seq).alias("pair"), F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    after = F.struct((F.col(seq) + 1).alias("pair"), F.lit(0.0).alias("a"), F.col("weight").alias("b"))
    sides = weighted.select(*within, "term", F.inline(F.array(here, after)))
    keys = [*within, "pair"]
    per_term = (
        sides.repartition(*keys)
        .groupBy(*keys, "term")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    sums = per_term.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"),
        F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"),
    )
    norm = F.sqrt("aa") * F.sqrt("bb")
    cosine = F.when(norm > 0, F.col("dot") / norm).otherwise(F.lit(0.0))
    return sums.where(F.col("dot") > 0).select(*within, F.col("pair").alias(seq), cosine.alias("cosine"))
