"""Greedy leader clustering by word-set Jaccard, as rounds of joins on narrow keys.

Taking items in index order, an item that is similar to no earlier leader
becomes a leader; any other item belongs to its earliest similar leader. The
leaders are the lexicographically first maximal independent set of the
similarity graph, so an item is settled as soon as its smaller-index neighbours
are, wherever it stands.

Candidates. Two sets of a and b words with Jaccard >= 2/5 share at least
2(a+b)/7 words, so the a - o + 1 and b - o + 1 rarest words of the two, o being
that overlap, have a word in common. The overlap grows with both sizes, hence a
key is a rare word *and* the size classes of both sides: two words need both
words shared, and ``git x`` meets ``git y`` under no key at all, however many
of them there are. A key that has items on one side only is dropped at the start.
Keys are 64-bit hashes with the word's position and a parity sketch of the set;
positions bound the overlap from above and sketches the difference from below,
and word arrays are fetched only for the pairs left.

Rounds. The graph itself is never written out, because a group of near copies
has a square of edges. Each round settles two kinds of items:

* the first ``BATCH`` undecided items of every part, all of whose undecided
  predecessors are in that batch: the sequential rule decides them;
* items that have only a few earlier ones on the other side of each of their keys,
  so that all their earlier candidates are looked at, and that resemble none of them.

The new leaders then absorb what resembles them, before it is compared with
anything else. Identical word sets are one item throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import word_set
from sessionloom.operators.lookups import join_by_key
from sessionloom.session import cut_and_count, cut_lineage

RANK_LIMIT = 256  # Spark applies its per-key limit before the shuffle
FIRST_LIMIT = 16
BATCH = 256
#: Smallest size of each size class: exact up to eight words, then a quarter more each time.
SIZE_CLASSES = [1, 2, 3, 4, 5, 6, 7, 8]
while SIZE_CLASSES[-1] < 1 << 30:
    SIZE_CLASSES.append(SIZE_CLASSES[-1] * 5 // 4 + 1)


def _similar(a: Column, b: Column) -> Column:
    """Jaccard >= 2/5 in whole numbers, so no rounding is involved."""
    shared = F.size(F.array_intersect(a, b))
    return shared * 5 >= (F.size(a) + F.size(b) - shared) * 2


def _least_overlap(a: Column, b: Column) -> Column:
    """Shared words that sets of these sizes need at least: 2(a+b)/7, rounded up."""
    return F.floor(((a + b) * 2 + 6) / 7).cast("int")


def _size_class(size: Column) -> Column:
    """Number of the class, from 1."""
    starts = F.array(*[F.lit(s) for s in SIZE_CLASSES])
    return F.size(F.filter(starts, lambda s: s <= size))


def _keys() -> Column:
    """(key, side, pos) for every size class that a similar set may have: its rarest words that must meet.

    ``side`` is -1 and 1 for the smaller and the larger class under a key, 0 if they are
    the same. Reads ``words`` (rarest first), ``n`` and the classes ``own``, ``low``, ``high``.
    """
    own, size, starts = F.col("own"), F.col("n"), F.array(*[F.lit(s) for s in SIZE_CLASSES])

    def of_class(other: Column) -> Column:
        overlap = _least_overlap(size, F.greatest(F.element_at(starts, other), F.col("least")))
        prefix = F.slice("words", F.lit(1), F.greatest(size - overlap + 1, F.lit(0)))
        key = lambda word: F.xxhash64(word, F.least(own, other), F.greatest(own, other))
        return F.transform(
            prefix,
            lambda word, pos: F.struct(
                key(word).alias("key"), F.signum(own - other).cast("int").alias("side"), pos.alias("pos")
            ),
        )

    return F.flatten(F.transform(F.sequence("low", "high"), of_class))


def _sketch(words: Column) -> Column:
    """64 parity bits: two sets differ in at least as many words as their sketches in bits."""
    one = F.lit(1).cast("bigint")
    bits = F.transform(words, lambda w: F.call_function("shiftleft", one, F.pmod(F.hash(w), F.lit(64))))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseXOR(b))


def _with_keys(classes: DataFrame) -> DataFrame:
    """Add ``n`` (words), ``sketch`` and ``keys``; ``words`` then run from the rarest on."""
    words = classes.select("part", "idx", F.explode("words").alias("word"))
    counts = words.groupBy("part", "word").agg(F.count("*").alias("df"))
    ranked = join_by_key(words, counts, ["part", "word"], "df", F.col("idx"))
    # One set's words: bounded by the length of one text.
    listed = ranked.groupBy("part", "idx").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    rows = listed.select("part", "idx", F.col("ranked.word").alias("words")).withColumn("n", F.size("words"))
    least = F.floor((F.col("n") * 2 + 4) / 5).cast("int")
    rows = rows.withColumn("least", least).withColumns(
        {
            "own": _size_class(F.col("n")), "low": _size_class(F.col("least")),
            "high": _size_class(F.floor(F.col("n") * 5 / 2).cast("int")), "sketch": _sketch(F.col("words")),
        }
    )
    keyed = cut_lineage(rows.select("part", "idx", "words", "n", "sketch", _keys().alias("keys")))
    each = keyed.select("part", "idx", F.inline("keys"))
    sides = each.groupBy("part", "key").agg(
        F.count("*").alias("_n"), F.min("side").alias("_low"), F.max("side").alias("_high")
    )
    meeting = sides.where((F.col("_n") > 1) & ((F.col("_low") < F.col("_high")) | (F.col("_low") == 0)))
    kept = join_by_key(each, meeting, ["part", "key"], "_n", F.col("idx")).where(F.col("_n").isNotNull())
    kept = kept.groupBy("part", "idx").agg(F.collect_list(F.struct("key", "side", "pos")).alias("keys"))
    return keyed.drop("keys").join(kept, ["part", "idx"], "left").withColumn("keys", F.coalesce("keys", F.array()))


def _postings(nodes: DataFrame) -> DataFrame:
    return nodes.select("part", "idx", "n", "sketch", F.inline("keys"))


def _pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """(part, idx, later): candidate pairs, each once, from two sets of postings."""
    left = earlier.select("part", "key", "side", "idx", "n", "pos", "sketch")
    right = later.select(
        "part", "key", (-F.col("side")).alias("side"), F.col("idx").alias("later"), F.col("n").alias("n2"), F.col("pos").alias("pos2"),
        F.col("sketch").alias("sketch2"),
    )
    needed = _least_overlap(F.col("n"), F.col("n2"))
    # Words before, at and after the shared one that can be common at most.
    reach = F.least("pos", "pos2") + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    differs = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2")))
    return (
        right.join(left, ["part", "key", "side"])
        .where(F.col("idx") < F.col("later"))
        .where(F.least("n", "n2") * 5 >= F.greatest("n", "n2") * 2)
        .where(reach >= needed)
        .where(differs <= F.col("n") + F.col("n2") - 2 * needed)
        .select("part", "idx", "later")
        .distinct()
    )


def _verified(pairs: DataFrame, earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The candidate pairs that are similar."""
    left = earlier.select("part", "idx", F.col("words").alias("_a"))
    right = later.select("part", F.col("idx").alias("later"), F.col("words").alias("_b"))
    held = pairs.join(left, ["part", "idx"]).join(right, ["part", "later"])
    return held.where(_similar(F.col("_a"), F.col("_b"))).select("part", "idx", "later")


def _first_of_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leaders among a part's first undecided items, by the sequential rule."""
    leaders, kept = [], []
    for idx, words in sorted(zip(pdf["idx"], map(frozenset, pdf["words"]))):
        for other in kept:
            shared = len(words & other)
            if shared * 5 >= (len(words) + len(other) - shared) * 2:
                break
        else:
            leaders.append(idx)
            kept.append(words)
    return pd.DataFrame({"part": pdf["part"].iloc[0], "idx": leaders})


def _new_leaders(undecided: DataFrame, rank_limit: int, batch: int) -> DataFrame:
    """(part, idx) of undecided items that are leaders for certain."""
    first = Window.partitionBy("part").orderBy("idx")
    head = undecided.select("part", "idx", "words", F.row_number().over(first).alias("_rank"))
    head = head.where(F.col("_rank") <= batch).drop("_rank")
    part = undecided.schema["part"].dataType.simpleString()
    by_rule = head.groupBy("part").applyInPandas(_first_of_batch, f"part {part}, idx bigint")

    postings = _postings(undecided)
    by_index = Window.partitionBy("part", "key", "side").orderBy("idx")
    ranked = postings.withColumn("_rank", F.row_number().over(by_index)).where(F.col("_rank") <= rank_limit + 1)
    near = ranked.where(F.col("_rank") <= rank_limit)
    # What stands behind the first unseen item of the other side has candidates that are not looked at.
    unseen = ranked.where(F.col("_rank") > rank_limit).select(
        "part", "key", (-F.col("side")).alias("side"), F.col("idx").alias("_unseen")
    )
    waiting = postings.join(unseen, ["part", "key", "side"]).where(F.col("idx") > F.col("_unseen"))
    complete = undecided.join(waiting.select("part", "idx"), ["part", "idx"], "left_anti")
    blocked = _verified(_pairs(near, _postings(complete)), undecided, complete)
    blocked = blocked.select("part", F.col("later").alias("idx"))
    free = complete.select("part", "idx").join(blocked, ["part", "idx"], "left_anti")
    return by_rule.unionByName(free).distinct()


def _absorbed(chosen: DataFrame, others: DataFrame) -> DataFrame:
    """(part, idx, leader): smallest newly chosen leader similar to each other item."""
    found = _verified(_pairs(_postings(chosen), _postings(others)), chosen, others)
    named = found.select("part", F.col("idx").alias("leader"), F.col("later").alias("idx"))
    return named.groupBy("part", "idx").agg(F.min("leader").alias("leader"))


def greedy_leaders(
    items: DataFrame, part: str, index: str, text: str, rank_limit: int = RANK_LIMIT, batch: int = BATCH,
    watch: Callable[[int], None] | None = None,
) -> DataFrame:
    """(part, index, leader) for every row; ``index`` is unique inside ``part``.

    ``watch`` is told how many items each round begins with.
    """
    sets = items.select(
        F.col(part).alias("part"), F.col(index).cast("bigint").alias("idx"),
        F.array_sort(word_set(F.col(text))).alias("words"),
    )
    sets = cut_lineage(sets.withColumn("set_key", F.sha2(F.concat_ws(" ", "words"), 256)))
    full = sets.where(F.size("words") > 0)
    classes = full.groupBy("part", "set_key").agg(
        F.min("idx").alias("idx"), F.min_by("words", "idx").alias("words"), F.count("*").alias("copies")
    )
    open_item = F.col("leader").isNull()
    state, undecided_left = cut_and_count(
        _with_keys(classes.select("part", "idx", "words")).withColumn("leader", F.lit(None).cast("bigint")),
        open_item,
    )

    settled = []
    limit = min(FIRST_LIMIT, rank_limit)
    while undecided_left:
        if watch:
            watch(undecided_left)
        new = cut_lineage(_new_leaders(state.where(open_item), limit, batch))
        limit = min(limit * 4, rank_limit)
        chosen = state.join(new, ["part", "idx"], "left_semi")
        others = state.join(new, ["part", "idx"], "left_anti")
        settled.append(new.select("part", "idx", F.col("idx").alias("leader")))
        found = _absorbed(chosen, others).withColumnRenamed("leader", "_found")
        updated, undecided_left = cut_and_count(
            others.join(found, ["part", "idx"], "left")
            .withColumn("leader", F.least("leader", "_found"))
            .drop("_found"),
            open_item,
        )
        if not undecided_left:
            settled.append(updated.select("part", "idx", "leader"))
            break
        # A member stays open while an undecided item precedes its leader:
        # that item may yet become an earlier leader.
        lowest = updated.where(open_item).groupBy("part").agg(F.min("idx").alias("_lowest"))
        # One row per part, and parts are the eight pattern types: bounded.
        marked = updated.join(F.broadcast(lowest), "part", "left")
        closed = F.col("leader").isNotNull() & (
            F.col("_lowest").isNull() | (F.col("leader") < F.col("_lowest"))
        )
        settled.append(marked.where(closed).select("part", "idx", "leader"))
        state = marked.where(~closed).drop("_lowest")

    by_class = full.select("part", "idx", "set_key")
    empty = sets.where(F.size("words") == 0).select(
        F.col("part").alias(part), F.col("idx").alias(index), F.col("idx").alias("leader")
    )
    if not settled:
        return empty
    decided = settled[0]
    for table in settled[1:]:
        decided = decided.unionByName(table)
    class_leader = classes.drop("words").join(decided, ["part", "idx"]).drop("idx")
    members = join_by_key(by_class, class_leader, ["part", "set_key"], "copies", F.col("idx"))
    return members.select(
        F.col("part").alias(part), F.col("idx").alias(index), "leader"
    ).unionByName(empty)
