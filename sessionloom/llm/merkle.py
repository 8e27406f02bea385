"""Merkle manifest of a table: cogrouped subtree exchange.

Every row is a leaf, the hash of its fields. The leaves of a group (such as a language)
ascend by key; runs of eight consecutive nodes become one node until one is left, the
group's subroot; the subroots, in group order, likewise become the root.

Leaves get their place in their group by one ranged sort and counts per block. Each
superblock of 4,096 places is a whole subtree, so it reduces by itself to one outer
node; outer nodes are numbered by superblock and reduce the same way, tier by tier,
and so do the subroots. Then the tree is walked down: each node of a tier hands its
superblock what lies beside the path above it. In the last step the leaves and the
outer nodes they need meet, cogrouped by superblock: the subtree is reduced again in
place, its runs are joined with the outer nodes to proofs, and every leaf, as it is
now, is folded up to a root. No task holds more than one superblock and one path.

A run knows whether it is its group's only superblock (the first one and not full,
or full and alone on its tier), so a group stops at its subroot, while a short last
superblock is hashed up as many levels as its full neighbours.

Cases: null fields have a mark of their own; the null group comes first and is a group
like any other; null keys come before all others; rows with equal keys stand by their
leaf, so fully equal rows have equal leaves and neighbouring places; empty and long
texts are hashed whole; a lone row is its group's subroot, and its proof is the hash
of nothing where no other group stands beside it; no rows give no rows; only the named
fields are read, so clashing columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.packing import written
from sessionloom.operators import ordered

RUN = 8
LEVELS = 4
BLOCK = RUN**LEVELS
NODES_SQL = "tree string, at bigint, digest string"
PATHS_SQL = "tree string, at bigint, digest string, lefts array<string>, rights array<string>, root string"
PROVED_SQL = (
    "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of all fields: ``-`` for null, else bytes of the value's text, a colon and the text."""
    texts = [f.cast("string") for f in fields]
    counted = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("-")) for c in counted]), 256)


def _reduced(digests: list[str], first: bool) -> list[list[str]]:
    """A superblock's nodes level by level. ``first``: its places begin at 0, so it may be alone."""
    levels = [digests]
    while len(levels[-1]) > 1 or not first and len(levels) <= LEVELS:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def _beside(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """Siblings left and right of the path from ``place`` up to the superblock's node."""
    lefts, rights = [], []
    for level in levels[:-1]:
        start = place - place % RUN
        lefts.append("".join(level[start:place]))
        rights.append("".join(level[place + 1 : start + RUN]))
        place //= RUN
    return lefts, rights


def fold(node: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that ``node`` and the siblings beside its path give."""
    for left, right in zip(lefts, rights):
        node = digest(left + node + right)
    return node


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"at div {BLOCK}"))


def _outer(nodes: DataFrame) -> DataFrame:
    """One outer node per superblock, numbered by superblock."""

    def to_one(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = pdf.sort_values("at")["digest"].tolist()
        return pd.DataFrame(
            {"tree": [keys[0]], "at": [keys[1]], "digest": [_reduced(digests, keys[1] == 0)[-1][0]]}
        )

    return _by_block(nodes).groupBy("tree", "block").applyInPandas(to_one, NODES_SQL)


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the outer nodes above them, up to one for each tree.

    A tier holds a 4,096th of the one below, so there are few, whatever the data.
    """
    tiers = [nodes]
    while (tiers[-1].agg(F.max("at").alias("last")).first()["last"] or 0) > 0:
        tiers.append(written(_outer(tiers[-1]), "nodes"))
    return tiers


def _paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Each node with what stands beside its path to the root; ``above`` has it for the superblocks."""

    def expand(keys, own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own, over = own.sort_values("at"), outer.iloc[0]
        digests = own["digest"].tolist()
        levels = _reduced(digests, keys[1] == 0)
        beside = [_beside(levels, place) for place in range(len(digests))]
        return pd.DataFrame(
            {
                "tree": own["tree"], "at": own["at"], "digest": digests,
                "lefts": [[*b[0], *over["lefts"]] for b in beside],
                "rights": [[*b[1], *over["rights"]] for b in beside], "root": over["root"],
            }
        )

    outer = above.withColumnRenamed("at", "block")
    joined = _by_block(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return joined.applyInPandas(expand, PATHS_SQL)


def _walked_down(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the lowest of ``tiers``, from those of the trees' own nodes."""
    for nodes in reversed(tiers):
        top = _paths(nodes, top)
    return top


def leaves(docs: DataFrame, fields: Sequence[str], group: str, key: str, now: Mapping[str, Column]) -> DataFrame:
    """tree, at, key, digest, now of each row: its place in its group and its leaf.

    ``now`` is the leaf after the given changes, null where it is the same.
    """
    differs = reduce(or_, [~F.col(f).eqNullSafe(later) for f, later in now.items()], F.lit(False))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"),
        F.when(differs, leaf([now.get(f, F.col(f)) for f in fields])).alias("now"),
    )
    # Written first, because the ranged sort reads its input twice.
    placed = ordered.place(written(rows, "leaves"), ["tree", "key", "digest"])
    counted = ordered.running_sums(placed, {"n": F.lit(1)}, ["tree"])
    own = counted.select("tree", (F.col("n") - 1).cast("bigint").alias("at"), "key", "digest", "now")
    return written(own, "placed-leaves")


def prove(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    key: str = "doc_id",
    now: Mapping[str, Column] | None = None,
) -> DataFrame:
    """key (under its own name), leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    The tree is that of the rows as they are; ``now`` gives the later values of some
    fields. ``folded_root`` follows from the later leaf and the original siblings, and
    ``verified`` tells whether it is still the root.
    """
    own = leaves(docs, fields, group, key, now or {})
    tiers = _tiers(own.select("tree", "at", "digest"))
    numbered = ordered.row_number(ordered.place(tiers[-1].select("tree", "digest"), ["tree"]))
    subroots = written(
        numbered.select(F.col("tree").alias("of"), (F.col("row_num") - 1).alias("at"), "digest"), "subroots"
    )
    forest = _tiers(subroots.select(F.lit("").alias("tree"), "at", "digest"))
    none = F.array().cast("array<string>")
    root = forest[-1].select(
        "tree", "at", "digest", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("root")
    )
    of_trees = _walked_down(forest, root).join(subroots.select("of", "at"), "at").select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("at"), "digest", "lefts", "rights", "root"
    )
    above = _walked_down(tiers[1:], of_trees).join(
        of_trees.select("tree", F.col("digest").alias("subroot")), "tree"
    )

    def finish(keys, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, over = rows.sort_values("at"), outer.iloc[0]
        lefts, rights = list(over["lefts"]), list(over["rights"])
        outer_proof = "".join(a + b for a, b in zip(lefts, rights))
        digests = rows["digest"].tolist()
        levels = _reduced(digests, keys[1] == 0)
        proofs, folded = [], []
        for place, (own_leaf, later) in enumerate(zip(digests, rows["now"])):
            left, right = _beside(levels, place)
            proofs.append(digest("".join(a + b for a, b in zip(left, right)) + outer_proof))
            folded.append(fold(later or own_leaf, left + lefts, right + rights))
        return pd.DataFrame(
            {
                "key": rows["key"], "leaf": digests, "subroot": over["subroot"], "root": over["root"],
                "proof_sha256": proofs, "folded_root": folded, "verified": [f == over["root"] for f in folded],
            }
        )

    # Keys pass pandas as text, where a null would turn whole numbers into fractions.
    texts = _by_block(own).withColumn("key", F.col("key").cast("string"))
    outer = above.withColumnRenamed("at", "block")
    done = texts.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, PROVED_SQL)
    return done.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
