"""Scanning JSON documents of any size in parallel, split by split.

A document of one line cannot be read line by line, and read as one value it is one
task and at most 2 GB. Here files are read as *fragments* that end at a closing
brace, which Spark splits like lines, and a lexer runs over them as sums:

* a fragment flips whether text is inside a string once per unescaped quote, and
  changes the depth by one amount if it begins outside a string and by another if
  it begins inside (no valid document has a lone backslash before a brace, so
  escapes never cross a fragment);
* inside a split the flips add up; the depth is added up for both ways the split
  may begin;
* one row per split says what a split does to either state, and running sums over
  a file's splits give every split its true beginning.

A brace that closes an element of the wanted depth ends a *piece*. Pieces within a
split are put together where they lie; the two ends of a split meet their
neighbours by the number of splits with a closed element before them. The cut is
only a guess at the elements: readers parse every piece strictly, and a document
whose pieces are valid and rightly joined is valid itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

BRACE = "}"
FILE, SPLIT = "source_path", "split"


def _depth_change(text: Column) -> Column:
    """Opening less closing brackets of text outside strings; braces that close end a fragment, none has one."""
    without = lambda bracket: F.octet_length(F.replace(text, F.lit(bracket), F.lit("")))
    return F.octet_length(text) + without("]") - without("[") - without("{")


def _unescaped(text: Column) -> Column:
    """Without escaped quotes: pairs of backslashes go first, so one that is left escapes what follows."""
    for escape in ("\\\\", '\\"'):
        text = F.replace(text, F.lit(escape), F.lit(""))
    return text


def _every_other(parts: Column, first: int) -> Column:
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")


def fragments(spark: SparkSession, paths, keep: Column) -> DataFrame:
    """One row per fragment: file, split, row (its order there), value, flips, out, inside."""
    meta = F.col("_metadata")
    raw = spark.read.option("recursiveFileLookup", True).text(paths, lineSep=BRACE).where(keep)
    rows = raw.select(
        meta["file_path"].alias(FILE), meta["file_block_start"].alias(SPLIT), meta["file_size"].alias("size"),
        meta["file_modification_time"].alias("mtime"), F.monotonically_increasing_id().alias("row"), "value",
    )
    parts = F.split(_unescaped(F.col("value")), '"')
    lexed = rows.withColumn("parts", parts)
    return lexed.select(
        *rows.columns, ((F.size("parts") - 1) % 2).alias("flips"),
        _depth_change(_every_other(F.col("parts"), 0)).alias("out"),
        _depth_change(_every_other(F.col("parts"), 1)).alias("inside"),
    )


def _lexed(rows: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(fragments with ``closed``: closed elements so far in the split, one row per split)."""
    in_split = Window.partitionBy(FILE, SPLIT).orderBy("row")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("began", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)

    def change(state: int) -> Column:
        """Change of depth, its brace included, when the split began in ``state`` (1: inside a string)."""
        begins_out, ends_out = F.col("began") == state, (F.col("began") + F.col("flips")) % 2 == state
        return F.when(begins_out, F.col("out")).otherwise(F.col("inside")) - F.when(ends_out, 1).otherwise(0)

    summed = started.withColumns({f"d{s}": F.sum(change(s)).over(so_far) for s in (0, 1)})
    whole = rows.groupBy(FILE, SPLIT)
    flips = whole.agg((F.sum("flips") % 2).alias("flip"))
    ends = summed.groupBy(FILE, SPLIT).agg(F.max_by(F.struct("d0", "d1"), "row").alias("end"))
    earlier = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    begun = flips.join(ends, [FILE, SPLIT]).withColumn("state", F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2)
    moved = F.when(F.col("state") == 0, F.col("end.d0")).otherwise(F.col("end.d1"))
    splits = begun.withColumn("deep", F.coalesce(F.sum(moved).over(earlier), F.lit(0))).select(FILE, SPLIT, "state", "deep")

    known = summed.join(splits, [FILE, SPLIT])
    at = F.col("deep") + F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1"))
    outside = (F.col("state") + F.col("began") + F.col("flips")) % 2 == 0
    closing = (outside & (at == depth)).cast("int")
    marked = known.withColumn("closes", closing).withColumn("closed", F.sum("closes").over(so_far) - F.col("closes"))
    return marked, marked.groupBy(FILE, SPLIT).agg(F.sum("closes").alias("total"))


def _joined(part: Column) -> Column:
    """The texts of a group in order: one element of a document, or its text between two."""
    return F.array_join(F.array_sort(F.collect_list(part))["text"], "")


def pieces(spark: SparkSession, paths, keep: Column, depth: int) -> DataFrame:
    """source_path, mtime, key, text, first, last, decodable: the text between closed elements.

    ``first`` and ``last`` mark a file's outer pieces; a file that ends with its last closed
    element has no last piece. ``key`` orders a file's pieces.
    """
    rows = cut_lineage(fragments(spark, paths, keep))  # lexed once; its numbers are read several times
    marked, totals = _lexed(rows, depth)
    earlier = Window.partitionBy(FILE).orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    with_some = F.coalesce(F.sum((F.col("total") > 0).cast("int")).over(earlier), F.lit(0))
    chained = totals.withColumn("chain", with_some)
    ended = chained.groupBy(FILE).agg(F.sum((F.col("total") > 0).cast("int")).alias("chains"))
    # The brace after a file's last fragment is there only if the file's bytes say so.
    sizes = rows.groupBy(FILE).agg(
        (F.first("size") - F.sum(F.octet_length("value") + 1) + 1).alias("braces"), F.max(F.struct(SPLIT, "row")).alias("tail")
    )
    own = marked.join(chained, [FILE, SPLIT])
    part = F.when(F.col("closed") == 0, F.col("chain")).when(
        F.col("closed") == F.col("total"), F.col("chain") + 1
    )
    held = own.withColumn("part", part).groupBy(FILE, SPLIT, "closed").agg(
        F.first("part").alias("part"), F.first("mtime").alias("mtime"), F.min("row").alias("row"), F.max("row").alias("end"),
        _joined(F.struct("row", F.concat("value", F.lit(BRACE)).alias("text"))).alias("text"),
        F.bool_and(F.is_valid_utf8("value")).alias("decodable"),
    )
    ends = F.struct(SPLIT, F.col("end").alias("row")).alias("end")
    shape = [FILE, "mtime", F.struct(SPLIT, "row").alias("key"), "text", "part", "decodable", ends]
    inner = held.where(F.col("part").isNull()).select(*shape)
    met = (
        held.where(F.col("part").isNotNull()).select(*shape).groupBy(FILE, "part")
        .agg(
            F.first("mtime").alias("mtime"), F.min("key").alias("key"), F.max("end").alias("end"),
            _joined(F.struct("key", "text")).alias("text"),
            F.bool_and("decodable").alias("decodable"),
        )
        .select(FILE, "mtime", "key", "text", "part", "decodable", "end")
    )
    joined = inner.unionByName(met).join(ended, FILE).join(sizes, FILE)
    cut = (F.col("end") == F.col("tail")) & (F.col("braces") == 0)
    return joined.select(
        FILE, "mtime", "key", F.when(cut, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.col("part") == 0, F.lit(False)).alias("first"),
        F.coalesce(F.col("part") == F.col("chains"), F.lit(False)).alias("last"), "decodable",
    )
