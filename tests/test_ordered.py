import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.operators import ordered
from sessionloom.operators.lookups import join_by_key


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # One key owns half of the rows, and many rows share one instant.
    data = [
        ("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}", rng.choice([7, rng.randrange(50)]), i, rng.randrange(9))
        for i in range(900)
    ]
    return spark.createDataFrame(data, "k string, t long, id long, v long").repartition(4)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_matches_plain_windows(rows, keys):
    placed = ordered.place(rows, [*keys, "t", "id"])
    assert placed.select("_block").distinct().count() > 1
    out = ordered.row_number(placed)
    out = ordered.previous(out, ["v", "id"], keys)
    out = ordered.running_sums(out, {"total": F.col("v"), "n": F.lit(1)}, keys)
    per_key = Window.partitionBy(*keys).orderBy("t", "id")
    overall = Window.orderBy(*keys, "t", "id")
    expected = rows.select(
        "id", F.lag("v").over(per_key).alias("e_v"), F.lag("id").over(per_key).alias("e_id"),
        F.sum("v").over(per_key.rowsBetween(Window.unboundedPreceding, 0)).alias("e_total"),
        F.row_number().over(per_key).alias("e_n"), F.row_number().over(overall).alias("e_row"),
    )
    wrong = out.join(expected, "id").where(
        ~(
            F.col("prev_v").eqNullSafe(F.col("e_v")) & F.col("prev_id").eqNullSafe(F.col("e_id"))
            & (F.col("total") == F.col("e_total")) & (F.col("n") == F.col("e_n")) & (F.col("row_num") == F.col("e_row"))
        )
    )
    assert out.count() == 900
    assert wrong.count() == 0


@pytest.mark.parametrize("max_hot", [1, 3, 10_000])
def test_join_by_key_answers_hot_and_cold_keys(rows, max_hot):
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    joined = join_by_key(rows, counts, ["k"], "n", F.col("id"), max_hot)
    expected = rows.join(counts, "k")
    assert sorted(map(tuple, joined.select("id", "n", "top").collect())) == sorted(
        map(tuple, expected.select("id", "n", "top").collect())
    )


def test_join_by_key_keeps_unmatched_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("z", 2)], "k string, id long")
    table = spark.createDataFrame([("a", 1, "x")], "k string, n long, val string")
    got = {r.id: r.val for r in join_by_key(rows, table, ["k"], "n", F.col("id")).collect()}
    assert got == {1: "x", 2: None}


def test_stored_rows_join_as_others_do(spark):
    rows = spark.createDataFrame([(k, n) for k in range(9) for n in range(1 + 30 * (k < 2))], "k int, n int").cache()
    table = rows.where("k < 7").groupBy("k").count()
    found = [join_by_key(rows, table, ["k"], "count", rows["n"], max_hot=6, stored=stored) for stored in (False, True)]
    moved, kept = [sorted(df.collect(), key=str) for df in found]
    assert moved == kept and len(kept) == rows.count() and {r["count"] for r in kept} == {31, 1, None}
