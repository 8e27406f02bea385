import pytest


def frame(spark, rows, schema, parts=3):
    """A small table over several partitions, in which no order can be relied on."""
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.fixture(scope="session")
def table(spark):
    return lambda rows, schema, parts=3: frame(spark, rows, schema, parts)


#: Documents that each operator must take: null, empty, blank, repeated, long, odd characters.
LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(9_000))
ODD = [
    (1, "Plain words of a short text, twice told."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG),
    (6, "Plain words of a short text, twice told."), (7, "Äpfel über\u00a0Öl \u2028 zwei\x1cdrei 😀 ok"), (8, "one"),
    (9, "one two three"), (10, LONG), (11, "\n\nlead  and trail \n"), (12, "it's don't 'quoted' 3.14 e\u0301 ﬁ"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd documents with further columns, some named like results."""
    rows = [(i, t, None if i % 2 else "xx", float(i)) for i, t in ODD]
    return frame(spark, rows, "doc_id bigint, text string, spans string, score double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
