import random

import pytest

from sessionloom.operators import leaders
from sessionloom.operators.leaders import greedy_leaders


def brute(rows):
    kept, out = {}, {}
    for part, idx, text in sorted(rows):
        words = set(text.split())
        for leader, leader_words in kept.get(part, []):
            if words and leader_words and len(words & leader_words) / len(words | leader_words) >= 0.4:
                out[part, idx] = leader
                break
        else:
            kept.setdefault(part, []).append((idx, words))
            out[part, idx] = idx
    return out


@pytest.mark.parametrize("seed, vocabulary, limit, batch", [(1, 25, 256, 256), (2, 12, 2, 5), (3, 40, 3, 1), (4, 18, 2, 3)])
def test_matches_the_sequential_rule(spark, seed, vocabulary, limit, batch):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)]
    rows = [(rng.choice("AB"), i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6)))) for i in range(220)]
    # A third of the rows are copies and near copies of one text.
    rows += [("A", 1000 + i, "w1 w2 w3 w4 w5" + (f" x{i}" if i % 2 else "")) for i in range(110)]
    df = spark.createDataFrame(rows, "p string, i long, t string")
    got = {(r.p, r.i): r.leader for r in greedy_leaders(df, "p", "i", "t", limit, batch).collect()}
    assert got == brute(rows)


def test_sets_of_very_different_sizes(spark):
    """Size classes meet exactly where two sizes can be similar."""
    rng = random.Random(7)
    vocab = [f"v{k}" for k in range(60)]
    rows = [("A", i, " ".join(rng.sample(vocab, rng.choice([1, 2, 3, 5, 8, 9, 13, 20, 33, 50])))) for i in range(260)]
    df = spark.createDataFrame(rows, "p string, i long, t string")
    got = {(r.p, r.i): r.leader for r in greedy_leaders(df, "p", "i", "t", 4, 8).collect()}
    assert got == brute(rows)


def test_one_common_word_does_not_take_rounds(spark):
    """8,000 commands that share one word, and 2,000 that share all but one of many."""
    rows = [("A", i, f"git x{i}") for i in range(8_000)]
    rows += [("B", i, f"please run the usual nightly build of module m{i}") for i in range(2_000)]
    rows += [("C", i, f"u{i} v{i} w{i} x{i} y{i} git commit push pull") for i in range(500)]
    df = spark.createDataFrame(rows, "p string, i long, t string")
    rounds = []
    out = greedy_leaders(df, "p", "i", "t", watch=rounds.append)
    found = {p: {r.leader for r in out.where(f"p = '{p}'").collect()} for p in "ABC"}
    assert len(found["A"]) == 8_000 and found["B"] == {0} and len(found["C"]) == 500
    assert len(rounds) <= 3


def test_postings_carry_no_words(spark):
    df = spark.createDataFrame([("A", 1, ["a", "b"]), ("A", 2, ["a", "c"])], "part string, idx long, words array<string>")
    postings = leaders._postings(leaders._with_keys(df))
    assert dict(postings.dtypes) == {
        "part": "string", "idx": "bigint", "n": "int", "sketch": "bigint", "key": "bigint", "side": "int", "pos": "int"
    }


def test_short_unrelated_texts_stay_apart(spark):
    rows = [("RepeatedCommand", 1, "ls"), ("RepeatedCommand", 2, "cd"), ("RepeatedPrompt", 1, "fix the bug"), ("RepeatedPrompt", 2, "add tests")]
    df = spark.createDataFrame(rows, "p string, i long, t string")
    assert all(r.i == r.leader for r in greedy_leaders(df, "p", "i", "t").collect())


def test_empty_input(spark):
    df = spark.createDataFrame([], "p string, i long, t string")
    assert greedy_leaders(df, "p", "i", "t").collect() == []
