import datetime as dt
import math
import random
import re
from collections import Counter

import pytest

from sessionloom.functions.text import STOPWORDS
from sessionloom.operators import segment

START = dt.datetime(2024, 1, 1)


def words(text):
    return [w.lower() for w in re.split(r"[^\w]+|_", text) if w and w.lower() not in STOPWORDS]


def vectors(texts):
    df = Counter(t for text in texts for t in set(words(text)))
    out = []
    for text in texts:
        tokens = words(text)
        out.append({t: c / len(tokens) * math.log(len(texts) / df[t] + 1) for t, c in Counter(tokens).items()})
    return out


def cosine(a, b):
    dot = sum(w * b.get(t, 0.0) for t, w in a.items())
    norm = math.sqrt(sum(w * w for w in a.values())) * math.sqrt(sum(w * w for w in b.values()))
    return dot / norm if norm else 0.0


def brute(rows, keyed):
    """The sequential rule over (id, user, ts, content)."""
    rows = sorted(rows, key=lambda r: ((r[1],) if keyed else ()) + (r[2], r[0]))
    vecs = vectors([r[3] for r in rows])
    number, out = 0, {}
    for i, row in enumerate(rows):
        first = i == 0 or (keyed and rows[i - 1][1] != row[1])
        if first:
            number = 1
        elif (row[2] - rows[i - 1][2]) // dt.timedelta(minutes=1) > 30 or cosine(vecs[i - 1], vecs[i]) < 0.3:
            number += 1
        out[row[0]] = number
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id string, ts timestamp_ntz, content string")


@pytest.mark.parametrize("keyed", [False, True])
def test_matches_the_sequential_rule(spark, keyed):
    rng = random.Random(11)
    vocab = ["build", "rust", "deploy", "docker", "index", "cache"]
    rows, t = [], START
    for i in range(250):
        t += dt.timedelta(seconds=rng.choice([5, 60, 1859, 1860, 4000]) if rng.random() < 0.4 else 30)
        rows.append((i, "hot" if rng.random() < 0.6 else f"u{rng.randrange(3)}", t, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 4)))))
    keys = ["user_id"] if keyed else []
    segmented = segment.segment(frame(spark, rows), keys, ["ts", "id"])
    got = {r.id: r.segment_no for r in segmented.collect()}
    assert got == brute(rows, keyed)
    summary = segment.summarize(segmented, keys).collect()
    assert sum(r.entries for r in summary) == 250
    by_segment = {}
    for r in rows:
        by_segment.setdefault((r[1] if keyed else None, got[r[0]]), []).append(r)
    for r in summary:
        members = sorted(by_segment[r.user_id if keyed else None, r.segment_no], key=lambda m: (m[2], m[0]))
        vecs = vectors([m[3] for m in members])
        sims = [cosine(a, b) for a, b in zip(vecs, vecs[1:])]
        assert r.confidence == pytest.approx(sum(sims) / len(sims) if sims else 1.0)
        assert (r.start_time, r.end_time) == (members[0][2], members[-1][2])
        spread = Counter(w for m in members for w in set(words(m[3])) if len(w.encode()) > 3)
        expected = min(spread, key=lambda w: (-spread[w], w)) if spread else "general"
        assert r.topic == expected


def test_gap_is_truncated_minutes(spark):
    rows = [
        (1, "u", START, "same text"), (2, "u", START + dt.timedelta(minutes=30, seconds=59), "same text"),
        (3, "u", START + dt.timedelta(minutes=61, seconds=59), "same text"),
    ]
    got = {r.id: (r.gap_minutes, r.splits) for r in segment.gaps(frame(spark, rows), [], ["ts", "id"]).collect()}
    assert got == {1: (None, True), 2: (30, False), 3: (31, True)}


def test_topic_shift_splits(spark):
    texts = ["debug the rust build", "the rust build failed", "completely unrelated topic here"]
    rows = [(i, "u", START + dt.timedelta(seconds=10 * i), t) for i, t in enumerate(texts)]
    segmented = segment.segment(frame(spark, rows), [], ["ts", "id"])
    summary = {r.segment_no: r for r in segment.summarize(segmented, []).collect()}
    assert len(summary) == 2
    assert summary[1].topic in ("build", "rust")


def test_texts_are_not_ordered_or_written(spark, monkeypatch):
    """Only keys and order columns reach the placed table; texts join the result once."""
    placed = []
    place = segment.ordered.place
    monkeypatch.setattr(segment.ordered, "place", lambda df, order: placed.append(df.columns) or place(df, order))
    rows = [(i, f"u{i % 2}", START + dt.timedelta(minutes=20 * i), "build rust") for i in range(20)]
    wide = segment.segment(frame(spark, rows), ["user_id"], ["ts", "id"])
    assert segment.gaps(frame(spark, rows), ["user_id"], ["ts", "id"], keep=[]).where("splits").count() == 20
    assert placed == [["user_id", "ts", "id"]] * 2
    assert {r.content for r in wide.collect()} == {"build rust"} and wide.count() == 20


def test_null_keys_keep_their_texts(spark):
    rows = [(1, None, START, "a"), (2, None, START, "b"), (3, "u", None, "c")]
    got = segment.segment(frame(spark, rows), ["user_id"], ["ts", "id"]).collect()
    assert {r.id: r.content for r in got} == {1: "a", 2: "b", 3: "c"}
