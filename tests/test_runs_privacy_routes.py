import datetime as dt
import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import excerpts, pilot, privacy, routes, trends
from sessionloom.streaming import live

START = dt.datetime(2024, 1, 1)


def metrics(spark, values, step=dt.timedelta(hours=7)):
    rows = [(f"r{i}", START + i * step, float(v), 0.0, 1.0, 2.0, float(v * 2)) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "run_id string, generated_at timestamp_ntz, context_loss double, git_friction double, documentation_friction double, prompt_repetition double, command_repetition double"
    )


def test_first_run_compares_with_zero(spark):
    rows = trends.compare(metrics(spark, [7]), F.lit("r0"), F.lit(START)).collect()
    got = {r.metric: (r.current_value, r.previous_value, r.trend_direction, r.period) for r in rows}
    assert got["context_loss"] == (7.0, 0.0, "Increasing", "Past 30 days")
    assert got["git_friction"][2] == "Stable"


@pytest.mark.parametrize("days", [1, 2, 0])
def test_backfill_matches_each_single_comparison(spark, days):
    rng = random.Random(2)
    values = [rng.randrange(20) for _ in range(25)]
    # 12 hour steps put runs exactly on the cutoff, which is excluded.
    table = metrics(spark, values, dt.timedelta(hours=12))
    got = {(r.run_id, r.metric): r.previous_value for r in trends.backfill(table, days).collect()}
    window = dt.timedelta(days=max(days, 1))
    times = [START + i * dt.timedelta(hours=12) for i in range(25)]
    for i in range(25):
        earlier = [values[j] for j in range(25) if times[i] - window < times[j] < times[i]]
        assert got[f"r{i}", "context_loss"] == pytest.approx(sum(earlier) / len(earlier) if earlier else 0.0)
    one = {r.metric: r.previous_value for r in trends.compare(table, F.lit("r20"), F.lit(times[20]), days).collect()}
    assert one["command_repetition"] == pytest.approx(got["r20", "command_repetition"])


def test_event_identity_is_the_hash_of_canonical_json(spark):
    attributes = {"b": 'quote " and \\', "a": "é"}
    df = spark.createDataFrame([("p.e.t", "kind", "entity", attributes)], "ns string, kind string, entity string, attrs map<string,string>")
    [row] = df.select(privacy.event_identity(*[F.col(c) for c in df.columns]).alias("i")).collect()
    canonical = json.dumps(["p.e.t", "kind", "entity", dict(sorted(attributes.items()))], separators=(",", ":"), ensure_ascii=False)
    assert row.i.event_id == hashlib.sha256(canonical.encode()).hexdigest()
    assert row.i.content_hash == hashlib.sha256(canonical[canonical.index("{"):-1].encode()).hexdigest()


def test_namespace_and_retention(spark):
    df = spark.createDataFrame([("ok",), ("bad tenant",), ("x" * 260,), ("line\n",)], "t string")
    got = [r[0] for r in df.select(privacy.namespace(F.lit("a"), F.lit("b"), F.col("t"))).collect()]
    assert got == ["a.b.ok", None, None, None]
    rows = spark.createDataFrame([(START - dt.timedelta(days=d),) for d in (30, 31)], "observed_at timestamp_ntz")
    assert privacy.retain(rows, F.lit(START), 30).count() == 1


@pytest.mark.parametrize(
    "text, threshold, verdict",
    [
        ('{"schema_version":1,"run":{"id":"x"}}', 0.9, "accept"), ('{"schema_version":1,"run":{}}', 0.4, "escalate"),
        ('{"schema_version":1}', 0.9, "reject"), ('{"schema_version":1.0,"run":{}}', 0.9, "reject"), ("[]", 0.9, "reject"), ("nope", 0.9, "reject"),
    ],
)
def test_envelope_gate(spark, text, threshold, verdict):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(privacy.validate_envelope(F.col("x"), threshold)).collect()[0][0].split(":")[0] == verdict


def test_batches_roll_over_and_keys_repeat(spark):
    rows = spark.createDataFrame([("k", i) for i in range(101)] + [("j", 5)], "kind string, id long")
    keys = []
    for _ in range(2):
        batched = privacy.batches(rows, ["kind"], ["id"])
        keys.append({(r.kind, r.batch_no): (r.events, r.idempotency_key) for r in privacy.idempotency_keys(batched, ["kind"], "id").collect()})
    assert keys[0] == keys[1]
    assert {k: v[0] for k, v in keys[0].items()} == {("k", 0): 100, ("k", 1): 1, ("j", 0): 1}
    assert keys[0]["k", 0][1] == hashlib.sha256("\n".join(map(str, range(100))).encode()).hexdigest()


def attempts(spark, *outcomes):
    rows = [(route, START + dt.timedelta(seconds=i), i, status == 200, status) for i, (route, status) in enumerate(outcomes)]
    return spark.createDataFrame(rows, "route string, ts timestamp_ntz, attempt_id long, success boolean, status int")


def test_cooldowns_double_cap_and_reset(spark):
    run = [("a", 500)] * 3 + [("a", 200), ("a", 429), ("a", 401), ("a", 500)] + [("b", 429)] * 8
    got = routes.failure_streaks(attempts(spark, *run))
    rows = {r.attempt_id: (r.streak, r.cooldown_seconds) for r in got.collect()}
    assert [rows[i] for i in range(7)] == [(1, 2.0), (2, 4.0), (3, 8.0), (0, 0.0), (1, 5.0), (0, 0.0), (2, 4.0)]
    assert [rows[i][1] for i in range(7, 15)] == [5.0, 10.0, 20.0, 40.0, 80.0, 80.0, 80.0, 80.0]
    health = {r.route: r for r in routes.route_health(got).collect()}
    assert (health["a"].attempts, health["a"].successes, health["a"].failures, health["a"].circuit_open) == (7, 1, 6, True)
    assert health["b"].circuit_open is False and health["b"].total_cooldown_seconds == 395.0
    again = routes.route_health(routes.failure_streaks(attempts(spark, *run, ("a", 200))))
    assert {r.route: r.circuit_open for r in again.collect()} == {"a": False, "b": False}


def sequential_batches(rows):
    preamble, limit = excerpts.PREAMBLE.encode(), excerpts.MAX_BATCH_BYTES
    batches, current = [], b""
    for _, harness, ts, content, segment_no, topic, confidence in rows:
        lead = f"\n--- Segment {segment_no} (Topic: {topic}, Confidence: {confidence:.2f}) ---\n[{harness}] {ts:%Y-%m-%dT%H:%M:%SZ}: ".encode()
        room, data, chunks = max(limit - len(preamble) - len(lead) - 2, 1), content.encode(), []
        while data:
            end = min(room, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            chunks.append(data[:end])
            data = data[end:]
        for chunk in chunks or [b""]:
            if len(preamble) + len(current) + len(lead) + len(chunk) + 1 > limit and current:
                batches.append(current)
                current = b""
            current += lead + chunk + b"\n"
    return [(preamble + b + excerpts.CLOSING.encode()).decode() for b in [*batches, current]]


def test_packing_equals_the_sequential_fill(spark):
    rng = random.Random(3)
    rows = [
        (i, f"h{i % 3}", START + dt.timedelta(seconds=i), "é" * 60000 if i % 200 == 7 else "x" * rng.randint(0, 4000), i // 10, "topic", 0.5)
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "id long, harness string, ts timestamp, content string, segment_no long, topic string, confidence double")
    got = [r.text for r in excerpts.pack(df, ["ts", "id"]).orderBy("batch_no").collect()]
    assert got == sequential_batches(rows)


@pytest.mark.parametrize("seed, capacity, most, fan", [(1, 50, 60, 2), (2, 40, 40, 3), (3, 30, 8, 64), (4, 10, 1, 2), (5, 7, 7, 2)])
def test_batch_starts_follow_the_sequential_rule(spark, monkeypatch, seed, capacity, most, fan):
    """Deep trees, full buckets and pieces of a whole batch's size."""
    monkeypatch.setattr(excerpts, "FAN", fan)
    rng = random.Random(seed)
    costs = [min(rng.randint(1, most), capacity) for _ in range(700)]
    ends = list(itertools.accumulate(costs))
    rows = [(n, end - cost, end) for n, (cost, end) in enumerate(zip(costs, ends))]
    expected, used = [0], 0
    for n, cost in enumerate(costs):
        if used + cost > capacity:
            expected.append(n)
            used = 0
        used += cost
    df = spark.createDataFrame(rows, "number long, begin long, end long").repartition(4)
    assert sorted(r.number for r in excerpts.batch_starts(df, capacity).collect()) == expected


def test_no_batches_of_nothing(spark):
    df = spark.createDataFrame([], "id long, harness string, ts timestamp, content string, segment_no long, topic string, confidence double")
    assert excerpts.pack(df, ["ts", "id"]).count() == 0


def test_packing_redacts_and_keeps_the_tail(spark):
    rows = [(0, "h", START, "a" * 100_000 + " TAIL-MARKER password=hunter2", 1, "t", 1.0)]
    df = spark.createDataFrame(rows, "id long, harness string, ts timestamp, content string, segment_no long, topic string, confidence double")
    texts = [r.text for r in excerpts.pack(df, ["ts", "id"]).collect()]
    assert len(texts) >= 3 and any("TAIL-MARKER" in t for t in texts) and not any("hunter2" in t for t in texts)
    assert all(len(t.encode()) <= 48_100 for t in texts)


def run_stream(spark, tmp_path, build, mode):
    schema = "id long, user_id string, ts timestamp, content string"
    source = spark.readStream.schema(schema).parquet(str(tmp_path))
    query = build(source).writeStream.outputMode(mode).format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    return spark.table("out").collect()


def test_streaming(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    offsets = [0 * minute, 30 * minute + dt.timedelta(seconds=59), 62 * minute, 600 * minute]
    rows = [(i, "u", START + o, c) for i, (o, c) in enumerate(zip(offsets, ["you  forgot", "hello", "ok", "run it again"]))]
    spark.createDataFrame(rows, "id long, user_id string, ts timestamp, content string").write.parquet(str(tmp_path / "in"))
    got = run_stream(spark, tmp_path / "in", live.steering_stream, "append")
    assert sorted(r.category for r in got) == ["ManualRepetition", "MissingContext"]
    sessions = run_stream(spark, tmp_path / "in", lambda s: live.session_stream(s, "user_id"), "complete")
    assert sorted(r.entries for r in sessions) == [1, 1, 2]


def test_pilot_median_is_exact(spark):
    import statistics
    from datetime import datetime

    rng = random.Random(3)
    rows = []
    for cohort, n in (("a", 7), ("b", 40), ("c", 5), ("d", 4)):
        for _ in range(n):
            minutes = rng.choice([None, 0.04, 0.05, 1e9, rng.random() * 10])
            rows.append((cohort, datetime(2024, 1, rng.randrange(1, 28)), 1, True, 0, 0, minutes, True, 1, 1, 0))
    schema = ("cohort string, started_at timestamp, steering long, repeated boolean, context_loss long, missing_tool long, "
              "resolution_minutes double, adopted boolean, accepted long, files long, privacy_exceptions long")
    out = pilot.weekly(spark.createDataFrame(rows, schema), min_cohort=1).collect()
    for row in out:
        own = [r[6] for r in rows if r[0] == row.cohort and r[6] is not None and 0 <= (r[1] - row.week).days < 7]
        assert row.median_resolution_minutes == (statistics.median(own) if own else None)
