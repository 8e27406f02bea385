import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import candidates, findings, patterns, registry, report, steering
from sessionloom.sources.responses import KINDS

START = dt.datetime(2026, 1, 1)
TYPES = {"text": "string", "number": "double", "count": "bigint", "list": "array<string>"}


def merged(spark, **rows):
    """Merged, sanitised tables from lists of tuples per kind (arrival order)."""
    tables = {}
    for kind, fields in KINDS.items():
        schema = "ord long, " + ", ".join(f"{n} {TYPES[t]}" for n, t, _ in fields)
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows.get(kind, []))], schema)
        if kind == "context_loss":
            tables[kind], segments = findings.merge_context_loss(df)
        else:
            tables[kind] = findings.merge(df, kind)
    return {k: findings.sanitize(v) for k, v in tables.items()}, segments


def build(spark, **rows):
    tables, segments = merged(spark, **rows)
    extracted = patterns.extract(tables)
    assigned = patterns.assign_leaders(extracted)
    harnesses = patterns.cluster_harnesses(assigned, patterns.harness_links(tables, segments))
    return patterns.merge_clusters(extracted, assigned, harnesses), harnesses


def test_merge_keeps_first_seen_and_clamps_after_merging(spark):
    tables, _ = merged(
        spark,
        model_failures=[("m", "i", 999_999, "first"), ("m", "i", 5, "second")],
        workflow_bottlenecks=[("d", 1, float("nan")), ("d", 2, 7.0)],
        harness_friction=[("h", "i", 0.2), ("h", "i", 7.0)],
        context_loss=[("lost", ["a", "b"]), ("lost", ["b", "c"]), ("none", [])],
    )
    assert tables["model_failures"].collect()[0][2:4] == (1_000_000, "first")
    assert tables["harness_friction"].collect()[0].severity == 1.0
    assert {r.description: r.segments for r in tables["context_loss"].collect()} == {"lost": 3, "none": 0}


def test_near_duplicates_merge_inside_a_type_only(spark):
    same = "Responses API missing handler for"
    got, _ = build(
        spark,
        workflow_bottlenecks=[
            (f"{same} function_call_arguments.delta events", 4, 20.0), (f"{same} in_progress events", 3, 15.0),
            (f"{same} output_item events", 2, 18.0), ("Docker healthcheck exceeds latency threshold", 1, 5.0),
        ],
        missing_tooling=[("x", f"{same} in_progress events", 0.5)],
        repeated_commands=[("ls", 3, "shell"), ("cd", 2, "shell")],
    )
    rows = got.collect()
    bottlenecks = sorted((r for r in rows if r.pattern_type == "WorkflowBottleneck"), key=lambda r: -r.frequency)
    assert len(bottlenecks) == 2
    assert (bottlenecks[0].manifestation_count, bottlenecks[0].frequency, bottlenecks[0].minutes) == (3, 9, 20.0)
    assert bottlenecks[0].description == f"{same} function_call_arguments.delta events"
    assert sum(r.pattern_type == "MissingTool" for r in rows) == 1
    assert sum(r.pattern_type == "RepeatedCommand" for r in rows) == 2


def test_model_failure_pattern(spark):
    got, harnesses = build(spark, model_failures=[("gpt", "hallucinated API", 3, "e")])
    [row] = got.collect()
    assert (row.pattern_type, row.frequency, row.description, row.first_harness) == ("ModelFailure", 3, "gpt: hallucinated API", "gpt")
    assert row.impact_score == pytest.approx(3 / 100 * 0.5 + 0.07 * 0.5)
    assert [r.harness for r in harnesses.collect()] == ["gpt"]


def test_representative_is_the_last_of_the_highest_impact(spark):
    got, harnesses = build(
        spark, harness_friction=[("zeta", "slow git clone dialog", 0.9), ("alpha", "slow git clone dialog again", 0.9)]
    )
    [row] = got.collect()
    assert row.description == "alpha friction: slow git clone dialog again"
    assert (row.first_harness, row.harness_count) == ("alpha", 2)
    weak = {r.harness: r.severity for r in report.harness_weaknesses(got, harnesses).collect()}
    assert weak == {"alpha": 0.9, "zeta": 0.9}


def events(spark, *contents):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"e{i}", start + dt.timedelta(seconds=i), c) for i, c in enumerate(contents)]
    return steering.detect(spark.createDataFrame(rows, "id string, ts timestamp_ntz, content string"))


@pytest.mark.parametrize(
    "text, category",
    [
        ("I wish I had a tool for this", "MissingTool"), ("- run it again", "ManualRepetition"), ("run the test again", None),
        ("hello", None), (" Good Morning ", None), ("HttpMetricsClient.ExportFailed: try again later", None),
        ("You forgot, we need a tool for it", "MissingTool"), ("that API doesn't exist", "Hallucination"),
        ("make it shorter", "ExcessVerbosity"), ("shortertext", None), ("missing the tool", "MissingTool"), ("missing\nthe tool", None),
    ],
)
def test_steering(spark, text, category):
    got = [r.category for r in events(spark, text).collect()]
    assert got == ([category] if category else [])


@pytest.mark.parametrize("tasks", [1, 7, 12])
def test_equal_severities_average_to_themselves_in_any_number_of_tasks(spark, tasks):
    rows = spark.range(0, 8_334, 1, tasks).select(F.lit("MissingTool").alias("category"), F.lit(0.8).alias("severity"))
    (got,) = steering.clusters(rows).collect()
    assert (got.events, got.avg_severity, got.confidence) == (8_334, 0.8, 0.9)


def test_one_suggestion_per_name_highest_impact_first(spark):
    got, _ = build(
        spark,
        harness_friction=[("a", "git push fails silently", 0.95), ("b", "rebase conflicts inside git worktrees hang", 0.85), ("c", "mouse pointer flickers", 0.5)],
        missing_tooling=[("finder", "locate stale caches", 0.75)],
    )
    steer = events(spark, *["run it again"] * 12, "you forgot", "you forgot that")
    known = spark.createDataFrame(
        [(f"tool{i}", f"tool{i} git-assistant docs") for i in range(7)] + [("flow", "a WORKFLOW automator".lower())], "tool string, searchable string"
    )
    rows = candidates.candidates(got, steer, known)
    by_name = {r.name: r for r in rows.collect()}
    assert set(by_name) == {"git-assistant", "smart-search", "workflow-automator", "context-manager"}
    git = by_name["git-assistant"]
    assert (git.id, git.priority, git.category, git.project_count) == ("DS-0001", "High", "Other", 1)
    assert git.existing_matches == []  # "assistant" is too generic to search and "git" too short
    assert by_name["smart-search"].id == "DS-0002" and by_name["smart-search"].priority == "Medium"
    auto = by_name["workflow-automator"]
    assert (auto.priority, auto.existing_matches, auto.reason) == ("High", ["flow"], "12 steering events clustered as ManualRepetition")
    assert auto.confidence == pytest.approx((0.6 + 0.6) / 2) and auto.implementation_cost == "high"
    assert by_name["context-manager"].priority == "Medium"
    views = {r.title: r for r in candidates.interventions(rows).collect()}
    assert views["workflow-automator"].action == "extend flow" and views["git-assistant"].action == "create new capability"
    effort = {r.title: r.implementation_effort for r in candidates.directives(rows).collect()}
    assert effort["git-assistant"] == "Medium" and effort["smart-search"] == "Low"
    log = candidates.backlog(rows).orderBy("id").collect()
    assert [r.id for r in log] == ["dream-001", "dream-002", "dream-003", "dream-004"]
    assert log[0].confidence == max(r.confidence for r in log)


def test_opportunity_rounding(spark):
    row = ("DS-0001", "n", "Low", "r", "1.5 hours/day", 0.875, 2)
    df = spark.createDataFrame([row], "id string, name string, priority string, reason string, estimated_time_saved string, confidence double, project_count long")
    [got] = candidates.opportunities(df.withColumn("existing_matches", F.array().cast("array<string>"))).collect()
    assert (got.confidence, got.estimated_value, got.decision, got.repositories) == (88, 1.5, "generate", 2)


def test_registry_matching_equals_substring_search(spark):
    tools = [("a", "über-workflow notes"), ("b", "preworkflowish"), ("c", "work flow"), ("d", "日本語 tools"), ("e", "nothing"), ("f", "xüberx")]
    names = [("tool-workflow",), ("über",), ("日本",), ("git-manager",)]
    got = registry.matches(spark.createDataFrame(names, "name string"), spark.createDataFrame(tools, "tool string, searchable string"))
    assert {r.name: r.existing_matches for r in got.collect()} == {"tool-workflow": ["a", "b"], "über": ["a", "f"], "日本": ["d"]}


def test_model_weaknesses_and_their_items(spark):
    rows = [("ModelFailure", i, f"d{i}", 0.9 - i / 100, "m") for i in range(5)]
    df = spark.createDataFrame(rows, "pattern_type string, idx long, description string, impact_score double, first_harness string")
    assert [tuple(r) for r in report.model_weaknesses(df).collect()] == [("m", 5)]
    got = sorted(tuple(r) for r in report.model_weakness_items(df).collect())
    assert got == [("m", i + 1, f"d{i}") for i in range(5)]


def test_nested_envelopes_hold_every_opportunity_once(spark):
    columns = "run_id string, id string, title string, summary string, priority string, confidence int, estimated_value double, evidence_count int, repositories long, decision string"
    rows = [(run, f"DS-{k:04d}", "t", "s", "high", 50, 2.0, 1, 3, "extend") for run, n in (("a", 5), ("b", 2)) for k in range(n)]
    runs = spark.createDataFrame(
        [(r, START, "sum", 1, 2, 3, 4) for r in ("a", "b", "c")],
        "run_id string, generated_at timestamp, executive_summary string, raw_entries long, normalized_entries long, segments long, estimated_input_tokens long",
    )
    got = candidates.nested_envelopes(runs, spark.createDataFrame(rows, columns), "d", "1.0", part=2).collect()
    held = {(r.run_id, r.part): [o["id"] for o in json.loads(r.envelope)["run"]["opportunities"]] for r in got}
    assert held == {
        ("a", 0): ["DS-0000", "DS-0001"], ("a", 1): ["DS-0002", "DS-0003"], ("a", 2): ["DS-0004"], ("b", 0): ["DS-0000", "DS-0001"], ("c", 0): []
    }
    document = json.loads(next(r.envelope for r in got if r.run_id == "b"))
    assert document["schema_version"] == 1 and document["run"]["source"] == {"id": "d", "cli_version": "1.0"}
    assert document["run"]["opportunities"][0] == {
        "id": "DS-0000", "title": "t", "summary": "s", "priority": "high", "confidence": 50, "estimated_hours": 2.0, "evidence_count": 1,
        "repositories": 3, "decision": "extend",
    }


def test_matches_move_a_bounded_part_of_the_registry(spark, tmp_path):
    tools = [(f"t{n % 40:02}", f"common notes w{n % 7}word") for n in range(400)]
    spark.createDataFrame(tools, "tool string, searchable string").write.parquet(f"{tmp_path}/registry")
    names = spark.createDataFrame([("a-common",), ("b-w3word-omm",), ("c-mmon",), ("d-absent",)], "name string")
    got = registry.matches(names, spark.read.parquet(f"{tmp_path}/registry"))
    assert not any(str(tmp_path) in file for file in got.inputFiles())
    first = [f"t{n:02}" for n in range(5)]
    assert {r.name: r.existing_matches for r in got.collect()} == {"a-common": first, "b-w3word-omm": first, "c-mmon": first}


def test_counts_read_each_table_once(spark):
    rows, other = spark.range(7), spark.range(3)
    got = report.count_row({"n": (rows, F.count("*")), "m": (other, F.count("*")), "total": (rows, F.sum("id")), "none": (rows, F.max(F.nullif("id", "id")))})
    assert got._jdf.queryExecution().analyzed().toString().count("Range (") == 2
    assert got.first().asDict() == {"n": 7, "m": 3, "total": 21, "none": None}
