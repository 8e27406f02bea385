import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import runs
from sessionloom.operators.normalize import normalize
from sessionloom.sources import files, jsonsplits, records, responses, runstore
from sessionloom.sources.files import Harness


def write(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def read(spark, *harnesses):
    entries, status = files.read_logs(spark, list(harnesses))
    ordered = files.in_time_order(entries).select("*", F.unix_micros("ts").alias("us")).collect()
    return ordered, {r.harness: r for r in files.ingestion_report(status).collect()}


def test_json_array(spark, tmp_path):
    path = write(tmp_path, "a.json", '[{"timestamp":"2026-06-01T10:00:00Z","content":"x","model":"gpt"},\n {"ts":1786092899,"text":"y"},\n 5]')
    rows, report = read(spark, Harness("chat", path, "json"))
    assert [(r.content, r.model) for r in rows][:2] == [("x", "gpt"), ("y", None)]
    assert rows[1].us == 1786092899 * 10**6
    assert report["chat"].entries_accepted == 3  # the bare number is kept with empty content
    assert normalize(files.read_logs(spark, [Harness("chat", path, "json")])[0]).count() == 2


def test_json_lines(spark, tmp_path):
    text = '{"session_id":"s","ts":"2026-06-02T19:12:01Z","text":"Hello"}\n\n{bad\n{"ts":1780427521000,"message":5,"text":"Plan the migration"}\n{} tail\n'
    rows, report = read(spark, Harness("chat", write(tmp_path, "a.jsonl", text), "json", layout="lines"))
    assert [r.content for r in rows] == ["Hello", "Plan the migration"]
    assert rows[0].us == rows[1].us == 1780427521 * 10**6
    assert (report["chat"].files_failed, report["chat"].entries_accepted) == (0, 2)


def test_lines_of_arrays_are_not_one_array(spark, tmp_path):
    rows, report = read(spark, Harness("chat", write(tmp_path, "a.jsonl", "[1]\n[2]\n"), "json"))
    assert [r.content for r in rows] == ["", ""]
    assert report["chat"].files_failed == 0


def test_a_hopeless_file_fails_without_stopping_others(spark, tmp_path):
    write(tmp_path, "j/bad.jsonl", "{not json}\n")
    write(tmp_path, "p/ok.txt", "fine\n")
    write(tmp_path, "p/broken.txt", b"ok\n\xff\xfe\n")
    rows, report = read(
        spark, Harness("j", str(tmp_path / "j"), "json"), Harness("p", str(tmp_path / "p"), "plain"),
        Harness("none", str(tmp_path / "missing"), "plain"),
    )
    assert [r.content for r in rows] == ["fine"]
    assert (report["j"].files_seen, report["j"].files_failed, report["j"].warnings) == (1, 1, 1)
    assert (report["p"].files_seen, report["p"].files_failed) == (2, 1)
    assert (report["none"].files_seen, report["none"].warnings) == (0, 1)
    assert report[None].files_seen == 3 and report[None].warnings == 3


def test_markdown_and_plain(spark, tmp_path):
    write(tmp_path, "m/a.md", "# Title\n- first action\n\n## More\nsecond\n")
    write(tmp_path, "p/a.txt", "2026-08-07T10:00:00Z first event\n2026-08-07 10:00:01 second\n2026-08-07T12:00:02+02:00 third\n2026-99-07T10:00:00Z broken\n")
    rows, _ = read(spark, Harness("m", str(tmp_path / "m"), "markdown"), Harness("p", str(tmp_path / "p"), "plain"))
    content = [r.content for r in rows]
    assert content[:3] == ["first event", "second", "third"]
    assert [r.us // 10**6 - 1786096800 for r in rows[:3]] == [0, 1, 2]
    assert set(content[3:]) == {"- first action", "second", "2026-99-07T10:00:00Z broken"}


def test_names_with_blanks_and_signs(spark, tmp_path):
    write(tmp_path, "a b%20ü.txt", "one\ntwo\n")
    write(tmp_path, "c d.txt", b"\xff\n")
    rows, report = read(spark, Harness("p", str(tmp_path), "plain"))
    assert sorted(r.content for r in rows) == ["one", "two"]
    assert (report["p"].files_seen, report["p"].files_failed, report["p"].entries_accepted) == (2, 1, 2)


def test_bracketed_names_in_an_array_folder(spark, tmp_path):
    write(tmp_path, "a b%20{1}[x].json", '[{"content":"x"}]')
    write(tmp_path, "c d.json", '{"content":"y"}\n')
    rows, report = read(spark, Harness("p", str(tmp_path), "json"))
    assert sorted(r.content for r in rows) == ["x", "y"] and report["p"].files_failed == 0


def test_side_files_are_skipped(spark, tmp_path):
    for name in ("conversation", "x.db", "x.DB-WAL", "x.db-shm", "x.pb"):
        write(tmp_path, name, "hello there\n")
    rows, report = read(spark, Harness("p", str(tmp_path), "plain"))
    assert len(rows) == 1 and report["p"].files_seen == 1 and report["p"].files_failed == 0


def test_project_snapshot(spark, tmp_path):
    doc = {"tree": "t", "files": [
        {"metadata": {"relative_path": "a/b.txt", "size_bytes": 1, "line_count": 1, "modified_unix": 1710000000}, "content": "C"},
        {"content": "no metadata"},
    ]}
    rows, report = read(spark, Harness("s", write(tmp_path, "s.json", json.dumps(doc)), "snapshot"))
    assert [(r.content, r.provider, r.us) for r in rows] == [("C", "bound:a/b.txt", 1710000000 * 10**6)]
    assert report["s"].entries_accepted == 1


def test_table_source(spark):
    logs = spark.createDataFrame([(1710000000, "line one\n\tline two"), (1, None), (10**15, "far away")], "ts long, feedback_log_body string")
    logs.createOrReplaceTempView("feedback_logs")
    rows, report = read(spark, Harness("t", "feedback_logs", "sqlite_table"))
    assert [(r.content, r.provider) for r in rows] == [("line one\n\tline two", "openai")]
    assert report["t"].entries_accepted == 1


def test_equal_times_keep_source_and_line_order(spark, tmp_path):
    write(tmp_path, "b/a.txt", "".join(f"2026-08-07T10:00:00Z b{i}\n" for i in range(5)))
    write(tmp_path, "a/a.txt", "".join(f"2026-08-07T10:00:00Z a{i}\n" for i in range(5)))
    rows, _ = read(spark, Harness("b", str(tmp_path / "b"), "plain"), Harness("a", str(tmp_path / "a"), "plain"))
    assert [r.content for r in rows] == [f"b{i}" for i in range(5)] + [f"a{i}" for i in range(5)]
    assert len({r.id for r in rows}) == 10


def test_tool_calls(spark):
    text = '{"tool_calls":[{"tool_name":"Cargo_Check","parameters":{"Target":" debug ","b":[{"K":" v "}],"B":2},"result":{"Raw":" r "},"duration_ms":1200},{"other":1},{"tool_name":5}]}'
    df = spark.createDataFrame([(text,)], "line string").select(
        F.lit("x").alias("content"), records.record_tool_calls(F.try_parse_json("line")).alias("tool_calls")
    )
    [call] = normalize(df).collect()[0].tool_calls
    assert call.tool_name == "cargo_check" and call.duration_ms == 1200
    assert json.loads(call.parameters) == {"target": "debug", "b": [{"k": "v"}]}
    assert json.loads(call.result) == {"Raw": " r "}


@pytest.mark.parametrize(
    "line, valid", [("{}", True), ("{} x", False), ("[1],[2]", False), ("1} x", False), ("null", True), ('"a"', True), ("{a:1}", False), ("", False)]
)
def test_strict_json(spark, line, valid):
    [row] = spark.createDataFrame([(line,)], "x string").select(records.strict_json(F.col("x")).isNotNull().alias("v")).collect()
    assert row.v is valid


@pytest.mark.parametrize(
    "doc, seconds",
    [
        ({"timestamp": 1.5, "ts": 100}, 100), ({"timestamp": "bad", "ts": 100}, 100), ({"ts": 1786092899000}, 1786092899),
        ({"timestamp": "2026-08-07T12:00:00+02:00"}, 1786096800), ({"timestamp": "2026-08-07"}, 7), ({"timestamp": None}, 7), ({"ts": -5}, -5),
    ],
)
def test_record_time(spark, doc, seconds):
    df = spark.createDataFrame([(json.dumps(doc),)], "x string")
    ts = records.record_time(F.parse_json("x"), F.timestamp_seconds(F.lit(7)))
    assert df.select(F.unix_seconds(ts)).collect()[0][0] == seconds


EMPTY = {kind: [] for kind in responses.KINDS}


def parse(spark, *texts):
    tables, rejected = responses.parse(spark.createDataFrame(list(enumerate(texts)), "batch_no long, text string"))
    return tables, [r.batch_no for r in rejected.orderBy("batch_no").collect()]


def test_response_repairs(spark):
    shorthand = {kind: [f" note {kind} "] for kind in responses.KINDS}
    typed = EMPTY | {"model_failures": [{"model": "m", "issue": 6, "frequency": "12-plus", "example": True}]}
    bare = json.dumps(EMPTY | {"harness_friction": [{"harness": "h", "issue": "i", "severity": "high"}]}).replace('"high"', "high").replace('"harness"', "harness")
    words = EMPTY | {"workflow_bottlenecks": [{"description": "d", "frequency": "three", "time_impact_minutes": 1.5}]}
    loss = EMPTY | {"context_loss": [{"description": "d", "affected_segments": [1, "b", True]}]}
    tables, rejected = parse(
        spark, json.dumps(shorthand), "Sure:\n" + json.dumps(typed) + "\nDone", bare, json.dumps(words).replace('"', "'").replace("'frequency'", "frequency"),
        json.dumps(loss),
    )
    assert rejected == []
    failures = [tuple(r) for r in tables["model_failures"].orderBy("ord").drop("ord").collect()]
    assert failures == [(0, "unknown", "note model_failures", 1, ""), (1, "m", "6", 12, "true")]
    assert [r.severity for r in tables["harness_friction"].orderBy("ord").collect()] == [0.5, 0.0]
    assert [(r.frequency, r.time_impact_minutes) for r in tables["workflow_bottlenecks"].orderBy("ord").collect()] == [(1, 0.0), (3, 1.5)]
    assert [r.affected_segments for r in tables["context_loss"].orderBy("ord").collect()] == [[], ["1", "b", "true"]]
    assert tables["missing_tooling"].collect()[0].tool_name == "candidate-capability"


def test_responses_are_rejected_whole(spark):
    def with_failure(**changes):
        item = {"model": "m", "issue": "i", "frequency": 1, "example": "e"} | changes
        return json.dumps(EMPTY | {"model_failures": ["fine", {k: v for k, v in item.items() if v != "drop"}]})

    tables, rejected = parse(
        spark, '{"model_failures":[]}', "no json", with_failure(frequency=2.5), with_failure(frequency=-1), with_failure(issue=None),
        with_failure(issue="drop"), json.dumps(EMPTY | {"model_failures": [" "]}), "} {", with_failure(),
    )
    assert rejected == list(range(8))
    assert {r.batch_no for r in tables["model_failures"].collect()} == {8}


def test_run_store(spark, tmp_path):
    path = str(tmp_path / "runs")

    def store(*rows):
        df = spark.createDataFrame(list(rows), "run_id string, date string, at string, n int")
        runstore.append_runs(df.select("run_id", "date", F.col("at").cast("timestamp").alias("generated_at"), "n"), path)

    store(("007", "2026-01-01", "2026-01-01 00:00:00", 1))
    store(("8", "2026-01-01", "2026-01-01 01:00:00", 1), ("9", "2026-01-02", "2026-01-02 01:00:00", 1))
    store(("007", "2026-01-01", "2026-01-01 00:00:00", 2))  # a repeated run replaces itself only
    stored = runstore.read_runs(spark, path)
    assert sorted((r.run_id, r.date, r.n) for r in stored.collect()) == [("007", "2026-01-01", 2), ("8", "2026-01-01", 1), ("9", "2026-01-02", 1)]
    assert runs.latest_per_date(stored, "2026-01-01").collect()[0].run_id == "8"
    assert [r.run_id for r in runstore.newest_run(spark, path).collect()] == ["9"]
    assert [r.run_id for r in runstore.newest_run(spark, path, "2026-01-01").collect()] == ["8"]
    plan = runs.by_id(stored.where("date = '2026-01-01'"), "007")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in filters and "run_id" in filters


def test_run_documents(spark, tmp_path):
    def doc(name, **fields):
        write(tmp_path, name, json.dumps(fields))

    doc("a/old.json", id="old", generated_at="2026-01-01T00:00:00Z", date="2026-01-01", executive_summary="s", candidate_tools=[{"id": "1"}])
    doc("a/new.json", id="new", generated_at="2026-01-01T09:00:00Z", date="2026-01-01", executive_summary="s", candidate_tools=[])
    doc("a/other.json", unrelated=True)
    write(tmp_path, "a/broken.json", "{oops")
    write(tmp_path, "a/notes.txt", "x")
    documents, unreadable = runstore.read_run_documents(spark, str(tmp_path))
    listed = runs.listing(runs.summary_rows(documents)).collect()
    assert [(r.run_id, r.candidates) for r in listed] == [("new", 0), ("old", 1)]
    assert unreadable.count() == 2  # notes.txt is no JSON file
    assert runs.latest(runs.summary_rows(documents)).collect()[0].run_id == "new"
    status = {r.status: r.files for r in runs.sync_summary(runstore.classify_files(spark, [str(tmp_path)] * 2)).collect()}
    assert status == {"uploaded": 2, "skipped": 2}
    # A file that fails while it is read: its stored checksum does not fit.
    doc("a/failing.json", id="x", generated_at="2026-01-01T00:00:00Z", date="2026-01-01", executive_summary="s", candidate_tools=[])
    write(tmp_path, "a/.failing.json.crc", b"crc\x00\x00\x00\x02\x00\x12\x34\x56\x78")
    status = {r.status: r.files for r in runs.sync_summary(runstore.classify_files(spark, [str(tmp_path)])).collect()}
    assert status == {"uploaded": 2, "skipped": 2, "failed": 1}
    _, unreadable = runstore.read_run_documents(spark, str(tmp_path))
    assert sorted(r.source_path.split("/")[-1] for r in unreadable.collect()) == ["broken.json", "failing.json", "other.json"]


def test_sync_reads_only_what_changed(spark, tmp_path):
    folder, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")

    def state():
        verdicts, read = runstore.sync(spark, [folder, folder], ledger)
        return {r.source_path.split("/")[-1]: (r.readable, r.is_run) for r in verdicts.collect()}, read

    run = {"id": "r", "generated_at": "2026-01-01T00:00:00Z", "date": "2026-01-01", "executive_summary": "s", "candidate_tools": []}
    write(tmp_path, "in/a.json", json.dumps(run))
    write(tmp_path, "in/b c.json", '{"other":1}')
    write(tmp_path, "in/broken.json", json.dumps(run))
    write(tmp_path, "in/.broken.json.crc", b"crc\x00\x00\x00\x02\x00\x12\x34\x56\x78")
    expected = {"a.json": (True, True), "b%20c.json": (True, False), "broken.json": (False, False)}
    assert state() == (expected, 3)
    assert state() == (expected, 0)  # nothing changed, nothing is read
    write(tmp_path, "in/b c.json", json.dumps(run))
    write(tmp_path, "in/new.json", json.dumps(run))
    (tmp_path / "in/a.json").unlink()
    changed = {"b%20c.json": (True, True), "broken.json": (False, False), "new.json": (True, True)}
    assert state() == (changed, 2)
    status = runs.sync_summary(runstore.sync(spark, [folder], ledger)[0]).collect()
    assert {r.status: r.files for r in status} == {"uploaded": 2, "failed": 1}


def test_backlog_and_report_sinks(spark, tmp_path):
    backlog = spark.createDataFrame([("dream-001", "HIGH")], "id string, priority string")
    for run in ("r1", "r2", "r2"):
        runstore.write_backlog(backlog, str(tmp_path / "b"), run)
    assert spark.read.json(str(tmp_path / "b/active")).count() == 1
    assert spark.read.json(str(tmp_path / "b/history")).count() == 2
    projects = spark.createDataFrame([("/p1",), ("/p2",), ("/p1",)], "path string")
    runstore.write_project_backlogs(backlog, projects, str(tmp_path / "all"), "r1")
    later = spark.createDataFrame([("dream-002", "LOW")], "id string, priority string")
    runstore.write_project_backlogs(later, projects.where("path = '/p1'"), str(tmp_path / "all"), "r2")
    expected = {("r1", "/p1"): ["dream-001"], ("r1", "/p2"): ["dream-001"], ("r1", "/p3"): [], ("r2", "/p1"): ["dream-002"], ("r2", "/p2"): []}
    for (run, path), ids in expected.items():
        own = runstore.read_project_backlog(spark, str(tmp_path / "all"), path, run)
        assert [(r.path, r.id) for r in own.collect()] == [(path, i) for i in ids]
    assert "run_id" in own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_line_separators_stay_in_the_text(spark):
    lines = [("2026-08-07T10:00:00Z step 1\rstep 2",), ("2026-08-07T10:00:00Z a\u2028b\u0085c",)]
    df = spark.createDataFrame(lines, "line string").select(*records.line_columns(F.col("line"), F.lit(None).cast("timestamp")))
    assert sorted(r.content for r in df.collect()) == ["a\u2028b\u0085c", "step 1\rstep 2"]
    assert all(r.ts is not None for r in df.collect())


LISTS = ("model_failures", "harness_friction", "missing_tooling", "workflow_bottlenecks", "repeated_commands", "repeated_prompts",
         "context_loss", "automation_opportunities")


def response(**lists):
    return "{" + ",".join(f'"{n}":{lists.get(n, "[]")}' for n in LISTS)


def test_trailing_commas_are_forgiven_outside_strings(spark):
    rows = [(1, response(missing_tooling='["a,]","b,}" , ]', repeated_prompts='["it\'s \\"x,}\\"",]') + " , }"), (2, response() + "}}")]
    rows += [(3, response(missing_tooling='["a",,]') + "}"), (4, response(model_failures="[{\"model\":\"m\",\"issue\":\"i\",\"frequency\":'say \"3\" times',\"example\":\"\"}]") + "}")]
    tables, rejected = responses.parse(spark.createDataFrame(rows, "batch_no long, text string"))
    assert [r.purpose for r in tables["missing_tooling"].orderBy("ord").collect()] == ["a,]", "b,}"]
    assert [r.prompt_pattern for r in tables["repeated_prompts"].collect()] == ['it\'s "x,}"']
    assert [(r.batch_no, r.frequency) for r in tables["model_failures"].collect()] == [(4, 3)]
    assert 3 in {r.batch_no for r in rejected.collect()}


@pytest.mark.parametrize(
    "written, strict",
    [
        ("{a:+5}", "{a:5}"), ("[.5,-.25,+.5e-3]", "[0.5,-0.25,0.5e-3]"), ("[5.,-7.]", "[5.0,-7.0]"), ("[0x1F,-0Xff,+0x0]", "[31,-255,0]"),
        ("[Infinity,-Infinity,NaN,+NaN]", "[null,null,null,null]"), ('"a\\\nb"', '"ab"'), ("'a\\\r\nb'", "'ab'"), ('"a\\\\\nb"', '"a\\\\\nb"'),
        ('["+.5 0x1F, ] NaN"," .5 "]', '["+.5 0x1F, ] NaN"," .5 "]'), ("{Infinity:1,NaN :2,x5:3,$_e1:4}", "{Infinity:1,NaN :2,x5:3,$_e1:4}"),
        ("[1,2,]", "[1,2]"), ("{a:[1 , ] , }", "{a:[1  ]  }"), ("[1.5,-2,3e5,1E+2,0]", "[1.5,-2,3e5,1E+2,0]"), ("[1 /* .5, ] */ ,2]", "[1 /* .5, ] */ ,2]"),
        ("[1,// +5 ]\n2]", "[1,// +5 ]\n2]"), ("['it\\'s .5',.5]", "['it\\'s .5',0.5]"), ("[a.b,1.2.3]", "[a.b,1.2.3]"),
    ],
)
def test_forms_of_json5(spark, written, strict):
    df = spark.createDataFrame([(written,)], "x string")
    assert df.select(responses.as_strict_json(F.col("x"))).first()[0] == strict


def test_json5_responses_are_accepted_whole(spark):
    item = "{model:'m', issue:0x1F, frequency:3, example:'+.5 \\\n0x1F, ]', extra:-Infinity,}"
    tables, rejected = responses.parse(spark.createDataFrame([(1, response(model_failures=f"[{item}]") + "}")], "batch_no long, text string"))
    assert rejected.count() == 0
    assert [tuple(r)[2:] for r in tables["model_failures"].collect()] == [("m", "31", 3, "+.5 0x1F, ]")]


def test_finding_numbers_never_collide(spark):
    rows = [(2**44, response(missing_tooling='["a","b"]') + "}"), (0, response(missing_tooling='["c","d","e"]') + "}"), (-5, response(missing_tooling='["f"]') + "}")]
    tables, _ = responses.parse(spark.createDataFrame(rows, "batch_no long, text string"))
    found = tables["missing_tooling"].orderBy("ord").collect()
    assert [r.purpose for r in found] == ["f", "c", "d", "e", "a", "b"]
    assert len({r.ord for r in found}) == 6


@pytest.fixture
def small_splits(spark):
    """Files are dealt out in splits of a few words."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "61"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


AWKWARD = ["}", "{[", '"', "\\", '\\"}', "] , [", "", "é}ü", "\n", "x" * 300, "},{"]


def generated_array(seed, size):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(AWKWARD) for _ in range(rng.randint(0, 6)))
    made = [
        lambda: {"content": text(), "deep": {"a": [{"b": text()}, {}], text(): [[]]}}, lambda: {"message": text()},
        lambda: rng.randint(0, 9), text, lambda: [{"content": text()}, [text()]], lambda: None, lambda: {},
    ]
    return [rng.choice(made)() for _ in range(size)]


@pytest.mark.parametrize("seed, size, indent", [(1, 120, None), (2, 60, 1), (3, 0, None), (4, 1, None), (5, 7, 3)])
def test_arrays_over_many_splits(spark, tmp_path, small_splits, seed, size, indent):
    items = generated_array(seed, size)
    path = write(tmp_path, "a.json", json.dumps(items, indent=indent, ensure_ascii=bool(seed % 2)) + "\n" * (seed % 3))
    entries, status = files.read_harness(spark, Harness("h", path, "json", layout="array"))
    found = [r.content for r in entries.orderBy("line_key").collect()]
    expected = [next((i[f] for f in ("content", "message") if f in i), "") if isinstance(i, dict) else "" for i in items]
    assert found == expected
    [file] = status.collect()
    assert (file.failed, file.accepted) == (0, size)


def test_what_is_no_array_is_refused(spark, tmp_path, small_splits):
    texts = [
        '[{"a":1}', '[{"a":1},]', '{"a":1}]', '[{"a":1}{"b":2}]', '[{"a":1}] x', '[,{"a":1}]', '[{"a":1},,{"b":2}]', '[{"a":"}]', '[1],[{"a":2}]',
        "[{'a':1}]", '[{"a":1}]]', '[{"a":1}],{"b":1}', '[{"a":1}\\}]', '"[{}]"', "{}", '[[{"a":1}]', '[{"content":"x"},{"content":"y"}}',
    ]
    for n, text in enumerate(texts):
        write(tmp_path, f"{n}.json", text)
    _, status = files.read_harness(spark, Harness("h", str(tmp_path), "json", layout="array"))
    found = {r.source_path.split("/")[-1]: (r.failed, r.accepted) for r in status.collect()}
    assert found == {f"{n}.json": (1, 0) for n in range(len(texts))}


def test_one_written_parse_feeds_rows_and_status(spark, tmp_path):
    path = write(tmp_path, "a.txt", "one\n\ntwo\n")
    entries, status = files.read_harness(spark, Harness("p", path, "plain"))
    for df in (entries, status):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" not in plan and "Scan text" not in plan
    assert "ShuffledHashJoin" not in entries._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in entries._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("other", [{}, {"version": {"deep": {"x": []}}, "after": [{"files": []}]}])
def test_snapshots_over_many_splits(spark, tmp_path, small_splits, other):
    rng = random.Random(9)
    items = []
    for k in range(30):
        content = "".join(rng.choice(AWKWARD) for _ in range(8))
        meta = {"relative_path": f"d/{k}}}.txt", "size_bytes": 1, "line_count": 1, "modified_unix": 1710000000 + k, "sha256": "x"}
        items.append({"metadata": meta, "content": content} if k % 5 else {"content": content})
    doc = {"tree": 'a } " {', "files": items} | other
    if other:
        doc = {"version": other["version"], **doc}
    write(tmp_path, "s.json", json.dumps(doc))
    write(tmp_path, "bad.json", json.dumps(doc)[:-1])
    entries, status = files.read_harness(spark, Harness("s", str(tmp_path), "snapshot"))
    found = [(r.content, r.provider) for r in entries.orderBy("line_key").collect()]
    assert found == [(i["content"], "bound:" + i["metadata"]["relative_path"]) for i in items if "metadata" in i]
    assert sorted((r.failed, r.accepted) for r in status.collect()) == [(0, 24), (1, 0)]


def test_fragments_are_lexed_as_json_is(spark, tmp_path):
    texts = ['{"a":[1,{"b":"x', r' \"[{ \\', r'\\\" ]\n', '",[[', "]", '"é[": [', "", "[{[]"]
    (tmp_path / "x.json").write_text("}".join(texts), encoding="utf-8")
    rows = jsonsplits.fragments(spark, str(tmp_path), F.lit(True))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "regexp_replace(" not in plan
    expected = []
    for value in texts:
        parts = re.sub(r"(?s)\\.", "", value).split('"')
        depth = lambda some: sum((c in "[{") - (c in "]}") for c in "".join(some))
        expected.append((value, (len(parts) - 1) % 2, depth(parts[::2]), depth(parts[1::2])))
    got = rows.orderBy("split", "row").select("value", "flips", "out", "inside").collect()
    assert [tuple(r) for r in got] == expected
