"""Views of the driver tables in the shape of agent logs, findings and runs.

Each is plain SQL over whole tables, written to run unchanged on Spark and on
the checking database; only the table names are filled in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

INPUTS = {
    "session_entries": """
        SELECT event_id AS id, ts, user_id, event_type AS harness,
               event_type || ' user ' || CAST(user_id % 5 AS STRING) || ' bucket '
                 || CAST(CAST(floor(value / 25) AS INT) AS STRING) AS content
        FROM {events}""",
    "raw_entries": """
        SELECT event_id AS id, ts, user_id, event_type AS harness,
               CASE event_id % 12
                 WHEN 0 THEN 'I wish I had  a tool for this, case ' || CAST(user_id % 9 AS STRING)
                 WHEN 1 THEN 'you forgot   the schema again '
                 WHEN 2 THEN 'Wrong approach, not the right abstraction'
                 WHEN 3 THEN ' too verbose, make it shorter'
                 WHEN 4 THEN 'that call doesn' || chr(39) || 't exist'
                 WHEN 5 THEN 'this doesn' || chr(39) || 't scale for the find step'
                 WHEN 6 THEN 'please run  it again and cd back'
                 WHEN 7 THEN ' Hello '
                 WHEN 8 THEN 'request failed again after ' || CAST(user_id AS STRING) || ' tries'
                 WHEN 9 THEN '[system]   [debug]'
                 WHEN 10 THEN '[debug]run   the  tests'
                 ELSE '    '
               END AS content
        FROM {events}""",
    "model_failures": f"""
        SELECT event_id AS ord, 'model-' || CAST(user_id % 7 AS STRING) AS model,
               CASE event_id % 5
                 WHEN 0 THEN 'timeout calling build service'
                 WHEN 1 THEN 'timeout calling deploy service'
                 WHEN 2 THEN 'invented import path in module'
                 WHEN 3 THEN 'lost git branch state'
                 ELSE 'wrong document format returned'
               END || CASE user_id % 7
                 WHEN 0 THEN ' planner agenda stage' WHEN 1 THEN ' parser grammar tables'
                 WHEN 2 THEN ' router policy cache' WHEN 3 THEN ' editor buffer undo'
                 WHEN 4 THEN ' search index shards' WHEN 5 THEN ' mailer queue digest'
                 ELSE ' billing ledger export'
               END || ' level ' || CAST(CAST(floor(value / 100) AS INT) AS STRING) AS issue,
               {_K} AS frequency, 'event ' || CAST(event_id AS STRING) AS example
        FROM {{events}} WHERE event_type = 'error'""",
    "harness_friction": """
        SELECT event_id AS ord, 'harness-' || CAST(user_id % 5 AS STRING) AS harness,
               CASE event_id % 4
                 WHEN 0 THEN 'approval dialog blocks long runs'
                 WHEN 1 THEN 'output scrolls past the git diff'
                 WHEN 2 THEN 'cannot resume interrupted install'
                 ELSE 'context window warning appears late'
               END || ' step ' || CAST(user_id % 3 AS STRING) AS issue,
               value / 100.0 AS severity
        FROM {events} WHERE event_type = 'click'""",
    "missing_tooling": """
        SELECT event_id AS ord,
               CASE user_id % 4 WHEN 0 THEN 'branch helper' WHEN 1 THEN 'package installer'
                 WHEN 2 THEN 'log search' ELSE 'widget gauge' END AS tool_name,
               CASE event_id % 5
                 WHEN 0 THEN 'compare nightly builds'
                 WHEN 1 THEN 'collect coverage per module'
                 WHEN 2 THEN 'archive stale branches'
                 WHEN 3 THEN 'watch quota of workers'
                 ELSE 'replay failing sessions'
               END || ' tier ' || CAST(user_id % 6 AS STRING) AS purpose,
               value / 60.0 AS estimated_value
        FROM {events} WHERE event_type = 'view'""",
    "workflow_bottlenecks": f"""
        SELECT event_id AS ord,
               CASE event_id % 6
                 WHEN 0 THEN 'full rebuild before every test'
                 WHEN 1 THEN 'manual copy of release notes'
                 WHEN 2 THEN 'waiting for shared staging machine'
                 WHEN 3 THEN 'searching old threads for decisions'
                 WHEN 4 THEN 'rewriting the same document header'
                 ELSE 'reviewing generated digital assets'
               END || ' phase ' || CAST(user_id % 4 AS STRING) AS description,
               {_K} AS frequency, value AS time_impact_minutes
        FROM {{events}} WHERE event_type = 'purchase'""",
    "repeated_commands": f"""
        SELECT event_id AS ord,
               CASE event_id % 6
                 WHEN 0 THEN 'git status short' WHEN 1 THEN 'git commit amend'
                 WHEN 2 THEN 'ls build logs' WHEN 3 THEN 'cargo test workspace'
                 WHEN 4 THEN 'make document html' ELSE 'find large files'
               END || ' variant' || CAST(user_id % 5 AS STRING) AS command,
               {_K} AS frequency, 'shell-' || CAST(user_id % 4 AS STRING) AS context
        FROM {{events}} WHERE event_type = 'signup'""",
    "repeated_prompts": """
        SELECT o_orderkey AS ord,
               'review ' || lower(o_orderpriority) || ' order in state ' || lower(o_orderstatus)
                 AS prompt_pattern,
               o_orderkey % 400 AS frequency,
               'keep template ' || CAST(o_custkey AS STRING) AS suggested_improvement
        FROM {orders}""",
    "context_loss": """
        SELECT conv_id * 100 + turn AS ord,
               'lost ' || role || ' context at turn ' || CAST(turn AS STRING) AS description,
               'segment-' || CAST(conv_id % 37 AS STRING) AS segment
        FROM {conversations}""",
    "automation_opportunities": """
        SELECT p_partkey AS ord,
               'automate ' || p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS description,
               CAST(p_size * 30.0 AS DOUBLE) AS estimated_time_saved, p_retailprice / 2000.0 AS confidence
        FROM {part}""",
    "registry": """
        SELECT 'tool-' || CAST(p_partkey AS STRING) AS tool,
               lower(p_name || ' ' || p_type || ' workflow notes ' || p_brand) AS searchable,
               '/repos/' || CAST(p_partkey % 40 AS STRING) AS path
        FROM {part}""",
    "runs": """
        SELECT 'run-' || CAST(date_trunc('hour', ts) AS STRING) AS run_id, max(ts) AS generated_at,
               min(CAST(CAST(ts AS DATE) AS STRING)) AS date, count(*) AS raw_entries
        FROM {events} GROUP BY 1""",
    "run_events": """
        SELECT 'run-' || CAST(date_trunc('hour', ts) AS STRING) AS run_id,
               CASE event_id % 3 WHEN 0 THEN 'MissingContext' WHEN 1 THEN 'MissingTool'
                 ELSE 'Hallucination' END AS category
        FROM {events}""",
    "run_patterns": f"""
        SELECT 'run-' || CAST(date_trunc('hour', ts) AS STRING) AS run_id,
               CASE event_type WHEN 'signup' THEN 'RepeatedCommand' WHEN 'view' THEN 'RepeatedPrompt'
                 WHEN 'purchase' THEN 'WorkflowBottleneck' ELSE 'ModelFailure' END AS pattern_type,
               CASE event_id % 4 WHEN 0 THEN 'Repeated command: git status'
                 WHEN 1 THEN 'update the Document index' WHEN 2 THEN 'run the tests'
                 ELSE 'digital search' END AS description,
               sum({_K}) AS frequency
        FROM {{events}} GROUP BY 1, 2, 3""",
    "attempts": """
        SELECT event_id AS attempt_id, 'route-' || CAST(user_id % 8 AS STRING) AS route, ts,
               event_type IN ('purchase', 'signup') AS success,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 200 WHEN event_id % 10 = 0 THEN 401
                 WHEN event_id % 10 < 3 THEN 429 ELSE 500 END AS status
        FROM {events}""",
    "file_status": """
        SELECT event_type AS harness, '/logs/' || event_type AS path,
               '/logs/' || event_type || '/' || CAST(user_id AS STRING) AS source_path,
               CAST(1 AS BIGINT) AS seen,
               CAST(CASE WHEN max(value) > 120 THEN 1 ELSE 0 END AS BIGINT) AS failed,
               CAST(CASE WHEN max(value) > 120 THEN 0 ELSE count(*) END AS BIGINT) AS accepted,
               CASE WHEN max(value) > 120 THEN 'unreadable' END AS warning
        FROM {events} GROUP BY event_type, user_id""",
    "run_files": """
        SELECT page_id, url AS source_path, page_id % 7 <> 0 AS readable,
               html LIKE '%<table%' OR page_id % 3 = 0 AS is_run
        FROM {pages}""",
    "privacy_events": f"""
        SELECT event_id, ts AS observed_at, event_type, 'user-' || CAST(user_id AS STRING) AS entity_id,
               user_id, {_K} AS k,
               CASE user_id % 5 WHEN 0 THEN 'bad tenant' ELSE 'tenant-' || CAST(user_id % 5 AS STRING) END
                 AS tenant
        FROM {{events}}""",
    "attribute_documents": f"""
        SELECT event_id, '{{{{"model":"m' || CAST(user_id % 3 AS STRING) || '","Prompt":"p","access_token":"t","k":'
                 || CAST({_K} AS STRING) || ',"region":"r' || CAST(user_id % 4 AS STRING) || '"}}}}' AS attributes
        FROM {{events}}""",
    "sessions": """
        SELECT 'cohort-' || CAST(user_id % 6 AS STRING) AS cohort, min(ts) AS started_at,
               CAST(sum(CASE WHEN event_id % 12 < 7 THEN 1 ELSE 0 END) AS BIGINT) AS steering,
               sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 1 AS repeated,
               CAST(sum(CASE WHEN event_id % 12 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS context_loss,
               CAST(sum(CASE WHEN event_id % 12 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_tool,
               max(CASE WHEN event_type = 'purchase' THEN value END) AS resolution_minutes,
               max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 AS adopted,
               count(*) AS accepted, count(DISTINCT event_type) AS files,
               CAST(sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS BIGINT) AS privacy_exceptions
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "text_lines": """
        SELECT event_id AS id, ts,
               CASE event_id % 6
                 WHEN 0 THEN '2026-08-07T10:00:00Z'
                 WHEN 1 THEN '2026-08-07T12:30:00.250+02:00'
                 WHEN 2 THEN '2026-08-07 10:00:01'
                 WHEN 3 THEN '2026-08-07T10:00:02'
                 WHEN 4 THEN '2026-08-07T10:00:0x'
                 ELSE 'plain' END || ' ' || CASE event_id % 5 WHEN 0 THEN 'step 1' || chr(13) || 'step 2 '
                   WHEN 1 THEN 'one\u2028two' || chr(133) || 'three ' ELSE '' END || event_type || ' note ' || CAST(user_id AS STRING) AS line
        FROM {events}""",
    "json_records": """
        SELECT event_id AS id, ts,
               CASE event_id % 6
                 WHEN 0 THEN '{{"timestamp":"2026-08-07T10:00:00Z","content":"' || event_type || '","model":"gpt","user_messages":' || CAST(user_id AS STRING) || '}}'
                 WHEN 1 THEN '{{"ts":' || CAST(1780427521 + event_id AS STRING) || ',"content":5,"message":"' || event_type || '","provider":"p"}}'
                 WHEN 2 THEN '{{"timestamp":"yesterday","ts":' || CAST(1780427521000 + event_id AS STRING) || ',"text":"' || event_type || '","user_messages":-3}}'
                 WHEN 3 THEN '{{"msg":"' || event_type || '","model":7,"assistant_messages":2.5}}'
                 WHEN 4 THEN '{{"body":"' || event_type || '"'
                 ELSE '{{"content":"a"}} trailing' END AS line
        FROM {events}""",
    # All eight lists, with full, short, bare-number and prose-number forms; every third
    # response has trailing commas, one inside a string literal must stay.
    "responses": f"""
        SELECT event_id AS batch_no,
               'Here you go: {{{{"model_failures":[{{{{"model":"m' || CAST(user_id % 3 AS STRING) || '","issue":' || CASE event_id % 3 WHEN 1 THEN '0x1F' WHEN 2 THEN '+.5' ELSE '"i"' END || ',"frequency":"'
               || CASE event_id % 4 WHEN 0 THEN '12-plus' WHEN 1 THEN 'three' WHEN 2 THEN '7 times' ELSE '4' END
               || '","example":"e,] +.5 0x1F Infinity"}}}},"short note"' || c || '],"harness_friction":[{{{{"harness":"h' || CAST(user_id % 4 AS STRING)
               || '","issue":"sl' || CASE event_id % 3 WHEN 2 THEN chr(92) || chr(10) ELSE '' END || 'ow","severity":0.25'
               || CASE event_id % 3 WHEN 1 THEN ',"extra":-Infinity' ELSE '' END || c || '}}}}],"missing_tooling":["a linter"' || c || '],"workflow_bottlenecks":[{{{{"description":"wait '
               || CAST(user_id % 9 AS STRING) || '","frequency":' || CAST(user_id % 50 AS STRING) || ',"time_impact_minutes":ten minutes}}}}'
               || c || '],"repeated_commands":[{{{{"command":"git ,}}}} x","frequency":2,"context":"c"}}}}],"repeated_prompts":["again"],"context_loss":'
               || '[{{{{"description":"lost","affected_segments":["s1","s' || CAST(user_id % 6 AS STRING) || '"' || c || ']}}}}]'
               || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"automation_opportunities":[{{{{"description":"d","estimated_time_saved":"'
                    || CAST(user_id % 40 AS STRING) || ' minutes","confidence":0.5}}}}' || c || ']' END || c || '}}}} done' AS text
        FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN ', ' ELSE '' END AS c FROM {{events}})""",
    "prose_numbers": f"""
        SELECT event_id,
               CASE event_id % 8 WHEN 0 THEN CAST({_K} AS STRING) || '-plus' WHEN 1 THEN 'about ' || CAST({_K} AS STRING) || ' minutes'
                 WHEN 2 THEN 'high' WHEN 3 THEN ' Twenty times ' WHEN 4 THEN '-' || CAST({_K} AS STRING) || ' minutes'
                 WHEN 5 THEN '-' || CAST({_K} AS STRING) WHEN 6 THEN CAST({_K} AS STRING) || '.5 h' ELSE event_type END AS label
        FROM {{events}}""",
    "log_table": """
        SELECT o_orderkey AS row_id, o_custkey * 1000 + 1700000000 AS ts,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'order ' || o_orderstatus || ' ' || o_orderpriority END AS feedback_log_body
        FROM {orders}""",
    "envelopes": """
        SELECT page_id,
               CASE page_id % 5
                 WHEN 0 THEN '{{"schema_version":1,"run":{{"id":"' || CAST(page_id AS STRING) || '"}}}}'
                 WHEN 1 THEN '{{"schema_version":2,"run":{{}}}}'
                 WHEN 2 THEN '{{"schema_version":1,"run":"' || CAST(page_id AS STRING) || '"}}'
                 WHEN 3 THEN '[1]'
                 ELSE '{{"run":{{}}}}' END AS envelope
        FROM {pages}""",
}

_TABLE = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def for_database(name: str) -> str:
    """The SQL with bare table names."""
    sql = INPUTS[name]
    return sql.format(**{t: t for t in _TABLE.findall(sql)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = INPUTS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(sql))})
