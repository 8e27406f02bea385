"""Column layouts of the main tables."""

from pyspark.sql import types as T

# Tool-call parameters and results stay JSON text: they are carried, not queried.
TOOL_CALLS = T.ArrayType(
    T.StructType(
        [
            T.StructField("tool_name", T.StringType()),
            T.StructField("parameters", T.StringType()),
            T.StructField("result", T.StringType()),
            T.StructField("duration_ms", T.LongType()),
        ]
    )
)

ENTRY_COLUMNS = [
    "id", "harness", "ts", "content", "model", "provider", "tool_calls", "user_messages",
    "assistant_messages", "harness_idx", "source_path", "line_key",
]

# Total order of entries: equal instants keep harness order, then file and line order.
ENTRY_ORDER = ["ts", "harness_idx", "source_path", "line_key", "id"]

# Pattern types in declaration order, with their finding table.
PATTERN_TYPES = {
    "ModelFailure": "model_failures",
    "HarnessFriction": "harness_friction",
    "MissingTool": "missing_tooling",
    "WorkflowBottleneck": "workflow_bottlenecks",
    "RepeatedCommand": "repeated_commands",
    "RepeatedPrompt": "repeated_prompts",
    "ContextLoss": "context_loss",
    "AutomationOpportunity": "automation_opportunities",
}

RUN_HEADER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("generated_at", T.TimestampType()),
        T.StructField("date", T.StringType()),
        T.StructField("executive_summary", T.StringType()),
        T.StructField(
            "candidate_tools",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("priority", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)
