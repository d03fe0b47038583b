"""The engine's tables made from the driver's: a history of commands, log lines, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern import constants as K

#: Seconds added to event times, so that the history spans K.POST_HOOK_FIX_TS.
CLOCK_SHIFT = K.POST_HOOK_FIX_TS - 1705276800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each command that was reduced."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    size = F.floor(F.col("value") * 100).cast("long")
    e = e.withColumn("input_bytes", size).withColumn("output_bytes", F.expr("input_bytes - (input_bytes * (event_id % 11)) div 11"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + CLOCK_SHIFT).alias("ts"),
        F.col("event_type").alias("filter_name"), F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string")).alias("command"),
        "input_bytes", "output_bytes",
        F.expr("CASE WHEN event_id % 10 < 5 THEN 'Keep' WHEN event_id % 10 < 7 THEN 'Soft' WHEN event_id % 10 < 9 THEN 'Passthrough' ELSE 'Rewind' END").alias("route"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'cursor' WHEN 2 THEN 'terminal' ELSE 'codex' END").alias("agent_id"),
        F.expr("CASE event_id % 13 WHEN 0 THEN 0L WHEN 1 THEN -1L ELSE output_bytes END").alias("delivered_bytes"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN 10 + event_id % 90 ELSE 0L END").alias("collapse_original"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN (10 + event_id % 90) div 3 ELSE 0L END").alias("collapse_to"),
        F.expr("input_bytes div 4").alias("raw_tokens"), F.expr("output_bytes div 4").alias("filtered_tokens"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 9).cast("string")).alias("project_path"), (F.col("event_id") % 50).alias("latency_ms"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN substr(sha2(cast(event_id AS string), 256), 1, 16) ELSE '' END").alias("rewind_hash"),
    )


HISTORY_SQL = f"""history AS (
  SELECT event_id AS id, user_id::VARCHAR AS session_id, floor(epoch(ts))::BIGINT + {CLOCK_SHIFT} AS ts, event_type AS filter_name,
    event_type || ' ' || (event_id % 7)::VARCHAR AS command, input_bytes, output_bytes,
    CASE WHEN event_id % 10 < 5 THEN 'Keep' WHEN event_id % 10 < 7 THEN 'Soft' WHEN event_id % 10 < 9 THEN 'Passthrough' ELSE 'Rewind' END AS route,
    CASE user_id % 4 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'cursor' WHEN 2 THEN 'terminal' ELSE 'codex' END AS agent_id,
    CASE event_id % 13 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE output_bytes END AS delivered_bytes,
    CASE WHEN event_id % 5 = 0 THEN 10 + event_id % 90 ELSE 0 END AS collapse_original,
    CASE WHEN event_id % 5 = 0 THEN (10 + event_id % 90) // 3 ELSE 0 END AS collapse_to,
    input_bytes // 4 AS raw_tokens, output_bytes // 4 AS filtered_tokens, '/p/' || (user_id % 9)::VARCHAR AS project_path, event_id % 50 AS latency_ms,
    CASE WHEN event_id % 6 = 0 THEN substr(sha256(event_id::VARCHAR), 1, 16) ELSE '' END AS rewind_hash
  FROM (SELECT *, input_bytes - (input_bytes * (event_id % 11)) // 11 AS output_bytes FROM (SELECT *, floor(value * 100)::BIGINT AS input_bytes FROM events))
)"""

#: Fixed templates of log lines by event type; %d is the event's number.
LOG_TEMPLATES = {
    "error": "error: op %d", "view": "Compiling page v%d", "click": "warning: slow click %d", "purchase": "test buy_%d ... ok",
    "signup": "GET /signup/%d 200",
}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line: each user's events in order as lines of a log."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    line = F.lit(None).cast("string")
    for kind, template in LOG_TEMPLATES.items():
        a, b = template.split("%d")
        line = F.when(F.col("event_type") == kind, F.concat(F.lit(a), F.col("event_id").cast("string"), F.lit(b))).otherwise(line)
    return e.select(F.col("user_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("i"), line.alias("line"))


LOG_SQL = (
    "log AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{t.split('%d')[0]}' || event_id::VARCHAR || '{t.split('%d')[1]}'" for k, t in LOG_TEMPLATES.items())
    + " END AS line FROM events)"
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, seq, reader, text: conversation turns, each conversation read in order."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("scope"), F.col("turn").alias("seq"), F.col("role").alias("reader"), "text")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, seq, reader, text: documents as payloads, one scope a source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("seq"), F.col("lang").alias("reader"), "text")


def _archived() -> Column:
    """What an archived call printed, from its number and kind."""
    n = F.col("id").cast("string")
    lines = [
        F.concat(F.lit("Compiling unit_"), n), F.concat(F.col("filter_name"), F.lit(" started")),
        F.when(F.col("filter_name") == "error", F.concat(F.lit("error[E"), (F.col("id") % 9).cast("string"), F.lit("]: bad unit"))).otherwise("note: fine"),
        F.concat(F.lit("  --> src/file_"), (F.col("id") % 20).cast("string"), F.lit(".rs:"), n),
        *[F.lit(f"plain {x}") for x in "abcdefg"], F.concat(F.lit("warning: unused x"), (F.col("id") % 4).cast("string")), F.lit("end"),
    ]
    return F.concat_ws("\n", *lines)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, ts, content of the calls whose output was archived."""
    rows = history(spark, sf_dir).where("rewind_hash <> ''")
    return rows.select(F.col("rewind_hash").alias("hash"), "ts", _archived().alias("content"))


ARCHIVE_SQL = """archive AS (SELECT rewind_hash AS hash, ts, concat_ws(chr(10), 'Compiling unit_' || id, filter_name || ' started', CASE WHEN filter_name = 'error' THEN 'error[E' || id % 9 || ']: bad unit' ELSE 'note: fine' END,
  '  --> src/file_' || id % 20 || '.rs:' || id, """ + ", ".join(f"'plain {x}'" for x in "abcdefg") + """, 'warning: unused x' || id % 4, 'end') AS content FROM history WHERE rewind_hash <> '')"""


def passthroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, command, bytes and what the gates found, for each call that was left as it is."""
    rows = history(spark, sf_dir).where("route = 'Passthrough'")
    return rows.select(
        "id", "ts", "command", F.col("input_bytes").alias("bytes"), (F.col("id") % 17 == 0).alias("recovery"), F.when(F.col("id") % 5 == 0, F.when(F.col("id") % 2 == 0, "json").otherwise("yaml")).alias("structured"),
        (F.col("id") % 7 == 0).alias("capped"), (F.col("id") % 3 != 0).alias("guardrail"), (F.col("id") % 4 != 0).alias("fidelity"),
    )


PASSED_SQL = """passed AS (SELECT id, ts, command, input_bytes AS bytes, CASE WHEN id % 17 = 0 THEN 'own recovery command' WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'structured:json' ELSE 'structured:yaml' END
  WHEN id % 7 = 0 THEN 'host output cap' WHEN id % 3 = 0 THEN 'below guardrail' WHEN id % 4 = 0 THEN 'would have dropped the failure' END AS reason FROM history WHERE route = 'Passthrough')"""


def pulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, ts, agent_id, command of each time an archived output was asked for."""
    return history(spark, sf_dir).where("rewind_hash <> '' AND id % 4 = 0").select(F.col("rewind_hash").alias("hash"), "ts", "agent_id", "command", "project_path")


PULLS_SQL = "pulls AS (SELECT rewind_hash AS hash, ts, agent_id, command, project_path FROM history WHERE rewind_hash <> '' AND id % 4 = 0)"
