"""Queries of the history operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import constants as K
from quern.operators import history as H
from quern.operators import reports, routing
from quern.plans.catalog import query
from quern.sources.views import HISTORY_SQL, PASSED_SQL, history, passthroughs

#: A moment inside the history: its reports look back from here.
NOW = K.POST_HOOK_FIX_TS + 10 * 86400
_FIX = f"NOT (agent_id = 'claude_code' AND ts < {K.POST_HOOK_FIX_TS})"
_OK = f"({_FIX} AND delivered_bytes <> 0 AND NOT (delivered_bytes = -1 AND agent_id = 'terminal'))"
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in H.SUMS)
_W = f"WITH {HISTORY_SQL}"


@query(f"{_W} SELECT count(*) AS calls, {_SUMS}, coalesce(max(latency_ms), 0) AS max_latency_ms FROM history WHERE {_OK}")
def aggregate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.aggregate_stats(history(spark, sf_dir))


@query(f"{_W} SELECT filter_name AS filter, count(*) AS calls, {_SUMS} FROM history WHERE {_OK} GROUP BY 1")
def filter_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.filter_breakdown(history(spark, sf_dir))


@query(f"""{_W}, m AS (SELECT *, route = 'Passthrough' AS arm, EXISTS (SELECT 1 FROM history b WHERE b.session_id = a.session_id AND trim(b.command) = trim(a.command)
    AND b.ts > a.ts AND b.ts <= a.ts + {K.RERUN_WINDOW_SECS} AND {_FIX.replace("agent_id", "b.agent_id").replace("ts <", "b.ts <")})::INT AS rerun FROM history a WHERE {_FIX}),
g AS (SELECT filter_name, count(*) FILTER (WHERE NOT arm) AS distilled, coalesce(sum(rerun) FILTER (WHERE NOT arm), 0)::BIGINT AS distilled_reruns,
  count(*) FILTER (WHERE arm) AS raw, coalesce(sum(rerun) FILTER (WHERE arm), 0)::BIGINT AS raw_reruns,
  floor(avg(input_bytes) FILTER (WHERE NOT arm))::BIGINT AS distilled_mean, floor(avg(input_bytes) FILTER (WHERE arm))::BIGINT AS raw_mean FROM m GROUP BY 1)
SELECT *, round(distilled_reruns * 100.0::DOUBLE / distilled, 4) AS distilled_pct, round(raw_reruns * 100.0::DOUBLE / raw, 4) AS raw_pct,
  round(distilled_reruns * 100.0::DOUBLE / distilled - raw_reruns * 100.0::DOUBLE / raw, 4) AS delta_pp,
  CASE WHEN least(distilled_mean, raw_mean) = 0 THEN greatest(distilled_mean, raw_mean) > 0 ELSE greatest(distilled_mean, raw_mean) > {K.SKEW_LIMIT} * least(distilled_mean, raw_mean) END AS confounded
FROM g WHERE distilled >= {K.RERUN_MIN_SAMPLES} AND raw >= {K.RERUN_MIN_SAMPLES}""")
def rerun_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rerun_breakdown(history(spark, sf_dir))


@query(f"{_W} SELECT route, count(*) AS calls FROM history GROUP BY 1")
def route_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.route_distribution(history(spark, sf_dir))


@query(f"{_W} SELECT count(*) AS calls, coalesce(sum(collapse_original), 0)::BIGINT AS lines_before, coalesce(sum(collapse_to), 0)::BIGINT AS lines_after FROM history WHERE collapse_original > 0")
def collapse_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.collapse_aggregate(history(spark, sf_dir))


@query(f"{_W}, a AS (SELECT rewind_hash, count(*) - 1 AS retrieved FROM history WHERE rewind_hash <> '' GROUP BY 1) SELECT count(*) AS archived, count(*) FILTER (WHERE retrieved > 0) AS retrieved FROM a")
def rewind_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rewind_metrics(history(spark, sf_dir).where("rewind_hash <> ''").groupBy("rewind_hash").agg((F.count("*") - 1).alias("retrieved")))


@query(f"{_W} SELECT id, session_id, command FROM history")
def dedupe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all but their number and how long they took: a third of the history, written twice, comes out once."""
    h = history(spark, sf_dir)
    again = h.where("id % 3 = 0").withColumn("id", F.col("id") + 10**12).withColumn("latency_ms", F.col("latency_ms") + 1)
    return H.first_of_equal(h.unionByName(again), [c for c in h.columns if c not in ("id", "latency_ms")]).select("id", "session_id", "command")


@query(f"{_W} SELECT id, session_id, ts, command, route FROM history ORDER BY ts DESC, id DESC LIMIT 50")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest(history(spark, sf_dir), 50).select("id", "session_id", "ts", "command", "route")


@query(f"{_W} SELECT command, count(*) AS calls, {_SUMS} FROM history WHERE {_OK} GROUP BY 1 ORDER BY calls DESC, command LIMIT 10")
def per_command_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.per_command(history(spark, sf_dir), 10)


@query(f"{_W} SELECT command, agent_id, count(*) AS calls, {_SUMS} FROM history WHERE {_OK} GROUP BY 1, 2")
def per_command_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.per_command_agent(history(spark, sf_dir))


@query(f"""{_W} SELECT agent_id, count(*) FILTER (WHERE {_OK}) AS applied, count(*) FILTER (WHERE NOT {_OK}) AS unverified,
  coalesce(sum(input_bytes) FILTER (WHERE {_OK}), 0)::BIGINT AS input_bytes, coalesce(sum(output_bytes) FILTER (WHERE {_OK}), 0)::BIGINT AS output_bytes FROM history GROUP BY 1""")
def agent_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.agent_breakdown(history(spark, sf_dir))


@query(f"""{_W}, p AS (SELECT 'Today' AS period, {NOW - NOW % 86400} AS since UNION ALL SELECT 'This Week', {NOW - 7 * 86400} UNION ALL SELECT 'All Time', 0)
SELECT period, count(*) AS calls, {_SUMS} FROM history JOIN p ON ts >= since WHERE {_OK} GROUP BY 1""")
def multi_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.multi_period(history(spark, sf_dir), NOW)


@query(f"{_W} SELECT project_path, count(*) AS calls, {_SUMS}, CASE WHEN sum(input_bytes) > 0 THEN round(100.0::DOUBLE * (1.0::DOUBLE - sum(output_bytes)::DOUBLE / sum(input_bytes)), 1) ELSE 0.0::DOUBLE END AS savings_pct FROM history WHERE {_OK} GROUP BY 1")
def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.project_stats(history(spark, sf_dir))


@query(f"""{_W}, w AS (SELECT *, count(*) OVER (PARTITION BY session_id) - row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS later FROM history)
SELECT count(*) AS calls, coalesce(sum(raw_tokens - filtered_tokens), 0)::BIGINT AS tokens, round(coalesce(sum((raw_tokens - filtered_tokens) * (1 + later * {K.CACHE_READ_RATE}::DOUBLE)), 0), 2) AS tokens_with_reuse FROM w WHERE raw_tokens > filtered_tokens""")
def reuse_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.reuse_savings(history(spark, sf_dir))


_SESSIONS = "s AS (SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS total_commands, sum(raw_tokens - filtered_tokens)::BIGINT AS tokens_saved, arg_max(route, row(ts, id)) AS exit_reason FROM history GROUP BY 1)"


@query(f"{_W}, {_SESSIONS} SELECT * FROM s")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_summaries(history(spark, sf_dir))


@query(f"""{_W}, {_SESSIONS}, r AS (SELECT *, row_number() OVER (ORDER BY total_commands) AS k, count(*) OVER () AS n FROM s WHERE total_commands > 0)
SELECT count(*) AS sessions, coalesce(max(total_commands) FILTER (WHERE k = n // 2 + 1), 0) AS median, coalesce(max(total_commands), 0) AS longest, count(*) FILTER (WHERE exit_reason ILIKE '%soft%') AS compacted FROM r""")
def session_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_lifetime(H.session_summaries(history(spark, sf_dir)), "soft")


@query(f"""{_W}, c AS (SELECT command, count(*) AS calls, {_SUMS} FROM history WHERE {_OK} GROUP BY 1 ORDER BY calls DESC, command LIMIT 30),
g AS (SELECT substr(command, 1, 18) AS short, sum(calls)::BIGINT AS calls, {", ".join(f"sum({c})::BIGINT AS {c}" for c in H.SUMS)} FROM c GROUP BY 1)
SELECT short, calls, greatest(input_bytes - output_bytes, 0) AS bytes_saved, round(CASE WHEN raw_tokens > 0 THEN (1 - filtered_tokens / raw_tokens) * 100 WHEN input_bytes > 0 THEN (1 - output_bytes / input_bytes) * 100 ELSE 0 END, 4) AS savings_pct
FROM g ORDER BY savings_pct DESC, short LIMIT 10""")
def top_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.top_commands(history(spark, sf_dir), 10)


@query(f"{_W}, c AS (SELECT command, agent_id, count(*) AS calls FROM history GROUP BY 1, 2) SELECT command, agent_id, calls FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY calls DESC, agent_id) AS r FROM c) WHERE r = 1")
def dominant_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.dominant_agent(history(spark, sf_dir))


@query(f"""{_W}, a AS (SELECT agent_id, count(*) AS calls, {_SUMS} FROM history WHERE {_OK} AND agent_id NOT IN ('unknown', 'terminal', '') GROUP BY 1)
SELECT agent_id, calls, round(calls * 100.0::DOUBLE / sum(calls) OVER (), 4) AS share_pct, input_bytes, output_bytes FROM a""")
def agent_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.agent_shares(history(spark, sf_dir))


@query(f"{_W} SELECT id, session_id, ts FROM history WHERE ts >= {NOW - K.TRACE_DAYS * 86400}")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.retained(history(spark, sf_dir), NOW, K.TRACE_DAYS).select("id", "session_id", "ts")


@query(f"WITH {HISTORY_SQL}, {PASSED_SQL} SELECT reason, count(*) AS calls, sum(bytes)::BIGINT AS bytes FROM passed WHERE reason IS NOT NULL GROUP BY 1")
def passthrough_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why calls were left as they are: the first gate that held them."""
    own = passthroughs(spark, sf_dir)
    why = routing.passthrough_reason(*[F.col(c) for c in ("recovery", "structured", "capped", "guardrail", "fidelity")])
    return reports.reasons(own.withColumn("reason", why))


_RETRIEVES = "r AS (SELECT upper(substr(command, 1, 5)) AS prefix, count(*) AS retrieves FROM history WHERE rewind_hash <> '' GROUP BY 1)"


@query(f"""{_W}, {_RETRIEVES}, c AS (SELECT prefix, retrieves, (SELECT count(*) FROM history WHERE command ILIKE prefix || '%') AS calls FROM r)
SELECT prefix, retrieves, calls, round(least(1.0::DOUBLE, retrieves / greatest(1, calls)), 6) AS rate FROM c""")
def retrieve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return H.retrieve_rate(h, h.where("rewind_hash <> ''").select(F.upper(F.substring("command", 1, 5)).alias("prefix")))


_USED = "sum(filtered_tokens) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used"


@query(f"""{_W}, u AS (SELECT id, session_id, ts, {_USED} FROM history),
f AS (SELECT *, first_value(used) OVER w AS f, least(row_number() OVER (PARTITION BY session_id ORDER BY ts, id), 10) AS n FROM u WINDOW w AS (PARTITION BY session_id ORDER BY ts, id ROWS 9 PRECEDING)),
r AS (SELECT *, CASE WHEN n > 1 THEN (used - f) // (n - 1) ELSE 0 END AS rate FROM f)
SELECT id, session_id, used, rate, CASE WHEN rate > 0 THEN greatest({K.PRESSURE_WINDOW} - used, 0) // rate ELSE -1 END AS calls_left FROM r""")
def token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.token_rate(history(spark, sf_dir))


@query(f"""{_W}, u AS (SELECT id, session_id, {_USED} FROM history) SELECT id, session_id, used,
  CASE WHEN used >= {K.PRESSURE_CRITICAL}::DOUBLE * {K.PRESSURE_WINDOW} THEN 'Critical' WHEN used >= {K.PRESSURE_WARN}::DOUBLE * {K.PRESSURE_WINDOW} THEN 'Warning' ELSE 'Normal' END AS pressure FROM u""")
def pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.pressure(history(spark, sf_dir))


@query(f"""{_W}, u AS (SELECT session_id, sum(filtered_tokens)::BIGINT AS used FROM history GROUP BY 1)
SELECT session_id, used, CASE WHEN used * 100 // 100000 >= {K.BUDGET_STOP} THEN 'STOP' WHEN used * 100 // 100000 >= {K.BUDGET_CAUTION} THEN 'CAUTION' ELSE 'PROCEED' END AS status FROM u""")
def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = history(spark, sf_dir).groupBy("session_id").agg(F.sum("filtered_tokens").alias("used"))
    return used.select("session_id", "used", H.budget_status(F.floor(F.col("used") * 100 / 100000)).alias("status"))


@query(f"""{_W}, g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= {K.SESSION_GAP_SECS}, false)::INT AS fresh FROM history WINDOW w AS (PARTITION BY agent_id, project_path ORDER BY ts, id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id, project_path ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM g)
SELECT agent_id, project_path, island, min(ts) AS started_at, max(ts) AS last_active, count(*) AS calls FROM n GROUP BY 1, 2, 3""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_islands(history(spark, sf_dir))


@query(f"{_W}, b AS (SELECT *, lag(route) OVER (PARTITION BY session_id ORDER BY ts, id) AS before FROM history) SELECT id, session_id, 'ErrorResolved' AS trigger FROM b WHERE before = 'Rewind' AND route <> 'Rewind'")
def engrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.engrams(history(spark, sf_dir))


@query(f"""{_W}, l AS (SELECT project_path, agent_id, max(ts) AS last_active FROM history WHERE ts >= {NOW - 8 * 3600} GROUP BY 1, 2)
SELECT a.project_path, a.agent_id, b.agent_id AS peer, b.last_active FROM l a JOIN l b ON a.project_path = b.project_path AND a.agent_id <> b.agent_id""")
def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.peers(history(spark, sf_dir).withColumn("last_active", F.col("ts")), NOW)


@query(f"""{_W}, o AS (SELECT session_id, command, count(*) AS n, sum(input_bytes) AS bytes, max(input_bytes) AS largest FROM history GROUP BY 1, 2)
SELECT session_id, sum(n - 1)::BIGINT AS duplicates, max(largest) AS largest, sum(bytes)::BIGINT AS bytes_read FROM o GROUP BY 1""")
def duplicate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.duplicate_reads(history(spark, sf_dir))


@query(f"{_W} SELECT id, session_id, CAST(sum(input_bytes) OVER w AS BIGINT) AS bytes_so_far, count(*) OVER w AS calls_so_far FROM history WINDOW w AS (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.running_counters(history(spark, sf_dir))


@query(f"{_W} SELECT session_id, place, id, command FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS place FROM history) WHERE place <= 20")
def bounded_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.bounded_recent(history(spark, sf_dir))


_MODE = "(1.0::DOUBLE - output_bytes::DOUBLE / input_bytes)"


@query(f"""{_W} SELECT id, CASE WHEN input_bytes > 0 AND {_MODE} >= 0.7 THEN 'Keep' WHEN input_bytes > 0 AND {_MODE} >= 0.3 THEN 'Soft' ELSE 'Passthrough' END AS ratio_route,
  output_bytes < (input_bytes * {K.MIN_REDUCTION_PCT}) // 100 AS beats_guardrail, input_bytes >= {K.MIN_GAIN_INPUT} AND output_bytes < input_bytes AS gains, output_bytes < input_bytes * {K.MEANINGFUL}::DOUBLE AS meaningful FROM history""")
def ratio_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(history(spark, sf_dir)).select("id", "ratio_route", "beats_guardrail", "gains", "meaningful")
