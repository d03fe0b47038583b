"""Queries of sessions, knowledge, snapshots and the import graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import text
from quern.operators import history as H
from quern.operators import lines as L
from quern.operators import memory as M
from quern.plans.catalog import query
from quern.sources.views import HISTORY_SQL, LOG_SQL, PULLS_SQL, history, log_lines, pulls, table

_W = f"WITH {HISTORY_SQL}"


@query(f"""{_W}, s AS (SELECT session_id, max(ts) AS last_active FROM history GROUP BY 1), a AS (SELECT DISTINCT session_id, agent_id, project_path FROM history)
SELECT agent_id, project_path, arg_max(session_id, row(last_active, session_id)) AS session_id, max(last_active) AS last_active FROM s JOIN a USING (session_id) GROUP BY 1, 2""")
def latest_session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    return M.latest_sessions(h.groupBy("session_id").agg(F.max("ts").alias("last_active")), h.select("session_id", "agent_id", "project_path").distinct())


@query(f"{_W} SELECT rewind_hash, arg_min(command, row(ts, id)) AS command FROM history WHERE rewind_hash <> '' GROUP BY 1")
def command_of_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.command_of_hash(history(spark, sf_dir))


@query(f"{_W} SELECT max(ts) FILTER (WHERE route <> 'Passthrough') AS last_reduced, max(ts) FILTER (WHERE route = 'Passthrough') AS last_passed FROM history")
def latest_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest_activity(history(spark, sf_dir))


@query("SELECT item_id::VARCHAR AS key, (item_id % 10) / 10 AS confidence, strlen(text) AS hits FROM benchmark WHERE item_id % 10 >= 5 ORDER BY confidence DESC, hits DESC, key LIMIT 50")
def knowledge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), (F.col("item_id") % 10 / 10).alias("confidence"), F.octet_length("text").cast("long").alias("hits"))
    return M.knowledge_list(own)


@query(f"{_W} SELECT id, agent_id, CASE WHEN route = 'Passthrough' THEN input_bytes ELSE output_bytes END AS output_bytes, CASE WHEN raw_tokens = 0 THEN input_bytes // 4 ELSE raw_tokens END AS raw_tokens FROM history")
def backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.backfilled(history(spark, sf_dir)).select("id", "agent_id", "output_bytes", "raw_tokens")


@query(f"{_W}, b AS (SELECT *, lag(route) OVER (PARTITION BY session_id ORDER BY ts, id) AS before FROM history) SELECT id, session_id, route AS hash FROM b WHERE before IS NULL OR before <> route")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.snapshots(history(spark, sf_dir).select("id", "session_id", "ts", F.col("route").alias("hash"))).select("id", "session_id", "hash")


@query(f"""{_W}, r AS (SELECT id, session_id, count(*) OVER w AS n, CAST(sum(greatest(input_bytes - output_bytes, 0)) OVER w AS BIGINT) AS saved FROM history WINDOW w AS (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT id, session_id, n, saved FROM r WHERE n % 10 = 0 AND saved >= 3600""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.milestones(history(spark, sf_dir))


@query(f"""{_W}, u AS (SELECT session_id, sum(filtered_tokens)::BIGINT AS used, count(*) FILTER (WHERE route = 'Rewind') AS errors, 2000 * (session_id::BIGINT % 4) AS budget FROM history GROUP BY 1)
SELECT session_id, used, CASE WHEN budget > 0 AND used > floor(budget * 0.9::DOUBLE) THEN 'ESCALATE' WHEN used * 50 >= {K.PRESSURE_CRITICAL}::DOUBLE * {K.PRESSURE_WINDOW} THEN 'COMPACT_OR_ESCALATE' ELSE 'CONTINUE' END AS status,
  CASE WHEN errors > 0 THEN 'fix_errors' ELSE 'proceed_goal' END AS focus FROM u""")
def loop_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a budget of 0 (none) to 6,000 tokens, in a context that fifty of them fill."""
    own = history(spark, sf_dir).groupBy("session_id").agg(F.sum("filtered_tokens").alias("used"), F.count_if(F.col("route") == "Rewind").alias("errors"))
    pressure = F.when(F.col("used") * 50 >= K.PRESSURE_CRITICAL * K.PRESSURE_WINDOW, "Critical").otherwise("Normal")
    budget = F.pmod(F.col("session_id").cast("long"), F.lit(4)) * 2000
    return own.select("session_id", "used", M.loop_status(F.col("used"), budget, pressure).alias("status"), M.suggested_focus(F.col("errors")).alias("focus"))


@query("SELECT page_id, split_part(url, '/', 3) AS host, strlen(html) AS n_bytes, ceil(strlen(html) / 3.2)::BIGINT AS code_tokens FROM pages")
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("html")
    return table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), n.cast("long").alias("n_bytes"), text.token_estimate(n, "code").cast("long").alias("code_tokens"))


@query("SELECT event_id, event_type AS stripped, event_type || ' ' || event_id AS message FROM events")
def ansi_and_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured words and commit commands made from events."""
    coloured = F.concat(F.lit("\u001b[1;31m"), F.col("event_type"), F.lit("\u001b[0m"))
    commit = F.concat(F.lit('git commit -a -m "'), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit('" --no-verify'))
    return table(spark, sf_dir, "events").select("event_id", text.strip_ansi(coloured).alias("stripped"), M.commit_message(commit).alias("message"))


@query("""WITH f AS (SELECT DISTINCT user_id % 40 AS k FROM events), s AS (SELECT DISTINCT user_id % 40 AS k, event_type AS t FROM events), c AS (SELECT DISTINCT event_type AS t FROM events)
SELECT 'src/m' || k || '.py' AS source, 'pkg/' || t || '.py' AS target FROM s WHERE t IN ('view', 'click') UNION SELECT 'src/m' || a.k || '.py', 'src/m' || b.k || '.py' FROM f a JOIN f b ON b.k = a.k // 2""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made from events: modules of which only some exist, packages, and files beside them."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("k"), "event_type").distinct()
    k = F.col("k").cast("string")
    body = F.concat(F.lit("from pkg."), F.col("event_type"), F.lit(" import x\nimport os, re\nimport ./m"), F.expr("cast(k div 2 AS string)"), F.lit("\nimport src.m"), F.expr("cast(k div 2 AS string)"), F.lit("\nx = 1\n"))
    files = e.select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), body.alias("text"))
    there = files.unionByName(spark.createDataFrame([(f"pkg/{t}.py", "") for t in ("view", "click")], "path string, text string"))
    return M.resolved_imports(M.import_edges(files), there).where("source <> ''")


@query(f"""WITH {LOG_SQL}, m AS (SELECT *, CASE WHEN starts_with(line, 'error') THEN 1 WHEN trim(line) = '' THEN 0 END AS mark FROM log),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER w AS inside, sum(coalesce(mark, 0)) OVER w AS block FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, block, min(i) AS i, substr(string_agg(line, chr(10) ORDER BY i), 1, 200) AS text FROM b WHERE inside = 1 GROUP BY 1, 2),
f AS (SELECT doc_id, text, min(i) AS i FROM t GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f)
SELECT doc_id, string_agg(text, chr(10) || '--' || chr(10) ORDER BY i) AS errors, count(*) AS n_errors FROM k WHERE place <= 5 GROUP BY 1""")
def extract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extract_errors(log_lines(spark, sf_dir))


@query(f"""{_W} SELECT id AS key, CASE WHEN id % 3 = 0 THEN 'Passthrough' WHEN id % 3 = 1 THEN 'FailedSignalDropped' ELSE 'Success' END AS verdict, CASE WHEN id % 3 = 1 THEN 1 ELSE 0 END::BIGINT AS lost FROM history""")
def diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces made from the history: kept whole, cut with the error, cut without it."""
    raw = F.concat(F.lit("Error: op "), F.col("id").cast("string"), F.lit("\nplain words that only fill the line up to some length\nand one more"))
    reduced = F.when(F.col("id") % 3 == 0, raw).when(F.col("id") % 3 == 1, F.lit("and one more")).otherwise(F.concat(F.lit("Error: op "), F.col("id").cast("string")))
    return L.diagnose(history(spark, sf_dir).select(F.col("id").alias("key"), raw.alias("raw"), reduced.alias("reduced")))


@query(f"""{_W}, {PULLS_SQL}, n AS (SELECT max(ts) AS now FROM history) SELECT (SELECT count(*) FROM pulls) AS memory_reads, (SELECT count(*) FROM labels) AS engrams, (SELECT count(*) FROM benchmark) AS knowledge,
  (SELECT count(*) FROM pulls, n WHERE ts >= now - now % 86400) AS recalls_today, (SELECT count(DISTINCT session_id) FROM history) AS sessions""")
def memory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often memory was read, and what it holds; each count is one row."""
    h, p = history(spark, sf_dir), pulls(spark, sf_dir)
    now = h.agg(F.max("ts").alias("now"))
    read = p.crossJoin(F.broadcast(now)).agg(F.count("*").alias("memory_reads"), F.count_if(F.col("ts") >= F.col("now") - F.col("now") % 86400).alias("recalls_today"))
    for name, own in (("engrams", table(spark, sf_dir, "labels")), ("knowledge", table(spark, sf_dir, "benchmark")), ("sessions", h.select("session_id").distinct())):
        read = read.crossJoin(F.broadcast(own.agg(F.count("*").alias(name))))
    return read


@query(f"{_W} SELECT session_id, total_commands, ended_at FROM (SELECT session_id, count(*) AS total_commands, max(ts) AS ended_at FROM history GROUP BY 1) ORDER BY ended_at DESC, session_id LIMIT 10")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.session_summaries(history(spark, sf_dir)).select("session_id", "total_commands", "ended_at").orderBy(F.desc("ended_at"), "session_id").limit(10)
