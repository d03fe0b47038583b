"""Queries of envelopes, gates and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import checks, text
from quern.operators import gates, reports, routing
from quern.operators import history as H
from quern.operators import lines as L
from quern.operators import memory as M
from quern.plans.catalog import query
from quern.plans.history_queries import _OK, NOW
from quern.plans.line_queries import TIERED
from quern.sources import envelopes as E
from quern.sources.views import ARCHIVE_SQL, HISTORY_SQL, LOG_SQL, PASSED_SQL, PULLS_SQL, archive, history, log_lines, passthroughs, pulls, table

_W = f"WITH {HISTORY_SQL}"


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as each of eight hosts would write it, in turn."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    said = F.concat(kind, F.lit(" done "), n)
    obj = lambda **keys: F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()]))
    parts = F.array(F.struct(F.lit("text").alias("type"), said.alias("text")), F.struct(F.lit("text").alias("type"), F.lit("more ").alias("text")))
    made = [
        obj(session_id=F.lit(" s "), tool_name=F.lit("bash"), tool_input=F.struct(kind.alias("command")), tool_response=F.struct(said.alias("stdout"), F.lit("bad").alias("stderr"))),
        obj(tool_name=F.lit("Read"), tool_input=F.struct(kind.alias("file_path")), tool_response=F.struct(parts.alias("content"))),
        obj(toolName=F.lit("shell"), toolInput=F.struct(kind.alias("cmd")), toolResponse=F.struct(said.alias("result"), (F.col("event_id") % 3 == 0).alias("isError"))),
        obj(agent=F.lit("hermes"), tool_name=F.lit("search_files"), command=kind, output=said, exit_code=F.col("event_id") % 2),
        obj(type=F.lit("tool_result"), tool=F.lit("fetch"), result=said, command=kind), obj(action=F.lit("run"), command=kind, stdout=said, exit_code=F.col("event_id") % 3),
        obj(jsonrpc=F.lit("2.0"), result=F.struct(parts.alias("content"))), said,
    ]
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*made), (F.col("event_id") % len(made)).cast("int") + 1).alias("raw"))


@query("""SELECT event_id, ['claude_code', 'cursor', 'pi', 'hermes', 'opencode', 'codex_cli', 'mcp_generic', 'aider'][event_id % 8 + 1] AS agent_id, ['Bash', 'Read', 'Bash', 'Grep', 'WebFetch', 'Bash', 'Bash', 'Bash'][event_id % 8 + 1] AS tool,
  CASE WHEN event_id % 8 < 6 THEN event_type ELSE '' END AS command, event_type || ' done ' || event_id || CASE event_id % 8 WHEN 0 THEN chr(10) || '[stderr]' || chr(10) || 'bad' WHEN 1 THEN chr(10) || 'more' WHEN 6 THEN chr(10) || 'more' ELSE '' END AS content,
  CASE event_id % 8 WHEN 2 THEN event_id % 3 = 0 WHEN 3 THEN event_id % 2 <> 0 WHEN 5 THEN event_id % 3 <> 0 ELSE false END AS failed, CASE event_id % 8 WHEN 0 THEN 's' END AS session_id FROM events""")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.normalized(_raw_events(spark, sf_dir)).select("event_id", "agent_id", "tool", "command", "content", "failed", "session_id")


@query(f"{_W}, {PASSED_SQL} SELECT id, reason FROM passed")
def routing_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates on payloads built so that each of them holds some."""
    own = passthroughs(spark, sf_dir)
    content = F.when(F.col("fidelity"), "error: kept").otherwise(F.concat(F.lit("error: lost\n"), F.repeat(F.lit("x"), 300)))
    made = own.select(
        "id", F.when(F.col("recovery"), F.lit(f"/usr/bin/{gates.OWN} -q retrieve abc")).otherwise(F.col("command")).alias("command"), F.col("structured").alias("format"), F.lit("claude_code").alias("agent_id"),
        F.repeat(F.lit("y"), F.when(F.col("capped"), K.HOST_OUTPUT_CAP).otherwise(10)).alias("stdout"), F.lit(False).alias("failed"), F.lit(True).alias("archived"), "guardrail", "fidelity", content.alias("base"),
    )
    body = F.concat("base", F.lit("\n"), F.repeat(F.lit("plain words\n"), 100))
    final = F.when(~F.col("guardrail"), F.concat(body, F.lit("z"))).when(~F.col("fidelity"), F.lit("short")).otherwise(F.lit("error: kept"))
    gated = gates.reason(made.withColumn("content", body)).withColumnRenamed("reason", "why").withColumn("final", final)
    out = gates.delivered(gated, *K.ROUTE_MODES["balanced"])
    return out.select("id", F.when(F.col("passed"), F.col("why")).otherwise(F.col("reason")).alias("reason"))


@query(f"""{_W}, {PULLS_SQL}, r AS (SELECT command, count(*) AS n FROM pulls WHERE ts >= {NOW} - 7 * 86400 GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, command LIMIT 5)
SELECT 'OverFiltered' AS type, command AS item, n FROM r UNION ALL SELECT 'Underused', item_id::VARCHAR, 0 FROM benchmark WHERE item_id % 3 <> 0""")
def adaptive_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the knowledge, each third item was recalled."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"))
    hits = items.where(F.col("key").try_cast("long") % 3 == 0).select(F.lit("").alias("command"), "key", F.lit(NOW).cast("long").alias("ts"))
    own = pulls(spark, sf_dir).select("command", F.lit(None).cast("string").alias("key"), "ts").unionByName(hits)
    return reports.insights(own, items.unionByName(items.limit(1).select(F.lit("__quern_x").alias("key"))), NOW)


@query(f"{_W}, a AS (SELECT count(*) AS calls, sum(input_bytes)::BIGINT AS i, greatest(sum(input_bytes) - sum(output_bytes), 0)::BIGINT AS saved FROM history WHERE {_OK}) SELECT calls, saved, CASE WHEN i > 0 THEN round(100.0 * saved / i, 1) ELSE 0 END::DOUBLE AS pct FROM a")
def share_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.share_figures(history(spark, sf_dir)).drop("said")


@query(f"""{_W}, t AS (SELECT session_id, CASE WHEN filter_name = 'view' THEN command END AS path, input_bytes AS bytes, id FROM history), f AS (SELECT session_id, path, count(*) AS n, sum(bytes)::BIGINT AS bytes, max(bytes) AS largest FROM t GROUP BY 1, 2)
SELECT session_id, coalesce(sum(bytes) FILTER (WHERE path IS NOT NULL), 0)::BIGINT AS file_reads, coalesce(sum(bytes) FILTER (WHERE path IS NULL), 0)::BIGINT AS tool_outputs, sum(bytes)::BIGINT AS total, count(*) FILTER (WHERE path IS NOT NULL AND n > 1) AS read_twice,
  arg_max(path, row(largest, path)) FILTER (WHERE path IS NOT NULL) AS largest_file FROM f GROUP BY 1""")
def context_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.context_report(history(spark, sf_dir).select("session_id", F.when(F.col("filter_name") == "view", F.col("command")).alias("path"), F.col("input_bytes").alias("bytes")))


@query(f"""{_W}, p AS (SELECT project_path, count(*) AS calls, sum(input_bytes) AS i, sum(output_bytes) AS o FROM history WHERE {_OK} GROUP BY 1)
SELECT project_path, calls, greatest(i - o, 0)::BIGINT AS saved, CASE WHEN i > 0 THEN round(100.0 * (1.0 - o / i), 1) ELSE 0 END::DOUBLE AS savings_pct, round(100.0 * greatest(i - o, 0) / sum(greatest(i - o, 0)) OVER (), 1)::DOUBLE AS share_pct FROM p""")
def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.project_report(history(spark, sf_dir))


@query(f"{_W} SELECT count(*) AS calls, count(DISTINCT filter_name) AS filters FROM history WHERE {_OK}")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, read back."""
    parsed = F.from_json("report", "calls long, filters array<struct<filter:string,calls:long>>")
    return reports.json_report(history(spark, sf_dir)).select(parsed.alias("r")).select("r.calls", F.size("r.filters").cast("long").alias("filters"))


@query(f"""{_W}, l AS (SELECT * FROM history WHERE session_id = '7' ORDER BY ts DESC, id DESC LIMIT 8)
SELECT 'Maker: 7' || chr(10) || 'Criteria: all green' || chr(10) || 'Calls: ' || count(*) || chr(10) || chr(10) || string_agg('- [' || filter_name || '] ' || command, chr(10) ORDER BY ts DESC, id DESC) AS payload, count(*) AS calls FROM l""")
def verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verification(history(spark, sf_dir), "7", "all green", 8)


@query(f"{_W}, {PASSED_SQL} SELECT id, command, reason FROM passed WHERE reason IS NOT NULL ORDER BY id DESC LIMIT 15")
def recent_passthroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = passthroughs(spark, sf_dir).withColumn("reason", routing.passthrough_reason(*[F.col(c) for c in ("recovery", "structured", "capped", "guardrail", "fidelity")]))
    return reports.newest(own.where("reason IS NOT NULL").select("id", "command", "reason"), 15, "id")


@query(f"{_W} SELECT id, ts, session_id, collapse_original AS lines FROM history WHERE collapse_original > 0 ORDER BY ts DESC, id DESC LIMIT 12")
def recent_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest folds; collapsed lines stand for a fold's."""
    own = history(spark, sf_dir).where("collapse_original > 0").select("id", "ts", "session_id", F.col("collapse_original").alias("lines"))
    return reports.newest(own, 12, "ts", "id")


@query(f"{_W} SELECT command AS file_path, count(*) AS accesses FROM history GROUP BY 1 ORDER BY accesses DESC, file_path LIMIT 5")
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).groupBy("session_id", F.col("command").alias("file_path")).agg(F.count("*").alias("access_count"))
    return reports.hot_files(own)


_SAID = ("cat a.txt", "grep x f | wc -l", "git status", "cargo test; ls", "cd x && make", "A=1 docker ps", "python t.py", "kubectl get pods")
#: Fixed expectations: class and shape of each command.
_KINDS = ("file read", "search", "git", "build and test", "other", "infra", "other", "infra")
_SHAPES = ("bare", "pipe", "bare", "chain", "cd", "VAR=", "bare", "bare")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.element_at(F.array(*[F.lit(c) for c in _SAID]), (F.col("id") % len(_SAID)).cast("int") + 1)
    return history(spark, sf_dir).withColumn("command", command)


def _rollup(kinds: tuple[str, ...], name: str) -> str:
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"{_W}, g AS (SELECT [{listed}][id % {len(_SAID)} + 1] AS {name}, input_bytes AS i, greatest(input_bytes - output_bytes, 0) AS s FROM history) SELECT {name}, count(*) AS calls, sum(i)::BIGINT AS bytes, sum(s)::BIGINT AS saved, round(100.0 * sum(s) / sum(i), 1)::DOUBLE AS saved_pct FROM g GROUP BY 1"


@query(_rollup(_KINDS, "class"))
def savings_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(_said(spark, sf_dir), reports.command_class(F.col("command")), "class")


@query(_rollup(_SHAPES, "shape"))
def savings_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rollup(_said(spark, sf_dir), reports.command_shape(F.col("command")), "shape")


_CHAINS = (
    ("cd x && cargo test | tail", "test", "test", "cargo", False), ("docker ps -a", "line", "infra", "docker", True), ("kubectl get pods -o name", "line", "infra", "kubectl", True), ("env FOO=1 \"my tool\" run", "line", "generic", "env", False),
    ("kubectl exec p -- ls", "line", "infra", "kubectl", True), ("ssh host 'make all'", "line", "generic", "ssh", True), ("git diff --stat", "line", "generic", "git", True), ("git diff", "hunk", "generic", "git", False),
    ("az vm list -o tsv", "line", "infra", "az", True), ("gh api x | jq .a", "line", "generic", "jq", False), ("sed -n 1p f", "line", "generic", "sed", True), ("npm test && npm run build", "test", "test", "npm", False),
)
_CHAIN_VALUES = ", ".join("(" + ", ".join([str(k), "'" + c.replace("'", "''") + "'", f"'{a}'", f"'{b}'", f"'{p}'", str(v).lower()]) + ")" for k, (c, a, b, p, v) in enumerate(_CHAINS))


@query(f"SELECT command, segmentation, collapse, producer, verbatim, count(*) AS n FROM (VALUES {_CHAIN_VALUES}) AS v(k, command, segmentation, collapse, producer, verbatim) JOIN events ON event_id % {len(_CHAINS)} = k GROUP BY ALL")
def chain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of commands: the profile of the most specific one, who made the output, whether it must stay as it is."""
    command = F.element_at(F.array(*[F.lit(c[0]) for c in _CHAINS]), (F.col("event_id") % len(_CHAINS)).cast("int") + 1)
    own = table(spark, sf_dir, "events").groupBy(command.alias("command")).agg(F.count("*").alias("n"))  # rules are asked once for each distinct command
    rows = own.select("command", "n", gates.chain_profile(F.col("command")).alias("p"), gates.producer_label(F.col("command")).alias("producer"), gates.passes_verbatim(F.col("command")).alias("verbatim"))
    return rows.select("command", "p.segmentation", "p.collapse", "producer", "verbatim", "n")


@query(f"""{_W}, o AS (SELECT *, lag(route) OVER w AS before, lag(filter_name) OVER w AS tool FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'git commit -m "' || filter_name || CASE WHEN id % 2 = 0 THEN ' instead' ELSE '' END || '"' ELSE command END AS said FROM history) WINDOW w AS (PARTITION BY session_id ORDER BY ts, id))
SELECT id, session_id, CASE WHEN id % 11 = 0 THEN 'Commit' ELSE 'ErrorResolved' END AS trigger, CASE WHEN id % 11 = 0 THEN 'Committed: ' || filter_name || CASE WHEN id % 2 = 0 THEN ' instead' ELSE '' END ELSE 'Resolved ' || filter_name || ' error' END AS label,
  CASE WHEN id % 11 <> 0 THEN 'gotcha' WHEN id % 2 = 0 THEN 'decision' ELSE 'progress' END AS category FROM o WHERE id % 11 = 0 OR (before = 'Rewind' AND route <> 'Rewind')""")
def engram_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, and calls after one that was archived as failing."""
    h = history(spark, sf_dir)
    said = F.when(F.col("id") % 11 == 0, F.concat(F.lit('git commit -m "'), "filter_name", F.when(F.col("id") % 2 == 0, " instead").otherwise(""), F.lit('"'))).otherwise(F.col("command"))
    before = F.lag("route").over(Window.partitionBy("session_id").orderBy("ts", "id"))
    own = h.withColumn("command", said).withColumn("errors", F.coalesce((before == "Rewind").cast("int"), F.lit(0))).withColumn("errors_now", (F.col("route") == "Rewind").cast("int"))
    return M.engrams(own.select("id", "session_id", "ts", "command", F.col("filter_name").alias("tool"), "errors", "errors_now", F.lit(None).cast("string").alias("resolved")))


@query(f"""{_W}, r AS (SELECT session_id, count(*) FILTER (WHERE filter_name = 'error') AS bad, arg_max(command, row(ts, id)) AS newest, session_id::BIGINT % 4 AS k FROM history GROUP BY 1)
SELECT session_id, CASE k WHEN 0 THEN CASE WHEN bad > 0 THEN 'fixing rust tests' ELSE 'running rust tests' END WHEN 1 THEN 'managing kubernetes' ELSE 'running: ' || newest END AS task FROM r""")
def infer_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).groupBy("session_id").agg(F.max_by("command", F.struct("ts", "id")).alias("newest"), F.count_if(F.col("filter_name") == "error").alias("bad"))
    k = F.col("session_id").cast("long") % 4
    more = F.when(k == 0, F.array(F.lit("git status"), F.lit("A=1 cargo test -q"))).when(k == 1, F.array(F.lit("kubectl get pods"))).otherwise(F.array().cast("array<string>"))
    return M.infer_task(own.select("session_id", F.concat(F.array("newest"), more).alias("commands"), F.array_repeat(F.lit("e"), F.col("bad").cast("int")).alias("errors")))


@query()
def pressure_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings with a pause of five calls between them: a fold in order, tested against a loop."""
    h = history(spark, sf_dir)
    along = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    pressed = H.pressure(h.withColumn("filtered_tokens", F.col("filtered_tokens") * 40)).join(h.select("id", F.count("*").over(along).alias("n")), "id")
    return reports.pressure_warnings(pressed)


@query("""SELECT event_id, event_type IN ('purchase') AS mutating, event_type = 'view' AS reading, CASE event_type WHEN 'view' THEN 'f' || event_id WHEN 'click' THEN 'dir' END AS target, event_id % 7 = 0 AS newer,
  CASE event_id % 5 WHEN 0 THEN 'InvalidLoopId' WHEN 1 THEN 'GoalTooLong' WHEN 2 THEN 'GoalContainsShellMetachars' WHEN 3 THEN 'BudgetTooLarge' END AS loop_error FROM events""")
def command_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    command = F.when(kind == "view", F.concat(F.lit("cat f"), n.cast("string"))).when(kind == "click", "rg -n x dir").when(kind == "purchase", "git checkout main").otherwise("echo hi")
    wrong = checks.loop_error(F.when(n % 5 == 0, "a b").otherwise("loop-1"), F.when(n % 5 == 1, F.repeat(F.lit("g"), 501)).when(n % 5 == 2, "a | b").otherwise("goal"), F.when(n % 5 == 3, 10_000_001).otherwise(5))
    newer = checks.is_newer(F.when(n % 7 == 0, "1.10.0").otherwise("1.9.0-rc1"), F.lit("1.9.0"))
    return table(spark, sf_dir, "events").select("event_id", checks.is_mutating(command).alias("mutating"), checks.is_reading(command).alias("reading"), checks.target_file(command).alias("target"), newer.alias("newer"), wrong.alias("loop_error"))


@query("""SELECT event_id, CASE WHEN strlen(event_type || ' é') > event_id % 9 + 2 THEN true ELSE false END AS cut, CASE event_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'json' WHEN 2 THEN 'prose' ELSE 'mixed' END AS hint, format('{:,}', event_id * 1001) AS said, repeat('█', least(round(event_id % 101 / 5.0), 20)::INT) || repeat('░', 20 - least(round(event_id % 101 / 5.0), 20)::INT) AS bar FROM events""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    said = F.concat("event_type", F.lit(" é"))
    cut = F.coalesce(*[F.when(n % 9 == k, text.truncated(said, k + 2).endswith("...")) for k in range(9)])
    path = F.element_at(F.array(*[F.lit(f"a/b.{e}") for e in ("rs", "toml", "md", "xyz")]), (n % 4).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", cut.alias("cut"), text.content_hint(path).alias("hint"), text.thousands(n * 1001).alias("said"), text.bar((n % 101).cast("double")).alias("bar"))


@query(f"{_W}, {ARCHIVE_SQL} SELECT hash, 'plain' AS host, strlen(content) AS n_bytes FROM archive")
def host_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a host without a shape of its own reads back: the result of a JSON reply."""
    own = archive(spark, sf_dir).withColumn("reply", gates.host_reply(F.lit(None).cast("string"), F.col("content"), F.lit(0)))
    return own.select("hash", F.lit("plain").alias("host"), F.octet_length(F.get_json_object("reply", "$.result")).cast("long").alias("n_bytes"))


@query(f"{_W}, f AS (SELECT session_id, id, command AS error, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS place FROM history WHERE filter_name = 'error') SELECT * FROM f WHERE place <= {K.MAX_ERRORS}")
def session_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).select("session_id", "ts", "id", F.when(F.col("filter_name") == "error", F.col("command")).otherwise("").alias("error"))
    return reports.failures(own).select("session_id", "id", "error", "place")


@query(f"WITH {LOG_SQL}, {TIERED} SELECT doc_id, round(sum(CASE tier WHEN 'Critical' THEN 0.9::DOUBLE WHEN 'Important' THEN 0.7::DOUBLE WHEN 'Context' THEN 0.4::DOUBLE ELSE 0.05::DOUBLE END), 4) AS score FROM lifted GROUP BY 1")
def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a log's line scores by their tiers."""
    own = L.boosted(L.classified(log_lines(spark, sf_dir)))
    return own.groupBy("doc_id").agg(F.round(F.sum(reports.line_score(F.col("tier"), F.lit(0.0))), 4).alias("score"))
