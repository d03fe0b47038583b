"""Queries of search, recall, memory, rules and the query language, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules, text
from quern.operators import memory as M
from quern.operators import routing, search
from quern.plans.catalog import query
from quern.plans.language import parse, planned
from quern.plans.line_queries import TIERED
from quern.sources.views import ARCHIVE_SQL, HISTORY_SQL, LOG_SQL, PULLS_SQL, archive, history, log_lines, pulls, table

_BM25 = f"""q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '([\\pL\\pN]+)', 1))) AS term FROM benchmark),
s AS (SELECT doc_id, regexp_extract_all(lower(text), '([\\pL\\pN]+)', 1) AS tokens FROM documents), z AS (SELECT doc_id, len(tokens) AS size, tokens FROM s),
w AS (SELECT count(*) AS n, avg(size) AS mean FROM z), t AS (SELECT doc_id, size, unnest(tokens) AS term FROM z),
h AS (SELECT term, doc_id, size, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
p AS (SELECT h.term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * ({search.K1}::DOUBLE + 1) / (tf + {search.K1}::DOUBLE * (1 - {search.B}::DOUBLE + {search.B}::DOUBLE * size / mean)) AS part FROM h JOIN d USING (term) CROSS JOIN w),
r AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM q JOIN p USING (term) GROUP BY 1, 2)"""


@query(f"WITH {_BM25} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM r) WHERE place <= 5")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), items, 5)


@query("""WITH k AS (SELECT 'knowledge' AS source, item_id::VARCHAR AS key, (item_id % 10)::DOUBLE AS score FROM benchmark), e AS (SELECT 'engram' AS source, doc_id::VARCHAR AS key, abs(-(doc_id % 13))::DOUBLE AS score FROM labels)
SELECT * FROM (SELECT * FROM k UNION ALL SELECT * FROM e) ORDER BY score DESC, source, key LIMIT 20""")
def unified_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    knowledge = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), ((F.col("item_id") % 10) / 10).alias("confidence"))
    engrams = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), (-(F.col("doc_id") % 13)).cast("double").alias("rank"))
    return search.unified_recall(knowledge.withColumn("confidence", F.col("confidence")), engrams, 20).withColumn("score", F.round("score", 6))


@query("SELECT substr(sha256(lower(trim(line))), 1, 16) AS pattern_hash, count(*) AS occurrences, min(i) AS first_i, max(i) AS last_i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, doc_id AS i FROM documents) GROUP BY 1 HAVING count(*) >= 2")
def pattern_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"), F.col("doc_id").alias("i"))
    return search.pattern_memory(lines).where("occurrences >= 2")


@query(f"""WITH {LOG_SQL}, p AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(line, '[0-9]+', '#', 'g')), '\\s+'), lambda x: x <> '')[:3], ' ') AS prefix FROM log),
c AS (SELECT doc_id, prefix, count(*) AS n FROM p WHERE prefix <> '' GROUP BY 1, 2 HAVING count(*) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, prefix) AS place FROM c)
SELECT prefix, max(n) AS "count", count(*) AS n_traces FROM k WHERE place <= 16 GROUP BY 1 HAVING count(*) >= 2 ORDER BY "count" DESC, prefix LIMIT 5""")
def noise_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.noise_mining(log_lines(spark, sf_dir))


@query("SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS n_importers, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS importers FROM lineitem GROUP BY 1")
def imported_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return search.imported_by(edges).withColumn("importers", F.array_join(F.col("importers").cast("array<string>"), ","))


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.item_id * 3)")
def unreferenced_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "labels").select("doc_id")
    items = table(spark, sf_dir, "benchmark")
    return items.join(used, F.col("item_id") * 3 == F.col("doc_id"), "left_anti").select("item_id")


@query(f"WITH {HISTORY_SQL} SELECT command, count(*) AS n FROM history WHERE rewind_hash <> '' GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, command LIMIT 5")
def frequent_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where("rewind_hash <> ''").groupBy("command").agg(F.count("*").alias("n")).where("n >= 10").orderBy(F.desc("n"), "command").limit(5)


_PATTERNS = f"""WITH {HISTORY_SQL}, f AS (SELECT 'error in ' || command || ' of ' || session_id AS pattern, filter_name AS family, ts FROM history WHERE route = 'Rewind'), s AS (SELECT filter_name AS family, ts, id, command AS hint FROM history WHERE route = 'Keep'),
k AS (SELECT pattern, arg_min(family, ts) AS family, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM f GROUP BY 1),
p AS (SELECT k.*, (SELECT arg_min(s.hint, row(s.ts, s.id)) FROM s WHERE s.family = k.family AND s.ts > k.last_seen AND s.ts < k.last_seen + 3600) AS hint FROM k)"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    said = F.concat(F.lit("error in "), "command", F.lit(" of "), "session_id")
    failures = h.where("route = 'Rewind'").select(said.alias("pattern"), F.col("filter_name").alias("family"), "ts")
    return search.resolved_patterns(failures, h.where("route = 'Keep'").select(F.col("filter_name").alias("family"), "ts", "id", F.col("command").alias("hint")))


@query(f"{_PATTERNS} SELECT pattern, family, occurrences, first_seen, last_seen, hint IS NOT NULL AS resolved, coalesce(hint, '') AS hint FROM p")
def resolve_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each session that a success of their family follows within an hour."""
    return _patterns(spark, sf_dir)


@query(f"{_PATTERNS} SELECT pattern, occurrences, last_seen, hint IS NOT NULL AS resolved FROM p WHERE occurrences >= 2 ORDER BY last_seen DESC, pattern LIMIT 10")
def top_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_insights(_patterns(spark, sf_dir)).select("pattern", "occurrences", "last_seen", "resolved")


@query(f"WITH {HISTORY_SQL} SELECT filter_name AS tool, count(*) AS total, count(*) FILTER (WHERE route <> 'Rewind') AS ok, count(*) FILTER (WHERE route = 'Rewind') AS err, arg_min(route, row(ts, id)) AS last_status FROM history GROUP BY 1")
def tool_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of a list that grows at its front is the oldest."""
    return history(spark, sf_dir).groupBy(F.col("filter_name").alias("tool")).agg(F.count("*").alias("total"), F.count_if(F.col("route") != "Rewind").alias("ok"), F.count_if(F.col("route") == "Rewind").alias("err"), F.min_by("route", F.struct("ts", "id")).alias("last_status"))


@query("""WITH f AS (SELECT user_id, '/p/' || user_id % 3 || CASE WHEN user_id % 2 = 0 THEN '/app/' || event_type ELSE '/lib' END || '/f' || event_id || '.py' AS path, event_type FROM events)
SELECT user_id AS session_id, CASE WHEN user_id % 2 = 1 THEN 'lib' WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE 'app' END AS domain FROM f GROUP BY 1""")
def infer_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a session works: the last segment that the folders of its files share."""
    u, n = F.col("user_id"), F.col("event_id").cast("string")
    folder = F.concat(F.lit("/p/"), (u % 3).cast("string"), F.when(u % 2 == 0, F.concat(F.lit("/app/"), "event_type")).otherwise("/lib"))
    return M.infer_domain(table(spark, sf_dir, "events").select(u.alias("session_id"), F.concat(folder, F.lit("/f"), n, F.lit(".py")).alias("path")))


_COMMANDS = (
    "git diff HEAD~1", "git status -s", "cargo test --lib", "cargo build", "RUST_LOG=1 cargo clippy", "npm test", "npm run build", "kubectl get pods", "docker build .", "pytest -x tests",
    "grep -r foo .", "tail -f app.log", "psql -c 'select 1'", "gh pr list", "python run.py", "mvn test", "terraform plan", "ls -la",
)
#: Fixed expectations: segmentation, collapse mode, summariser and family of each command.
_EXPECTED = (
    "hunk generic git git_diff", "line generic git git_status", "test test test cargo_test", "line build build cargo_build", "line build build cargo_clippy", "test test js npm_test", "line generic js npm_run", "line infra cloud kubectl_get",
    "line infra cloud docker_build", "test test test pytest", "line log filtered grep", "line log generic tail", "line log database psql", "line log vcs gh", "line generic generic python", "line build test mvn", "line infra cloud terraform", "line generic generic ls",
)
_VALUES = ", ".join("(" + str(k) + ", '" + c.replace("'", "''") + "', " + ", ".join(f"'{x.replace('_', ' ')}'" for x in e.split()) + ")" for k, (c, e) in enumerate(zip(_COMMANDS, _EXPECTED, strict=True)))


@query(f"SELECT v.command, segmentation, collapse, summariser, family, count(*) AS n FROM (VALUES {_VALUES}) AS v(k, command, segmentation, collapse, summariser, family) JOIN events ON event_id % {len(_COMMANDS)} = k GROUP BY ALL")
def command_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each event, and what the rule tables say of it."""
    command = F.element_at(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("event_id") % len(_COMMANDS)).cast("int") + 1)
    own = table(spark, sf_dir, "events").groupBy(command.alias("command")).agg(F.count("*").alias("n"))  # rules are asked once for each distinct command
    return own.select("command", rules.segmentation(F.col("command")).alias("segmentation"), rules.collapse_mode(F.col("command")).alias("collapse"), rules.summariser(F.col("command")).alias("summariser"), rules.command_family(F.col("command")).alias("family"), "n")


@query(f"""WITH {HISTORY_SQL}, r AS (SELECT project_path, round(count(*) FILTER (WHERE route = 'Rewind') / count(*) * (1 + (project_path > '/p/4')::INT * 2), 6) AS rate FROM history GROUP BY 1)
SELECT project_path, rate, round(CASE WHEN rate > 0.25 THEN 0.85 WHEN rate > 0.05 THEN 0.75 ELSE 0.7 END, 6)::DOUBLE AS keep, round(CASE WHEN rate > 0.25 THEN 0.4 WHEN rate > 0.05 THEN 0.33 ELSE 0.3 END, 6)::DOUBLE AS soft FROM r""")
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = history(spark, sf_dir).groupBy("project_path").agg((F.count_if(F.col("route") == "Rewind") / F.count("*")).alias("share"))
    rates = own.select("project_path", F.round(F.col("share") * (1 + (F.col("project_path") > "/p/4").cast("int") * 2), 6).alias("rate"))
    return routing.adapted(rates).select("project_path", "rate", F.round("keep", 6).alias("keep"), F.round("soft", 6).alias("soft"))


def _answer(form: str, chosen: str) -> str:
    """Tiered lines of the archived outputs of some calls."""
    return f"""WITH {HISTORY_SQL}, {ARCHIVE_SQL}, c AS ({chosen}), log AS (SELECT id AS doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS i FROM c JOIN archive a ON a.hash = c.rewind_hash),
{TIERED} SELECT l.doc_id AS id, c.ts, c.command, l.i, l.line FROM lifted l JOIN c ON c.id = l.doc_id WHERE l.tier = '{form}'"""


@query(_answer("Critical", "SELECT * FROM history WHERE rewind_hash <> '' ORDER BY ts DESC, id DESC LIMIT 20"))
def q_errors_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(parse("errors in last 20 commands"), history(spark, sf_dir), archive(spark, sf_dir))


@query(_answer("Important", "SELECT * FROM history WHERE rewind_hash <> '' AND (command ILIKE 'view%' OR filter_name ILIKE 'view%') ORDER BY ts DESC, id DESC LIMIT 50"))
def q_warnings_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(parse("Warnings from VIEW"), history(spark, sf_dir), archive(spark, sf_dir))


@query(f"""WITH {HISTORY_SQL}, {ARCHIVE_SQL}, t AS (SELECT * FROM archive WHERE contains(lower(content), 'src/file_7.') ORDER BY ts DESC, hash LIMIT 20), o AS (SELECT *, list_filter(string_split(content, chr(10)), lambda x: contains(x, 'src/file_7.')) AS own FROM t)
SELECT hash, ts, (SELECT arg_min(command, row(h.ts, h.id)) FROM history h WHERE h.rewind_hash = o.hash) AS command, len(own) AS matches, array_to_string(own, chr(10)) AS lines FROM o WHERE len(own) > 0""")
def q_context_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(parse("context for src/file_7."), history(spark, sf_dir), archive(spark, sf_dir))


@query(f"""WITH {HISTORY_SQL}, m AS (SELECT max(ts) AS now FROM history) SELECT id, ts, command, route, round(CASE WHEN input_bytes > 0 THEN (1 - output_bytes / input_bytes) * 100 ELSE 0 END, 6) AS saved_pct FROM history, m WHERE ts >= now - now % 86400""")
def q_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(parse("timeline today"), history(spark, sf_dir), archive(spark, sf_dir))


@query(f"""WITH {HISTORY_SQL}, {ARCHIVE_SQL}, {PULLS_SQL} SELECT hash, strlen(content) AS original_len, (SELECT count(*) FROM pulls p WHERE p.hash = a.hash) AS retrieved, (SELECT count(*) FROM pulls p WHERE p.hash = a.hash) AS owed, content FROM archive a""")
def retrieve_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = archive(spark, sf_dir).withColumn("original_len", F.octet_length("content").cast("long"))
    return search.retrieved(own, pulls(spark, sf_dir))


@query()
def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that hold the stems of all words asked for, best first; tested against a loop."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 1").select(F.col("conv_id").alias("query_id"), F.col("conv_id").cast("string").alias("scope"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ").alias("text"))
    return search.matching(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").cast("string").alias("scope"), "text"), asked, 5)


@query()
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge of any project that holds the stems of two words, with its content."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("p").alias("project_hash"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("key"), F.col("text").alias("value"))
    asked = items.select(F.col("id").alias("query_id"), F.lit(None).cast("string").alias("scope"), F.array_join(F.slice(F.split("value", r"\s+"), 2, 2), " ").alias("text"))
    return search.content_search(items, asked, 3, ("key", "value")).select("query_id", "doc_id", "place", "score", "key")


@query(r"SELECT event_id, event_type || ' ' || (event_id % 7)::VARCHAR AS short, event_type AS program, coalesce(ceil(strlen(props) / 2.8), 0)::BIGINT AS json_tokens FROM events")
def command_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.concat_ws(" ", F.lit("A=1"), F.concat(F.lit("/usr/bin/"), F.col("event_type")), (F.col("event_id") % 7).cast("string"), F.lit("more"))
    bare = F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string"), F.lit("more"))
    return table(spark, sf_dir, "events").select("event_id", text.shorten_command(bare).alias("short"), text.program_name(command).alias("program"), F.coalesce(text.token_estimate(F.octet_length("props"), "json"), F.lit(0)).cast("long").alias("json_tokens"))
