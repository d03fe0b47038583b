"""Queries of the ledger, the collapse and the format sniffer, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions.text import handle
from quern.operators import collapse, formats
from quern.operators import ledger as G
from quern.plans.catalog import query
from quern.plans.line_queries import _FAILS
from quern.sources.views import LOG_SQL, log_lines, payloads, shelf, table

_LINES = r"""lines AS (SELECT scope, seq, reader, payload_bytes, unnest(ls) AS line, generate_subscripts(ls, 1)::BIGINT AS i FROM (
  SELECT *, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT *, strlen(text) AS payload_bytes, string_split(text, chr(10)) AS ls FROM payloads))),
hashed AS (SELECT *, strlen(line) + 1 AS bytes, substr(sha256(regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')), 1, 16) AS line_hash, lower(line) AS low FROM lines)"""
_FULL = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_COMMAS = f"list_distinct(list_transform({_FULL}, lambda x: length(x) - length(replace(x, ',', ''))))"
#: Of the structured formats only CSV occurs by chance in the driver's texts; tests cover the sniffer's others.
_PLAIN = f"NOT (len({_FULL}) >= {K.MIN_DELIMITED} AND len({_COMMAS}) = 1 AND {_COMMAS}[1] > 0)"
_DOCS = f"payloads AS (SELECT source AS scope, doc_id AS seq, lang AS reader, text FROM documents WHERE strlen(text) >= {K.MIN_LEDGER_INPUT} AND {_PLAIN})"
_TURNS = f"payloads AS (SELECT conv_id::VARCHAR AS scope, turn AS seq, role AS reader, text FROM conversations WHERE strlen(text) >= {K.MIN_LEDGER_INPUT} AND {_PLAIN})"
_SEEN = f"""{_LINES}, firsts AS (SELECT scope, line_hash, min(seq) AS first_seq, arg_min(reader, row(seq, i)) AS first_reader FROM hashed GROUP BY 1, 2),
seen AS (SELECT *, CASE WHEN seen AND first_reader <> '' AND first_reader <> reader THEN first_reader END AS source FROM (SELECT h.*, first_seq, first_reader, first_seq < seq AND NOT {_FAILS} AS seen FROM hashed h JOIN firsts f USING (scope, line_hash)))"""
_RUNS = f"""{_SEEN}, src AS (SELECT *, sum(CASE WHEN seen THEN bytes ELSE 0 END) OVER (PARTITION BY scope, seq) AS seen_bytes FROM seen),
chg AS (SELECT *, (i > 1 AND (seen <> lag(seen) OVER w OR source IS DISTINCT FROM lag(source) OVER w))::INT AS change FROM src WINDOW w AS (PARTITION BY scope, seq ORDER BY i)),
num AS (SELECT *, sum(change) OVER (PARTITION BY scope, seq ORDER BY i)::BIGINT AS run FROM chg),
runs AS (SELECT scope, seq, run, any_value(source) AS source, min(i) AS first_line, max(i) AS last_line, count(*) AS n_lines, sum(bytes)::BIGINT AS run_bytes, any_value(payload_bytes) AS payload_bytes,
  any_value(seen_bytes) AS seen_bytes, string_agg(line, chr(10) ORDER BY i) AS body FROM num WHERE seen GROUP BY scope, seq, run),
marked AS (SELECT *, substr(sha256(body), 1, 16) AS handle, '{K.MARKER}' || n_lines || ' lines, ' || run_bytes || ' bytes' || CASE WHEN source IS NULL THEN '' ELSE ' first in ' || source END || ', see ' || substr(sha256(body), 1, 16) || ']' AS marker FROM runs),
folds AS (SELECT * FROM marked WHERE NOT (payload_bytes < {K.WHOLE_OUTPUT} AND seen_bytes * 5 >= payload_bytes * 4) AND run_bytes >= strlen(marker) + 1 + {K.RUN_GAIN})"""


@query(f"WITH {_DOCS}, {_SEEN} SELECT scope, count(*) AS n_lines, count(*) FILTER (WHERE seen) AS n_seen, coalesce(sum(bytes) FILTER (WHERE seen), 0)::BIGINT AS seen_bytes FROM seen GROUP BY 1")
def ledger_seen_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seen_lines(shelf(spark, sf_dir)).groupBy("scope").agg(F.count("*").alias("n_lines"), F.count_if("seen").alias("n_seen"), F.coalesce(F.sum(F.when(F.col("seen"), F.col("bytes"))), F.lit(0)).alias("seen_bytes"))


_PROJECT = f"payloads AS (SELECT lang AS scope, doc_id AS seq, source AS reader, text FROM documents WHERE strlen(text) >= {K.MIN_LEDGER_INPUT} AND {_PLAIN})"


@query(f"WITH {_PROJECT}, {_SEEN} SELECT scope, seq, i, seen FROM seen")
def ledger_seen_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seen_lines(shelf(spark, sf_dir).withColumn("scope", F.col("reader"))).select("scope", "seq", "i", "seen")


@query(f"WITH {_DOCS}, {_RUNS} SELECT scope, seq, run, source, first_line, last_line, n_lines, run_bytes FROM runs")
def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.runs(G.seen_lines(shelf(spark, sf_dir))).select("scope", "seq", "run", "source", "first_line", "last_line", "n_lines", "run_bytes")


@query(f"WITH {_DOCS}, {_RUNS} SELECT scope, seq, source, n_lines, run_bytes, handle, marker FROM folds")
def ledger_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.folds(G.seen_lines(shelf(spark, sf_dir))).select("scope", "seq", "source", "n_lines", "run_bytes", "handle", "marker")


@query(f"WITH {_DOCS}, {_RUNS} SELECT scope, count(DISTINCT seq) AS payloads, count(*) AS runs, sum(n_lines)::BIGINT AS lines, sum(run_bytes)::BIGINT AS bytes, sum(strlen(marker) + 1)::BIGINT AS marker_bytes FROM folds GROUP BY 1")
def ledger_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.savings(G.folds(G.seen_lines(shelf(spark, sf_dir))))


@query(f"WITH {_TURNS}, {_SEEN} SELECT scope, seq, count(*) FILTER (WHERE seen) AS n_seen, count(*) AS n_lines FROM seen GROUP BY 1, 2")
def ledger_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seen_lines(payloads(spark, sf_dir)).groupBy("scope", "seq").agg(F.count_if("seen").alias("n_seen"), F.count("*").alias("n_lines"))


@query(f"WITH {_DOCS}, {_LINES} SELECT scope, line_hash, min(seq) AS first_seq FROM hashed GROUP BY 1, 2")
def seen_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_writer(G.hashed_lines(G.eligible(shelf(spark, sf_dir)))).drop("first_reader")


@query(f"""WITH {_DOCS.replace(f" WHERE strlen(text) >= {K.MIN_LEDGER_INPUT} AND {_PLAIN}", "")}, {_LINES}, l AS (SELECT *, row_number() OVER (PARTITION BY scope, line_hash ORDER BY seq, i) AS k FROM hashed WHERE bytes - 1 >= 12)
SELECT scope, sum(bytes)::BIGINT AS bytes, coalesce(sum(bytes) FILTER (WHERE k > 1), 0)::BIGINT AS repeated_bytes FROM l GROUP BY 1""")
def repetition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.repetition_share(shelf(spark, sf_dir))


@query(f"WITH {_DOCS}, {_RUNS}, g AS (SELECT unnest([100, 150, 200]) AS gain) SELECT gain, count(*) AS runs, sum(run_bytes)::BIGINT AS bytes, sum(strlen(marker) + 1)::BIGINT AS marker_bytes FROM marked JOIN g ON run_bytes >= strlen(marker) + 1 + gain GROUP BY 1")
def run_size_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_size_whatif(G.seen_lines(shelf(spark, sf_dir)))


@query("SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS copies, max(doc_id) AS ts, max(strlen(text)) AS original_len FROM documents GROUP BY 1")
def archive_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.archive(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ts"), "text")).drop("content")


@query()
def ledger_two_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are sources, projects languages: sequential by project, so tested against a loop."""
    own = G.two_scopes(shelf(spark, sf_dir), F.col("reader"))
    return own.groupBy("project", "scope").agg(F.sum("n_lines").alias("n_lines"), F.sum("session_seen").alias("session_seen"), F.sum("project_seen").alias("project_seen"), F.sum(F.size("folds")).alias("folds"), F.sum(F.col("payload_bytes") - F.col("view_bytes")).alias("saved_bytes"))


@query()
def ledger_fold_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the folds of both scopes drew on; sequential as well."""
    own = G.fold_facts(G.two_scopes(shelf(spark, sf_dir), F.col("reader")))
    return own.groupBy("project", "origin", "source_agent").agg(F.count("*").alias("payloads"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.count_if("whole_output").alias("whole_outputs"))


@query("SELECT lang, source, substr(sha256(source), 1, 16) AS project_hash, count(*) AS n FROM documents GROUP BY 1, 2, 3")
def project_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source", handle(F.col("source")).alias("project_hash")).agg(F.count("*").alias("n"))


_CRITICAL = "(" + " OR ".join(f"contains(line, '{m}')" for m in K.CRITICAL_MARKS if "\t" not in m) + " OR contains(line, 'FAIL' || chr(9)))"


def _onepass_sql(shape: str) -> str:
    return f"""WITH {LOG_SQL}, o AS (SELECT *, trim(line) <> '' AND NOT {_CRITICAL} AS ok, lower(line) AS low FROM log),
n AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS island, {shape} AS pattern FROM o)
SELECT doc_id, island, pattern, count(*) AS "count", min(i) AS first_line, max(i) AS last_line FROM n WHERE ok GROUP BY 1, 2, 3 HAVING count(*) >= {K.COLLAPSE_MIN_GROUP}"""


_BUILD = "CASE " + " ".join(f"WHEN starts_with(low, '{s}') THEN '{s}_'" for s in collapse.BUILD_STARTS) + " ELSE line END"


@query(_onepass_sql(_BUILD))
def collapse_onepass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.onepass(log_lines(spark, sf_dir), "build")


@query(_onepass_sql(r"CASE WHEN starts_with(line, 'test ') AND contains(line, ' ... ') THEN 'test _ ' || lower(regexp_extract(line, '^.*?( \.\.\. .*)$', 1)) WHEN starts_with(line, 'running ') AND contains(line, ' test') THEN 'running # tests' ELSE line END"))
def collapse_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.onepass(log_lines(spark, sf_dir), "test")


@query()
def collapse_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterates to a fixed point in each document; tested against a second implementation."""
    return collapse.fixpoint(log_lines(spark, sf_dir), "build")


_MADE = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN props || chr(10) || props WHEN 2 THEN 'a,b' || chr(10) || '1,' || event_id || chr(10) || '3,4'
  WHEN 3 THEN 'kind: ' || event_type || chr(10) || 'list:' || chr(10) || '  - ' || event_id WHEN 4 THEN 'a' || chr(9) || 'b' || chr(10) || '1' || chr(9) || '2' || chr(10) || 'x' || chr(9) || 'y' ELSE 'plain words of ' || event_type END"""


@query(f"""WITH p AS (SELECT event_id, event_id % 6 AS kind, {_MADE} AS text FROM events)
SELECT event_id, CASE WHEN kind IN (0) AND json_valid(text) THEN 'json' WHEN kind = 1 AND json_valid(string_split(text, chr(10))[1]) THEN 'ndjson' WHEN kind = 2 THEN 'csv' WHEN kind = 3 THEN 'yaml' WHEN kind = 4 THEN 'tsv' END AS format FROM p""")
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of six shapes made from events."""
    made = (
        F.when(F.col("event_id") % 6 == 0, F.col("props")).when(F.col("event_id") % 6 == 1, F.concat_ws("\n", "props", "props"))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit("a,b\n1,"), F.col("event_id").cast("string"), F.lit("\n3,4")))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit("kind: "), F.col("event_type"), F.lit("\nlist:\n  - "), F.col("event_id").cast("string")))
        .when(F.col("event_id") % 6 == 4, F.lit("a\tb\n1\t2\nx\ty")).otherwise(F.concat(F.lit("plain words of "), F.col("event_type")))
    )
    return table(spark, sf_dir, "events").select("event_id", formats.sniff(made).alias("format"))
