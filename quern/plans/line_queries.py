"""Queries of the line operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import classify, text
from quern.operators import lines as L
from quern.plans.catalog import query
from quern.sources.views import LOG_SQL, log_lines, table


def _any(col: str, marks) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in marks) + ")"


def _starts(col: str, marks) -> str:
    return "(" + " OR ".join(f"starts_with({col}, '{m}')" for m in marks) + ")"


_TRIM = r"regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')"
_TIER = f"""CASE WHEN {_any("c", [m.replace(chr(9), "' || chr(9) || '") for m in K.CRITICAL_MARKS])} THEN 'Critical'
  WHEN {_any("c", K.NOISE_MARKS)} OR {_starts("c", K.NOISE_STARTS)} THEN 'Noise'
  WHEN {_any("c", K.IMPORTANT_MARKS)} OR c = 'ok' THEN 'Important' ELSE 'Context' END"""

_FAILS = f"""({_any("low", K.FAILURE_MARKS)} OR starts_with(low, 'error ') OR regexp_matches(low, '^\\s*[{K.FAIL_GLYPHS}]')
  OR (NOT regexp_matches(low, '^\\s*[{K.PASS_GLYPHS}]') AND regexp_matches(' ' || low || ' ', '[^\\pL\\pN_]fail(ed)?[^\\pL\\pN_]')))"""
_BLOCK = f"""CASE WHEN {_starts("low", K.PROGRESS_STARTS)}
    OR (length(regexp_replace(line, '[^#=]', '', 'g')) > greatest(10, strlen(line) // 4))
    OR ((contains(line, '% |') OR contains(line, ' | ')) AND regexp_matches(line, '^[^%]*[0-9]%')) THEN 'Progress'
  WHEN regexp_matches(c, '^[-=*_]*$') THEN 'Noise' WHEN {_FAILS} THEN 'Critical'
  WHEN {_any("low", K.DIAGNOSTIC_MARKS)} OR (starts_with(low, 'ran ') AND contains(low, ' test')) OR starts_with(low, 'warning[') OR low = 'ok'
    OR regexp_matches(low, '^\\s*\\d+\\s+(pass|passed|fail|failed|skip|skipped|todo)\\b') THEN 'Diagnostic'
  WHEN regexp_matches(line, '[\\w./\\-]+\\.\\w+:\\d+(:\\d+)?') OR (starts_with(c, 'at ') AND contains(line, '(') AND contains(line, ')')) OR starts_with(line, '    ') OR starts_with(line, chr(9)) THEN 'Context'
  WHEN (starts_with(c, '{{') AND ends_with(c, '}}')) OR (starts_with(c, '[') AND ends_with(c, ']')) THEN 'Data' ELSE 'Context' END"""
_SCORE = "CASE WHEN class IN ('Progress', 'Noise', 'Critical') THEN 0.9 WHEN class IN ('Diagnostic', 'Data') THEN 0.8 WHEN plain THEN 0.4 ELSE 0.7 END"
#: Tiered lines of a relation `log`.
TIERED = f"""low AS (SELECT *, lower(line) AS low, {_TRIM} AS c FROM log),
blocks AS (SELECT doc_id, i, line, {_BLOCK} AS class,
  NOT (regexp_matches(line, '[\\w./\\-]+\\.\\w+:\\d+(:\\d+)?') OR (starts_with(c, 'at ') AND contains(line, '(') AND contains(line, ')')) OR starts_with(line, '    ') OR starts_with(line, chr(9))) AS plain FROM low),
tiered AS (SELECT doc_id, i, line, class, CASE class WHEN 'Critical' THEN 'Critical' WHEN 'Diagnostic' THEN 'Important' WHEN 'Context' THEN 'Context' WHEN 'Data' THEN 'Context' ELSE 'Noise' END AS tier, ({_SCORE})::DOUBLE AS base_score FROM blocks),
since AS (SELECT *, i - last_value(CASE WHEN tier = 'Critical' THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap FROM tiered),
lifted AS (SELECT doc_id, i, line, class, CASE WHEN gap BETWEEN 1 AND {K.BOOST_LINES} AND tier IN ('Context', 'Noise') THEN 'Important' ELSE tier END AS tier,
  CASE WHEN gap BETWEEN 1 AND {K.BOOST_LINES} AND tier IN ('Context', 'Noise') THEN {K.BOOST_SCORE} ELSE base_score END AS base_score FROM since)"""
_TIERED = f"{LOG_SQL}, {TIERED}"


@query(f"WITH {LOG_SQL}, t AS (SELECT {_TRIM} AS c FROM log) SELECT {_TIER} AS tier, count(*) AS n_lines FROM t GROUP BY 1")
def tier_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).select(classify.line_tier(F.col("line")).alias("tier")).groupBy("tier").agg(F.count("*").alias("n_lines"))


@query(f"WITH {_TIERED} SELECT class, tier, base_score, count(*) AS n_lines FROM tiered GROUP BY ALL")
def tier_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.classified(log_lines(spark, sf_dir)).groupBy("class", "tier", "base_score").agg(F.count("*").alias("n_lines"))


@query(f"WITH {_TIERED} SELECT doc_id, i, tier, base_score FROM lifted")
def tier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.boosted(L.classified(log_lines(spark, sf_dir))).select("doc_id", "i", "tier", "base_score")


_CONTEXT = "least(0.4, CASE WHEN contains(line, 'page v1') THEN 0.03 ELSE 0 END + CASE WHEN contains(line, 'slow click 2') THEN 0.25 ELSE 0 END)"


@query(f"WITH {_TIERED} SELECT doc_id, i, round(greatest(0, least(1, base_score + {_CONTEXT})), 6) AS final_score FROM lifted")
def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = L.boosted(L.classified(log_lines(spark, sf_dir)))
    return scored.select("doc_id", "i", F.round(L.final_score(F.col("base_score"), L.context_score(F.col("line"), {"page v1": 3}, ["slow click 2"])), 6).alias("final_score"))


@query(f"WITH {_TIERED} SELECT doc_id, count(*) FILTER (WHERE base_score >= 0.75) AS kept, count(*) FILTER (WHERE base_score < 0.75) AS dropped FROM lifted GROUP BY doc_id")
def segments_kept_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a threshold that the log's lines fall on both sides of."""
    shifted = L.boosted(L.classified(log_lines(spark, sf_dir))).withColumn("final_score", F.col("base_score") - F.lit(0.75) + K.KEEP_SCORE + 1e-9)
    return L.kept_dropped(shifted)


@query(f"""WITH {_TIERED} SELECT doc_id, count(*) FILTER (WHERE tier = 'Critical') AS critical, count(*) FILTER (WHERE tier = 'Important') AS important,
  count(*) FILTER (WHERE tier = 'Context') AS context, count(*) FILTER (WHERE tier = 'Noise') AS noise, count(*) AS n_lines,
  round(count(*) FILTER (WHERE tier = 'Noise') / count(*), 6) AS reduction FROM lifted GROUP BY doc_id""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.density(L.boosted(L.classified(log_lines(spark, sf_dir))))


@query(f"""WITH {_TIERED} SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE tier = 'Critical'), '') AS critical,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE tier = 'Important'), '') AS important,
  round(count(*) FILTER (WHERE tier NOT IN ('Critical', 'Important')) / count(*), 6) AS dropped_share FROM lifted GROUP BY doc_id""")
def signal_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.signals(L.boosted(L.classified(log_lines(spark, sf_dir))))


@query(f"WITH {LOG_SQL}, low AS (SELECT doc_id, lower(line) AS low FROM log) SELECT doc_id, count(*) FILTER (WHERE {_FAILS}) AS n_failures FROM low GROUP BY doc_id")
def carries_failure_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(classify.carries_failure(F.col("line"))).alias("n_failures"))


def _segments_sql(start: str) -> str:
    return f"""WITH {LOG_SQL}, marked AS (SELECT doc_id, i, line, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM log),
based AS (SELECT *, s - min(s) OVER (PARTITION BY doc_id) AS segment FROM marked)
SELECT doc_id, segment::BIGINT AS segment, min(i) AS first_line, max(i) AS last_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS content FROM based GROUP BY doc_id, segment"""


@query(_segments_sql("starts_with(line, 'test ') OR starts_with(line, '--- FAIL') OR starts_with(line, '--- PASS') OR regexp_matches(line, '^[✓✔✗✘]') OR contains(line, 'test result:')"))
def segment_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.segments(log_lines(spark, sf_dir), "test")


@query(_segments_sql("starts_with(line, '@@ ') OR starts_with(line, 'diff --git')"))
def segment_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.segments(log_lines(spark, sf_dir), "hunk")


_DOC_LINES = r"""lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
  SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query(f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes, max(i)::BIGINT AS last_line FROM lines GROUP BY doc_id")
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"), F.max("i").alias("last_line"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '>', '', 'g'), '(?s)<.*$', '') AS stripped FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '>', '', 'g'), '(?s)<.*$', '') AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: strlen(x) > 20) AS ls FROM s)
SELECT page_id, len(ls[:40])::BIGINT AS n_lines, array_to_string(ls[:40], chr(10)) AS summary FROM l""")
def web_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 lines of a page's text that are longer than 20 bytes."""
    own = F.slice(F.filter(F.transform(F.split(text.strip_tags(F.col("html")), "\n"), text.trim_u), lambda x: F.octet_length(x) > 20), 1, 40)
    return table(spark, sf_dir, "pages").select("page_id", F.size(own).cast("long").alias("n_lines"), F.array_join(own, "\n").alias("summary"))


@query("SELECT doc_id, ceil(strlen(text) / 3.6)::BIGINT AS mixed, ceil(strlen(text) / 4.5)::BIGINT AS prose FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(n).cast("long").alias("mixed"), text.token_estimate(n, "prose").cast("long").alias("prose"))


@query(f"WITH {_DOC_LINES} SELECT doc_id, i::BIGINT AS i, substr(sha256(regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '')), 1, 16) AS line_key FROM lines")
def line_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(table(spark, sf_dir, "documents")).select("doc_id", "i", text.line_key(F.col("line")).alias("line_key"))
