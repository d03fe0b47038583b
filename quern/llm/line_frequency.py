"""Line dedup by site-relative frequency, with DataFrame functions only.

A line's frequency on a host is the number of the host's pages that hold it, divided by the
host's pages. Lines over `max_percent` of the pages, on at least `min_pages` of them, are
boilerplate of that host and are dropped from its pages.

Scale: a page sends each distinct line once, as 16 bytes of SHA-256, and counts are summed
before they are shuffled, so a host or a line that fills a third of the table stays a few
rows for each task. At most (mean lines of a page) * 100 / max_percent lines of a host can be
boilerplate. The list of all hosts is written once and counted: while it is short it is
broadcast and texts never move; beyond that, narrow rows of (page, line) are joined to it and
the lines to drop go back to the pages that have any.

Defined cases: lines are what newlines separate; blank ones (only spaces and controls 9 to
13) are neither counted nor dropped. A null text has no lines and stays null. Pages of a null
host are left as they are. Each row is a page, repeated ones too. A page whose lines all go
keeps an empty text. An empty table gives an empty table. Columns keep their names and order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import content_key, settle

MAX_PERCENT = 5
MIN_PAGES = 3
#: Boilerplate lines of all hosts that may be broadcast: about 60 bytes each.
BROADCAST_LINES = 50_000
#: Lines of one host that may be broadcast: each of its pages looks its own lines up among them.
HOST_LINES = 500

_FULL = r"[^\x20\x09-\x0D]"


def _full_lines(text: Column) -> Column:
    """The distinct keys of a text's lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(_FULL)), content_key))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (16 bytes), pages, total: the lines to drop on each host."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where(F.col("host").isNotNull())
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    lines = pages.where(F.col("text").isNotNull()).select("host", F.explode(_full_lines(F.col("text"))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") * 100 > F.col("total") * max_percent).select("host", "line", "pages", "total")


def _without(text: Column, drop: Column) -> Column:
    """text without the lines in drop, a short array of keys; drop may be null."""
    own = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(_FULL) & F.array_contains(drop, content_key(x))))
    return F.when(F.coalesce(F.size(drop), F.lit(0)) > 0, F.array_join(own, "\n")).otherwise(text)


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the boilerplate lines of each host taken out of its pages."""
    found = settle(boilerplate(docs, host, text, max_percent, min_pages).select("host", "line"))
    columns = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    total, longest = found.groupBy("host").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if total <= broadcast_lines and longest <= HOST_LINES:
        by_host = found.groupBy("host").agg(F.collect_list("line").alias("drop"))
        joined = named.join(F.broadcast(by_host), "host", "left").withColumn("drop", F.array_intersect(_full_lines(F.col("text")), F.col("drop")))
    else:
        page = named.select("host", content_key(F.col("text")).alias("page"), "text").where(F.col("text").isNotNull())
        hits = page.select("host", "page", F.explode(_full_lines(F.col("text"))).alias("line")).distinct().join(found, ["host", "line"])
        by_page = hits.groupBy("host", "page").agg(F.collect_list("line").alias("drop"))
        joined = named.withColumn("page", content_key(F.col("text"))).join(by_page, ["host", "page"], "left")
    return joined.select(*[_without(F.col("text"), F.col("drop")).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of drop_lines(docs)."""
    marked = docs.select("doc_id", "source", "text", F.size(F.split("text", "\n")).alias("before"))
    kept = drop_lines(marked)
    before = F.when(F.col("text").isNull(), 0).otherwise(F.col("before"))
    after = F.when(F.col("text").isNull() | ((F.col("text") == "") & (F.col("before") > 1)), 0).otherwise(F.size(F.split("text", "\n")))
    return kept.select("doc_id", before.cast("long").alias("n_lines"), (before - after).cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), totals AS (SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source),
bad AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source = t.source
  WHERE regexp_matches(l.line, '[^\x20\x09-\x0D]')
  GROUP BY l.source, l.line, t.total
  HAVING count(DISTINCT l.doc_id) >= {MIN_PAGES} AND 100 * count(DISTINCT l.doc_id) > {MAX_PERCENT} * t.total
), judged AS (
  SELECT l.doc_id, l.i, l.line, b.line IS NOT NULL AS dropped
  FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.line = b.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, sha256(k.text) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
