"""Windowed operators on lines. A line is (doc_id, i, line); order is by i within doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import classify, text


def explode_lines(payloads: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """doc_id, i (from 1), line."""
    return payloads.select(F.col(key).alias("doc_id"), F.posexplode(text.lines(F.col(body))).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("i"), "line")


def _along(*keys: str):
    return Window.partitionBy(*(keys or ("doc_id",))).orderBy("i")


def segment_starts(mode: str, line: Column) -> Column:
    """Whether a line opens a segment."""
    if mode == "hunk":
        return line.startswith("@@ ") | line.startswith("diff --git")
    if mode == "test":
        return line.startswith("test ") | line.startswith("--- FAIL") | line.startswith("--- PASS") | line.rlike("^[✓✔✗✘]") | line.contains("test result:")
    return F.lit(True)


def segments(lines: DataFrame, mode: str) -> DataFrame:
    """doc_id, segment (from 0), first_line, last_line, n_lines, content."""
    numbered = lines.withColumn("segment", F.sum(segment_starts(mode, F.col("line")).cast("long")).over(_along()))
    numbered = numbered.withColumn("segment", F.col("segment") - F.min("segment").over(Window.partitionBy("doc_id")))
    own = numbered.groupBy("doc_id", "segment").agg(F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
    return own.select("doc_id", "segment", "first_line", "last_line", "n_lines", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("content"))


def classified(lines: DataFrame, tool: str | None = None) -> DataFrame:
    """lines with class, base_score and tier."""
    block = classify.block_class(F.col("line"), tool)
    return lines.withColumn("_block", block).withColumn("class", F.col("_block.class")).withColumn("base_score", F.col("_block.score")).drop("_block").withColumn("tier", classify.tier_of(F.col("class")))


def boosted(tiered: DataFrame) -> DataFrame:
    """Promotes Context and Noise among the lines that follow a Critical one."""
    since = F.col("i") - F.last(F.when(F.col("tier") == "Critical", F.col("i")), ignorenulls=True).over(_along())
    lift = F.coalesce(since.between(1, K.BOOST_LINES), F.lit(False)) & F.col("tier").isin("Context", "Noise")
    marked = tiered.withColumn("_lift", lift)
    return marked.withColumn("base_score", F.when(F.col("_lift"), K.BOOST_SCORE).otherwise(F.col("base_score"))).withColumn("tier", F.when(F.col("_lift"), "Important").otherwise(F.col("tier"))).drop("_lift")


def context_score(line: Column, hot_files: dict[str, int], errors: list[str]) -> Column:
    """0.1 * min(count / 10, 0.3) for each hot file that a line names, 0.25 for each active error; capped."""
    total = F.lit(0.0)
    for name, count in sorted(hot_files.items()):
        total = total + F.when(line.contains(name), 0.1 * min(count / 10, 0.3)).otherwise(0.0)
    for e in errors:
        total = total + F.when(line.contains(e[:30]), 0.25).otherwise(0.0)
    return F.least(total, F.lit(K.CONTEXT_BOOST_CAP))


def final_score(base: Column, context: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(base + context, F.lit(1.0)))


def kept_dropped(scored: DataFrame) -> DataFrame:
    """doc_id, kept, dropped by final score."""
    return scored.groupBy("doc_id").agg(F.count_if(F.col("final_score") >= K.KEEP_SCORE).alias("kept"), F.count_if(F.col("final_score") < K.KEEP_SCORE).alias("dropped"))


def density(tiered: DataFrame) -> DataFrame:
    """Lines of each tier in each document, and the share that is noise."""
    counts = [F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("Critical", "Important", "Context", "Noise")]
    return tiered.groupBy("doc_id").agg(*counts, F.count("*").alias("n_lines")).withColumn("reduction", F.round(F.col("noise") / F.col("n_lines"), 6))


def signals(tiered: DataFrame) -> DataFrame:
    """The critical and important lines of a document in order, and the share of others."""

    def listed(tier: str) -> Column:
        rows = F.sort_array(F.collect_list(F.when(F.col("tier") == tier, F.struct("i", "line"))))
        return F.array_join(F.transform(rows, lambda r: r["line"]), "\n")

    return tiered.groupBy("doc_id").agg(listed("Critical").alias("critical"), listed("Important").alias("important"), F.count_if(~F.col("tier").isin("Critical", "Important")).alias("_rest"), F.count("*").alias("_n")).select("doc_id", "critical", "important", F.round(F.col("_rest") / F.col("_n"), 6).alias("dropped_share"))


def diagnose(traces: DataFrame) -> DataFrame:
    """key, verdict of (key, raw, reduced): whether critical lines of raw, by their first 40 characters, are in reduced."""
    lost = F.filter(text.lines(F.col("raw")), lambda x: classify.line_tier(x) == "Critical")
    missing = F.size(F.filter(lost, lambda x: ~F.col("reduced").contains(F.substring(text.trim_u(x), 1, 40))))
    return traces.select(
        "key", missing.cast("long").alias("lost"),
        F.when(F.col("raw") == F.col("reduced"), "Passthrough").when(missing > 0, "FailedSignalDropped").when(F.octet_length("reduced") < F.octet_length("raw") * K.MEANINGFUL, "Success").otherwise("Suboptimal").alias("verdict"),
    )


def fidelity(raw: Column, reduced: Column) -> Column:
    """A payload that states a failure must still state one when reduced."""
    states = lambda c: F.exists(text.lines(c), lambda x: classify.carries_failure(x))
    return ~states(raw) | states(reduced)
