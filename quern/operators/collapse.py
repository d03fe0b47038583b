"""Repetition collapse: lines of one pattern within a run become one line."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import classify, text

#: A build line's first word, and the noun of its summary.
BUILD_STARTS = ("compiling ", "downloading ", "checking ", "fetching ", "locking ", "unpacking ")
SUMMARIES = {
    "build": {"compiling _": "crates compiled", "downloading _": "packages downloaded", "checking _": "crates checked", "fetching _": "packages fetched"},
    "infra": {"-> using cache": "cached layers", "---> _": "layer hashes", "step #/# : _": "build steps"},
    "log": {"info: _": "INFO entries", "debug: _": "DEBUG entries"},
    "test": {"test _  ... ok": "tests passed ✓", "test _  ... ignored": "tests ignored"},
}


def pattern(line: Column, mode: str) -> Column:
    """What lines must have in common to be repetition; by default all of it."""
    c = text.trim_u(text.strip_ansi(line))
    low = F.lower(c)
    if mode == "test":
        return F.when(c.startswith("test ") & c.contains(" ... "), F.concat(F.lit("test _ "), F.lower(F.regexp_extract(c, r"^.*?( \.\.\. .*)$", 1)))).when(c.startswith("running ") & c.contains(" test"), "running # tests").otherwise(c)
    if mode == "build":
        out = F.when(F.lit(False), c)
        for start in BUILD_STARTS:
            out = out.when(low.startswith(start), f"{start}_")
        return out.otherwise(c)
    if mode == "infra":
        return F.when(low.contains("using cache"), "-> using cache").when(c.startswith("--->"), "---> _").when(low.startswith("step ") & low.contains("/"), "step #/# : _").otherwise(c)
    if mode == "log":
        return F.when(low.startswith("info:") | low.contains("[info]") | low.startswith("info "), "info: _").when(low.startswith("debug:") | low.contains("[debug]") | low.startswith("debug "), "debug: _").otherwise(c)
    return c


def collapsible(line: Column) -> Column:
    return (text.trim_u(line) != "") & (classify.line_tier(line) != "Critical")


def onepass(lines: DataFrame, mode: str) -> DataFrame:
    """Groups of one pass: doc_id, island, pattern, count, first_line, last_line (three lines or more)."""
    along = Window.partitionBy("doc_id").orderBy("i")
    own = lines.withColumn("ok", collapsible(F.col("line"))).withColumn("island", F.sum((~F.col("ok")).cast("long")).over(along))
    own = own.where("ok").withColumn("pattern", pattern(F.col("line"), mode))
    return own.groupBy("doc_id", "island", "pattern").agg(F.count("*").alias("count"), F.min("i").alias("first_line"), F.max("i").alias("last_line")).where(F.col("count") >= K.COLLAPSE_MIN_GROUP)


def _summary(mode: str, shape: str, count: int) -> str:
    noun = SUMMARIES.get(mode, {}).get(shape)
    if noun:
        return f"{count} {noun} (collapsed from {count} lines)"
    shown = shape if len(shape) <= 57 else shape[:54] + "..."
    return f'[{count} similar lines collapsed] (pattern: "{shown}")'


def settled(patterns: list[str | None], least: int = K.COLLAPSE_MIN_GROUP) -> dict[int, list[int]]:
    """Groups by their first line, when splitting runs at groups that are too small changes nothing more.

    patterns: of each line, None where it may not be collapsed.
    """
    own = list(patterns)
    while True:
        groups: dict[int, list[int]] = {}
        at: dict[str, int] = {}
        for k, p in enumerate(own):
            if p is None:
                at = {}
            else:
                groups.setdefault(at.setdefault(p, k), []).append(k)
        small = [k for rows in groups.values() if len(rows) < least for k in rows]
        if not small:
            return groups
        for k in small:
            own[k] = None


def fixpoint(lines: DataFrame, mode: str) -> DataFrame:
    """doc_id, lines_before, lines_after, text of each document collapsed to the fixed point.

    A document's lines are put together first; it is bounded by what one payload may hold.
    """
    import pandas as pd

    rows = lines.select("doc_id", "i", "line", F.when(collapsible(F.col("line")), pattern(F.col("line"), mode)).alias("pattern"))
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line", "pattern"))).alias("rows"))

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            out = []
            for doc_id, own in zip(pdf.doc_id, pdf.rows, strict=True):
                text_lines = [r["line"] for r in own]
                after = text_lines
                if len(own) >= K.COLLAPSE_MIN_LINES:
                    groups = settled([r["pattern"] for r in own])
                    gone = {k for rows in groups.values() for k in rows}
                    if mode != "generic" or len(gone) > K.COLLAPSE_RATIO * len(own):
                        after = [_summary(mode, own[k]["pattern"], len(groups[k])) if k in groups else line for k, line in enumerate(text_lines) if k in groups or k not in gone]
                out.append((doc_id, len(text_lines), len(after), "\n".join(after)))
            yield pd.DataFrame(out, columns=["doc_id", "lines_before", "lines_after", "text"])

    return whole.mapInPandas(run, "doc_id long, lines_before long, lines_after long, text string")
