"""Reports put together from the history's aggregates."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import text
from quern.operators import history as H

#: Time scopes by their flags, as seconds back; 0 is since midnight (UTC).
SCOPES = {("--hour", "-H"): ("last hour", 3600), ("--day", "--today", "-d"): ("today", 0), ("--week", "-w"): ("last 7 days", 7 * 86400), ("--month", "-m"): ("last 30 days", 30 * 86400)}


def time_scope(args: list[str], now: int) -> tuple[str, int]:
    """(name, first second) of the window that flags ask for, by default the last 30 days."""
    for flags, (name, back) in SCOPES.items():
        if any(f in args for f in flags):
            return name, now - (back or now % 86400)
    return "last 30 days", now - 30 * 86400


def hot_files(files: DataFrame, most: int = 5) -> DataFrame:
    """The files of most accesses over all sessions, of (session_id, file_path, access_count)."""
    return files.groupBy("file_path").agg(F.sum("access_count").alias("accesses")).orderBy(F.desc("accesses"), "file_path").limit(most)


def newest(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The last rows by some columns, newest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def reasons(passed: DataFrame) -> DataFrame:
    """reason, calls, bytes of payloads left as they are, most frequent first."""
    return passed.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes")).orderBy(F.desc("calls"), "reason")


def insights(pulls: DataFrame, knowledge: DataFrame, now: int, least: int = 3, days: int = 7, most: int = 5) -> DataFrame:
    """type, item, n: commands whose output was asked for again and again, and knowledge (key) that nobody recalled.

    pulls: command, key (of the knowledge that was hit, or null), ts.
    """
    recent = pulls.where((F.col("ts") >= now - days * 86400) & (F.col("command") != ""))
    often = recent.groupBy(F.col("command").alias("item")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "item").limit(most)
    # the underscores of a LIKE pattern stand for any character
    known = knowledge.where(~F.col("key").rlike("(?s)^..quern_"))
    unused = known.join(pulls.where("key IS NOT NULL").select("key").distinct(), "key", "left_anti").select(F.col("key").alias("item"), F.lit(0).cast("long").alias("n"))
    return often.select(F.lit("OverFiltered").alias("type"), "item", "n").unionByName(unused.select(F.lit("Underused").alias("type"), "item", "n"))


def share_figures(h: DataFrame) -> DataFrame:
    """One row: calls, bytes saved (never below 0), their share of the input, as text."""
    own = H.aggregate_stats(h).withColumn("saved", F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0)))
    pct = F.when(F.col("input_bytes") > 0, F.round(100.0 * F.col("saved") / F.col("input_bytes"), 1)).otherwise(0.0)
    return own.select("calls", "saved", pct.alias("pct"), exact_tokens(F.col("saved")).alias("said"))


def exact_tokens(n: Column) -> Column:
    """A number as it is below 1,000, in thousands below a million, and in millions."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.format_string("%.0fK", n / 1000.0)).otherwise(F.format_string("%.1fM", n / 1e6))


def context_report(turns: DataFrame) -> DataFrame:
    """By session: bytes of file reads, of other outputs, both, files read twice, the largest read, of (session_id, path or null, bytes)."""
    own = turns.groupBy("session_id", "path").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
    read = F.col("path").isNotNull()
    return own.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(read, F.col("bytes"))), F.lit(0)).alias("file_reads"), F.coalesce(F.sum(F.when(~read, F.col("bytes"))), F.lit(0)).alias("tool_outputs"), F.sum("bytes").alias("total"),
        F.count_if(read & (F.col("n") > 1)).alias("read_twice"), F.max_by(F.when(read, F.col("path")), F.when(read, F.struct("largest", "path"))).alias("largest_file"),
    )


def project_report(h: DataFrame, since: int = 0) -> DataFrame:
    """Totals of each project, and its share of all bytes saved."""
    own = H.project_stats(h, since).withColumn("saved", F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0)))
    whole = own.agg(F.sum("saved").alias("all_saved"))  # one row
    share = F.when(F.col("all_saved") > 0, F.round(100.0 * F.col("saved") / F.col("all_saved"), 1)).otherwise(0.0)
    return own.crossJoin(F.broadcast(whole)).select("project_path", "calls", "saved", "savings_pct", share.alias("share_pct"))


def json_report(h: DataFrame) -> DataFrame:
    """One row: the totals and the filters as JSON."""
    filters = H.filter_breakdown(h).agg(F.sort_array(F.collect_list(F.struct("filter", "calls", "input_bytes", "output_bytes"))).alias("filters"))  # one row a filter
    return H.aggregate_stats(h).crossJoin(F.broadcast(filters)).select(F.to_json(F.struct("calls", "input_bytes", "output_bytes", "filters")).alias("report"))


def verification(h: DataFrame, session: str, criteria: str, most: int) -> DataFrame:
    """One row: what a checker gets to see of a maker's last calls."""
    rows = H.latest(h, most, session).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("ts")).alias("t"), (-F.col("id")).alias("i"), F.concat(F.lit("- ["), "filter_name", F.lit("] "), "command").alias("said")))).alias("rows"))  # most rows
    head = F.concat(F.lit(f"Maker: {session}\nCriteria: {criteria}\nCalls: "), F.col("n").cast("string"), F.lit("\n\n"))
    listed = F.array_join(F.transform("rows", lambda r: r["said"]), "\n")
    return rows.select(F.when(F.col("n") > 0, F.concat(head, listed)).otherwise(F.lit(f"No activity found for maker session: {session}.")).alias("payload"), F.col("n").alias("calls"))


#: How much is saved by class of command, in the order that is tried: what a command begins with.
CLASSES = (("file read", "cat|head|tail|sed|read"), ("search", "grep|rg|ag|find"), ("git", "git|gh"), ("build and test", "cargo|npm|pytest|make|go|mvn"), ("infra", "docker|kubectl|terraform|helm|aws|az"))


def command_class(command: Column) -> Column:
    program = text.program_name(F.trim(command))
    out = F.when(F.lit(False), "other")
    for name, programs in CLASSES:
        out = out.when(F.lower(program).isin(*programs.split("|")), name)
    return out.otherwise("other")


def command_shape(command: Column) -> Column:
    """How a command is written: several in a row, after a `cd`, piped, after assignments, or bare."""
    c = F.trim(command)
    return F.when(c.rlike(r"^cd\s") & c.contains("&&"), "cd").when(c.rlike("&&|;|\\n"), "chain").when(c.contains("|"), "pipe").when(c.rlike(r"^[A-Za-z0-9_]+=\S*\s"), "VAR=").otherwise("bare")


def rollup(h: DataFrame, key: Column, name: str) -> DataFrame:
    """Calls, bytes, bytes saved and their share by a column of the command."""
    own = h.groupBy(key.alias(name)).agg(F.count("*").alias("calls"), F.sum("input_bytes").alias("bytes"), F.sum(F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0))).alias("saved"))
    return own.withColumn("saved_pct", F.when(F.col("bytes") > 0, F.round(100.0 * F.col("saved") / F.col("bytes"), 1)).otherwise(0.0))


def pressure_warnings(pressed: DataFrame, cooldown: int = 5) -> DataFrame:
    """id, session_id, pressure of the calls that warn: not Normal, and `cooldown` calls after the last warning.

    pressed: id, session_id, n (the call's number), pressure. Whether a call warns depends on
    the calls before it, so a session's warnings are folded in order, as one small array.
    """
    rows = pressed.where("pressure <> 'Normal'").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("n", "id", "pressure"))).alias("rows"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<n:bigint,id:bigint,pressure:string>>").alias("said"))
    due = lambda s, r: s["last"].isNull() | (r["n"] - s["last"] >= cooldown)
    step = lambda s, r: F.when(due(s, r), F.struct(r["n"].alias("last"), F.concat(s["said"], F.array(r)).alias("said"))).otherwise(s)
    return rows.select("session_id", F.inline(F.aggregate("rows", start, step, lambda s: s["said"]))).select("id", "session_id", "n", "pressure")


def failures(events: DataFrame, most: int = K.MAX_ERRORS) -> DataFrame:
    """The newest failures of each session (session_id, ts, id, error), newest first."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))
    return events.where("error <> ''").withColumn("place", place.cast("long")).where(F.col("place") <= most)


def line_score(tier: Column, context: Column) -> Column:
    """A line's score by its tier, with what its context adds, from 0 to 1."""
    base = F.when(tier == "Critical", 0.9).when(tier == "Important", 0.7).when(tier == "Context", 0.4).otherwise(0.05)
    return F.greatest(F.lit(0.0), F.least(base + context, F.lit(1.0)))


def config_of(body: str, agent: str) -> dict:
    """An agent's settings of a TOML text: its own table, or the one for all; a text that isn't TOML has none. `mode` may be called `aggressiveness`."""
    try:
        found = tomllib.loads(body)
    except tomllib.TOMLDecodeError:
        return {"mode": "balanced"}
    own = found.get("agents", {}).get(agent) or found.get("global") or {}
    mode = str(own.get("mode", own.get("aggressiveness", "balanced"))).lower()
    return {**{k: v for k, v in own.items() if k != "aggressiveness"}, "mode": mode if mode in K.ROUTE_MODES else "balanced"}
