"""Analytics over the history of reduced commands (columns as in sources.views.history)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions.text import shorten_command

SUMS = ("input_bytes", "output_bytes", "raw_tokens", "filtered_tokens")


def after_fix() -> Column:
    return ~((F.col("agent_id") == "claude_code") & (F.col("ts") < K.POST_HOOK_FIX_TS))


def applied_only() -> Column:
    """Rows whose saving reached a reader."""
    return after_fix() & (F.col("delivered_bytes") != 0) & ~((F.col("delivered_bytes") == -1) & (F.col("agent_id") == "terminal"))


def _totals(count: str = "calls") -> list[Column]:
    return [F.count("*").alias(count), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]]


def aggregate_stats(h: DataFrame, since: int = 0) -> DataFrame:
    return h.where((F.col("ts") >= since) & applied_only()).agg(*_totals(), F.coalesce(F.max("latency_ms"), F.lit(0)).alias("max_latency_ms"))


def filter_breakdown(h: DataFrame, since: int = 0) -> DataFrame:
    key = F.when(F.col("filter_name") == "", "unknown").otherwise(F.col("filter_name"))
    return h.where((F.col("ts") >= since) & applied_only()).groupBy(key.alias("filter")).agg(*_totals()).orderBy(F.desc("calls"), "filter")


def rerun_breakdown(h: DataFrame, min_samples: int = K.RERUN_MIN_SAMPLES, window: int = K.RERUN_WINDOW_SECS) -> DataFrame:
    """By filter: how often a reduced and a raw command was run again within the window, in points.

    The interval semi-join is a window count over (session, command): no row meets another.
    """
    ahead = Window.partitionBy("session_id", F.trim("command")).orderBy("ts").rangeBetween(1, window)
    marked = h.where(after_fix()).withColumn("rerun", (F.count("*").over(ahead) > 0).cast("long")).withColumn("arm", F.col("route") == "Passthrough")

    def of(arm: bool, value: Column) -> Column:
        return F.when(F.col("arm") == arm, value)

    own = marked.groupBy("filter_name").agg(
        F.count(of(False, F.lit(1))).alias("distilled"), F.coalesce(F.sum(of(False, F.col("rerun"))), F.lit(0)).alias("distilled_reruns"),
        F.count(of(True, F.lit(1))).alias("raw"), F.coalesce(F.sum(of(True, F.col("rerun"))), F.lit(0)).alias("raw_reruns"),
        F.floor(F.avg(of(False, F.col("input_bytes")))).alias("distilled_mean"), F.floor(F.avg(of(True, F.col("input_bytes")))).alias("raw_mean"),
    ).where((F.col("distilled") >= min_samples) & (F.col("raw") >= min_samples))
    pct = lambda a, b: F.round(F.col(a) * 100.0 / F.col(b), 4)
    low, high = F.least("distilled_mean", "raw_mean"), F.greatest("distilled_mean", "raw_mean")
    return (
        own.withColumn("distilled_pct", pct("distilled_reruns", "distilled")).withColumn("raw_pct", pct("raw_reruns", "raw"))
        .withColumn("delta_pp", F.round(F.col("distilled_reruns") * 100.0 / F.col("distilled") - F.col("raw_reruns") * 100.0 / F.col("raw"), 4))
        .withColumn("confounded", F.when(low == 0, high > 0).otherwise(high > low * K.SKEW_LIMIT))
        .orderBy(F.desc("delta_pp"), "filter_name")
    )


def route_distribution(h: DataFrame, since: int = 0) -> DataFrame:
    return h.where(F.col("ts") >= since).groupBy("route").agg(F.count("*").alias("calls"))


def rewind_metrics(archive: DataFrame) -> DataFrame:
    return archive.agg(F.count("*").alias("archived"), F.count_if(F.col("retrieved") > 0).alias("retrieved"))


def collapse_aggregate(h: DataFrame) -> DataFrame:
    return h.where("collapse_original > 0").agg(F.count("*").alias("calls"), F.coalesce(F.sum("collapse_original"), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("collapse_to"), F.lit(0)).alias("lines_after"))


def first_of_equal(h: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """keys and the least `order` of the rows that are equal in keys: one aggregate, which keeps no row twice."""
    return h.groupBy(*keys).agg(F.min(order).alias(order))


def latest(h: DataFrame, n: int, session: str | None = None) -> DataFrame:
    rows = h if session is None else h.where(F.col("session_id") == session)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def per_command(h: DataFrame, n: int, since: int = 0) -> DataFrame:
    rows = h.where((F.col("ts") >= since) & applied_only() & (F.col("command") != "") & (F.col("command") != "[pipe]"))
    return rows.groupBy("command").agg(*_totals()).orderBy(F.desc("calls"), "command").limit(n)


def per_command_agent(h: DataFrame, since: int = 0) -> DataFrame:
    rows = h.where((F.col("ts") >= since) & applied_only() & (F.col("command") != "") & (F.col("command") != "[pipe]"))
    return rows.groupBy("command", "agent_id").agg(*_totals())


def agent_breakdown(h: DataFrame, since: int = 0) -> DataFrame:
    ok = applied_only()
    return h.where(F.col("ts") >= since).groupBy("agent_id").agg(
        F.count_if(ok).alias("applied"), F.count_if(~ok).alias("unverified"),
        F.coalesce(F.sum(F.when(ok, F.col("input_bytes"))), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum(F.when(ok, F.col("output_bytes"))), F.lit(0)).alias("output_bytes"),
    )


def multi_period(h: DataFrame, now: int) -> DataFrame:
    """Totals of today (UTC), the last seven days and all time, in one scan."""
    periods = F.array(F.when(F.col("ts") >= now - now % 86400, "Today"), F.when(F.col("ts") >= now - 7 * 86400, "This Week"), F.lit("All Time"))
    return h.where(applied_only()).withColumn("period", F.explode(F.array_compact(periods))).groupBy("period").agg(*_totals())


def project_stats(h: DataFrame, since: int = 0) -> DataFrame:
    own = h.where((F.col("ts") >= since) & applied_only()).groupBy("project_path").agg(*_totals())
    return own.withColumn("savings_pct", F.when(F.col("input_bytes") > 0, F.round(100.0 * (1.0 - F.col("output_bytes") / F.col("input_bytes")), 1)).otherwise(0.0))


def reuse_savings(h: DataFrame, rate: float = K.CACHE_READ_RATE) -> DataFrame:
    """Tokens saved, counted again at `rate` for each later call of a session that still carries them.

    Later calls are n minus the row's place, so a session is sorted once and never collected.
    """
    session = Window.partitionBy("session_id")
    later = F.count("*").over(session) - F.row_number().over(session.orderBy("ts", "id"))
    gain = (F.col("raw_tokens") - F.col("filtered_tokens")) * (1 + F.col("later") * rate)
    return h.withColumn("later", later).where("raw_tokens > filtered_tokens").agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("raw_tokens") - F.col("filtered_tokens")), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum(gain), F.lit(0.0)), 2).alias("tokens_with_reuse"))


def session_summaries(h: DataFrame) -> DataFrame:
    return h.groupBy("session_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("total_commands"), F.sum(F.col("raw_tokens") - F.col("filtered_tokens")).alias("tokens_saved"),
        F.max_by("route", F.struct("ts", "id")).alias("exit_reason"),
    )


def session_lifetime(summaries: DataFrame, compaction: str) -> DataFrame:
    """Sessions, the upper median and the longest of their commands, and those that ended in a compaction.

    Lengths are counted first, so the ranked rows are distinct lengths, not sessions.
    """
    own = summaries.where("total_commands > 0")
    counts = own.groupBy("total_commands").agg(F.count("*").alias("n"))
    total = own.agg(F.count("*").alias("sessions"), F.coalesce(F.max("total_commands"), F.lit(0)).alias("longest"), F.count_if(F.col("exit_reason").ilike(f"%{compaction}%")).alias("compacted"))
    upto = counts.select(F.col("total_commands").alias("length"), F.sum("n").over(Window.orderBy("total_commands")).alias("upto"))
    median = upto.crossJoin(total.select("sessions")).where(F.col("upto") >= F.floor(F.col("sessions") / 2) + 1).agg(F.min("length").alias("median"))
    return total.crossJoin(median).select("sessions", F.coalesce("median", F.lit(0)).alias("median"), "longest", "compacted")


def top_commands(h: DataFrame, n: int) -> DataFrame:
    """Commands by their first two words: calls and the share saved, of tokens or else of bytes."""
    own = per_command(h, 3 * n).withColumn("short", shorten_command(F.col("command"))).groupBy("short").agg(F.sum("calls").alias("calls"), *[F.sum(c).alias(c) for c in SUMS])
    pct = F.when(F.col("raw_tokens") > 0, (1 - F.col("filtered_tokens") / F.col("raw_tokens")) * 100).when(F.col("input_bytes") > 0, (1 - F.col("output_bytes") / F.col("input_bytes")) * 100).otherwise(0.0)
    return own.select("short", "calls", F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0)).alias("bytes_saved"), F.round(pct, 4).alias("savings_pct")).orderBy(F.desc("savings_pct"), "short").limit(n)


def dominant_agent(h: DataFrame) -> DataFrame:
    """The agent with most calls of each command; ties to the first by name."""
    calls = h.groupBy("command", "agent_id").agg(F.count("*").alias("calls"))
    return calls.groupBy("command").agg(F.min(F.struct((-F.col("calls")).alias("less"), F.col("agent_id").alias("agent"))).alias("best")).select("command", F.col("best.agent").alias("agent_id"), (-F.col("best.less")).alias("calls"))


def agent_shares(h: DataFrame) -> DataFrame:
    """Calls and share of each known agent."""
    own = h.where(applied_only() & ~F.col("agent_id").isin("unknown", "terminal", "")).groupBy("agent_id").agg(*_totals())
    total = own.agg(F.sum("calls").alias("all_calls"))
    return own.crossJoin(F.broadcast(total)).select("agent_id", "calls", F.round(F.col("calls") * 100.0 / F.col("all_calls"), 4).alias("share_pct"), "input_bytes", "output_bytes")  # total is one row


def retained(h: DataFrame, now: int, days: int = K.WORKING_DAYS) -> DataFrame:
    return h.where(F.col("ts") >= now - days * 86400)


def retrieve_rate(h: DataFrame, retrieves: DataFrame) -> DataFrame:
    """For each retrieved prefix: min(1, retrieves / max(1, commands that start with it)), ignoring case."""
    own = retrieves.groupBy("prefix").agg(F.count("*").alias("retrieves"))
    commands = h.groupBy(F.lower("command").alias("command")).agg(F.count("*").alias("calls"))
    # Each distinct command's beginnings of the lengths that occur, so that the join is by equality.
    lengths = own.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    starts = commands.crossJoin(F.broadcast(lengths)).select("calls", F.explode(F.transform("lengths", lambda n: F.substring(F.col("command"), F.lit(1), n))).alias("start"), F.col("command"))  # lengths is one row
    starts = starts.dropDuplicates(["command", "start"])
    hits = own.join(starts, F.lower("prefix") == F.col("start"), "left").groupBy("prefix", "retrieves").agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"))
    return hits.withColumn("rate", F.round(F.least(F.lit(1.0), F.col("retrieves") / F.greatest(F.lit(1), F.col("calls"))), 6))


def token_rate(h: DataFrame, samples: int = 10) -> DataFrame:
    """Tokens a call over the last samples of a session, and calls until the window is full (-1: never)."""
    along = Window.partitionBy("session_id").orderBy("ts", "id")
    used = F.sum("filtered_tokens").over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = h.withColumn("used", used).withColumn("first_used", F.first("used").over(along.rowsBetween(-(samples - 1), 0))).withColumn("n", F.least(F.row_number().over(along), F.lit(samples)))
    slope = F.when(F.col("n") > 1, F.floor((F.col("used") - F.col("first_used")) / (F.col("n") - 1))).otherwise(0)
    left = F.greatest(F.lit(K.PRESSURE_WINDOW) - F.col("used"), F.lit(0))
    return rows.withColumn("rate", slope).select("id", "session_id", "used", "rate", F.when(F.col("rate") > 0, F.floor(left / F.col("rate"))).otherwise(-1).alias("calls_left"))


def pressure(h: DataFrame) -> DataFrame:
    """Normal, Warning or Critical by the tokens that a session has used so far."""
    used = F.sum("filtered_tokens").over(Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    share = F.col("used") / K.PRESSURE_WINDOW
    return h.withColumn("used", used).select("id", "session_id", "used", F.when(share >= K.PRESSURE_CRITICAL, "Critical").when(share >= K.PRESSURE_WARN, "Warning").otherwise("Normal").alias("pressure"))


def budget_status(pct: Column) -> Column:
    return F.when(pct >= K.BUDGET_STOP, "STOP").when(pct >= K.BUDGET_CAUTION, "CAUTION").otherwise("PROCEED")


def session_islands(h: DataFrame, gap: int = K.SESSION_GAP_SECS) -> DataFrame:
    """Sessions of each (agent, project): a gap of at least `gap` seconds starts a new one."""
    along = Window.partitionBy("agent_id", "project_path").orderBy("ts", "id")
    new = F.coalesce((F.col("ts") - F.lag("ts").over(along) >= gap).cast("long"), F.lit(0))
    numbered = h.withColumn("new", new).withColumn("island", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("agent_id", "project_path", "island").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_active"), F.count("*").alias("calls"))


def engrams(h: DataFrame) -> DataFrame:
    """Calls that resolve an error: the call before in the session failed (Rewind), this one did not."""
    before = F.lag("route").over(Window.partitionBy("session_id").orderBy("ts", "id"))
    return h.withColumn("before", before).where("before = 'Rewind' AND route <> 'Rewind'").select("id", "session_id", F.lit("ErrorResolved").alias("trigger"))


def peers(sessions: DataFrame, now: int, hours: int = 8) -> DataFrame:
    """Other agents active on the same project in the last hours; one row for each pair of agents of a project."""
    live = sessions.where(F.col("last_active") >= now - hours * 3600).groupBy("project_path", "agent_id").agg(F.max("last_active").alias("last_active"))
    a, b = live.alias("a"), live.alias("b")
    return a.join(b, (F.col("a.project_path") == F.col("b.project_path")) & (F.col("a.agent_id") != F.col("b.agent_id"))).select(F.col("a.project_path"), F.col("a.agent_id"), F.col("b.agent_id").alias("peer"), F.col("b.last_active"))


def duplicate_reads(h: DataFrame) -> DataFrame:
    """By session: commands run again, the largest input and all bytes read."""
    own = h.groupBy("session_id", "command").agg(F.count("*").alias("n"), F.sum("input_bytes").alias("bytes"), F.max("input_bytes").alias("largest"))
    return own.groupBy("session_id").agg(F.sum(F.col("n") - 1).alias("duplicates"), F.max("largest").alias("largest"), F.sum("bytes").alias("bytes_read"))


def running_counters(h: DataFrame) -> DataFrame:
    along = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("id", "session_id", F.sum("input_bytes").over(along).alias("bytes_so_far"), F.count("*").over(along).alias("calls_so_far"))


def bounded_recent(h: DataFrame, n: int = 20) -> DataFrame:
    """The newest n commands of each session, newest first."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("id")))
    return h.withColumn("place", place.cast("long")).where(F.col("place") <= n).select("session_id", "place", "id", "command")
