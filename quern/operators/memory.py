"""Sessions of agents, knowledge, loops, snapshots and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import contains_any, safe_slice


def latest_sessions(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """The newest session of each (agent, project): an inner join, then a maximum by key."""
    own = sessions.join(agents, "session_id")
    return own.groupBy("agent_id", "project_path").agg(F.max_by("session_id", F.struct("last_active", "session_id")).alias("session_id"), F.max("last_active").alias("last_active"))


def command_of_hash(history: DataFrame) -> DataFrame:
    """The first command that wrote each archive hash."""
    return history.where("rewind_hash <> ''").groupBy("rewind_hash").agg(F.min_by("command", F.struct("ts", "id")).alias("command"))


def latest_activity(history: DataFrame) -> DataFrame:
    return history.agg(F.max(F.when(F.col("route") != "Passthrough", F.col("ts"))).alias("last_reduced"), F.max(F.when(F.col("route") == "Passthrough", F.col("ts"))).alias("last_passed"))


def knowledge_list(knowledge: DataFrame, least: float = 0.5, most: int = 50) -> DataFrame:
    return knowledge.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), F.desc("hits"), "key").limit(most)


def backfilled(history: DataFrame) -> DataFrame:
    """Renamed agents, passed rows that book no saving, tokens from bytes where they are missing."""
    return history.withColumns({
        "agent_id": F.when(F.col("agent_id") == "vscode", "cursor").otherwise(F.col("agent_id")),
        "output_bytes": F.when(F.col("route") == "Passthrough", F.col("input_bytes")).otherwise(F.col("output_bytes")),
        "raw_tokens": F.when(F.col("raw_tokens") == 0, F.expr("input_bytes div 4")).otherwise(F.col("raw_tokens")),
    })


def snapshots(events: DataFrame) -> DataFrame:
    """Snapshots of a session that differ from the one before (session_id, ts, id, hash)."""
    before = F.lag("hash").over(Window.partitionBy("session_id").orderBy("ts", "id"))
    return events.withColumn("before", before).where("before IS NULL OR before <> hash").drop("before")


def milestones(history: DataFrame, every: int = 10, least: int = 3600) -> DataFrame:
    """Every tenth command of a session, if so many bytes were saved by then."""
    along = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = history.withColumn("n", F.count("*").over(along)).withColumn("saved", F.sum(F.greatest(F.col("input_bytes") - F.col("output_bytes"), F.lit(0))).over(along))
    return own.where((F.col("n") % every == 0) & (F.col("saved") >= least)).select("id", "session_id", "n", "saved")


#: How files of a kind name what they import, and the endings tried for a path without one.
IMPORTS = {
    "rs": (r"(?m)^\s*use\s+([a-zA-Z0-9_:]+)", r"(?m)^\s*(?:pub\s+)?mod\s+([a-zA-Z0-9_]+)\s*;"),
    "js": (r"""(?m)^\s*import(?:.|\n)*?from\s+['"]([^'"]+)['"]""", r"""(?m)^\s*import\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""),
    "py": (r"(?m)^\s*import\s+([a-zA-Z0-9_\.]+)", r"(?m)^\s*from\s+([a-zA-Z0-9_\.]+)\s+import"),
    "go": (r"""(?m)^\s*(?:import\s+)?"([^"]+)"\s*$""",),
}
CANDIDATES = ("", ".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", "/mod.rs", "/index.ts", "/index.tsx", "/index.js")


def import_edges(files: DataFrame) -> DataFrame:
    """source, target of (path, text): what each file imports, once, by its extension."""
    kind = F.regexp_extract("path", r"\.([a-z]+)$", 1)
    found = F.array().cast("array<string>")
    for name, patterns in IMPORTS.items():
        kinds = ("js", "ts", "jsx", "tsx") if name == "js" else (name,)
        found = F.when(kind.isin(*kinds), F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns])).otherwise(found)
    return files.select(F.col("path").alias("source"), F.explode(F.array_distinct(found)).alias("target"))


def _normal(path: Column) -> Column:
    """A path without `.` and `..`."""
    start = F.array().cast("array<string>")
    step = lambda out, part: F.when((part == "") | (part == "."), out).when((part == "..") & (F.size(out) > 0), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def resolved_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """source, target: the file of a tree that each import means, by the first candidate that exists; others are dropped.

    One equality join with the paths of files; a last dotted part gives way to a tried ending.
    """
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    own = F.col("target")
    bare = F.regexp_replace(own, "crate::|super::|self::", "")
    base = (
        F.when(own.startswith("."), F.concat(folder, F.lit("/"), own)).when(own.rlike("^(crate|super|self)::"), F.concat(F.lit("src/"), F.replace(bare, F.lit("::"), F.lit("/"))))
        .when(own.contains(".") & ~own.contains("/"), F.replace(own, F.lit("."), F.lit("/"))).otherwise(own)
    )
    rows = edges.withColumn("base", _normal(base)).withColumn("stem", F.regexp_replace("base", r"(?<=[^/])\.[^./]*$", ""))
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.col("base") if not e or e.startswith("/") else F.col("stem"), F.lit(e)).alias("path")) for k, e in enumerate(CANDIDATES)])
    each = rows.select("source", F.col("target").alias("said"), F.inline(tried))
    found = each.join(files.select("path").distinct(), "path").groupBy("source", "said").agg(F.min_by("path", "k").alias("target"))
    return found.select("source", "target").distinct()


def commit_message(command: Column) -> Column:
    """What follows -m in a commit, without its quotes; null if there is none."""
    m = F.regexp_extract(command, r"\s-m\s+(\"[^\"]*\"|'[^']*'|\S+)", 1)
    return F.when(m != "", F.regexp_replace(m, "^[\"']|[\"']$", ""))


def loop_status(used: Column, budget: Column, pressure: Column) -> Column:
    """What an orchestrator should do before its next round: over nine tenths of a budget, and a full context, end it."""
    over = (budget > 0) & (used > F.floor(budget * 0.9))
    return F.when(over, "ESCALATE").when(pressure == "Critical", "COMPACT_OR_ESCALATE").otherwise("CONTINUE")


def suggested_focus(errors: Column) -> Column:
    return F.when(errors > 0, "fix_errors").otherwise("proceed_goal")


def infer_task(sessions: DataFrame) -> DataFrame:
    """session_id, task of (session_id, commands newest first, errors): the first rule that fits, 50 bytes at most."""
    said = lambda *marks: F.exists("commands", lambda c: contains_any(c, marks))
    failing = F.size("errors") > 0
    task = (
        F.when(said("cargo test"), F.when(failing, "fixing rust tests").otherwise("running rust tests"))
        .when(said("npm run build", "npm build"), F.when(failing, "fixing npm build errors").otherwise("building npm"))
        .when(said("git diff") & failing, "debugging active errors").when(said("kubectl"), "managing kubernetes")
        .when(F.size("commands") > 0, F.concat(F.lit("running: "), F.get("commands", F.lit(0))))
    )
    return sessions.select("session_id", F.when(F.octet_length(task) > 50, F.concat(safe_slice(task, 47), F.lit("..."))).otherwise(task).alias("task"))


def infer_domain(files: DataFrame, key: str = "session_id") -> DataFrame:
    """key, domain of (key, path): the last whole or partial segment of the folders' common prefix.

    The prefix of all folders is that of the least and the greatest. One folder alone speaks
    for itself; paths without one give the name of the first file, without its ending.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    own = files.withColumn("folder", F.when(folder != "", folder)).groupBy(key).agg(F.count("folder").alias("n"), F.min("folder").alias("low"), F.max("folder").alias("high"), F.min("path").alias("first"))
    most = F.least(F.length("low"), F.length("high"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(F.col("low"), F.lit(1), k) == F.substring(F.col("high"), F.lit(1), k)), k).otherwise(n))
    prefix = F.substring(F.col("low"), F.lit(1), same)
    last = F.element_at(F.filter(F.split(prefix, "/"), lambda x: x != ""), -1)
    name = F.regexp_extract("first", "([^/]*)$", 1)
    return own.select(key, F.when(F.col("n") > 0, last).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")).alias("domain")).where("domain IS NOT NULL")


#: Words of a commit's label that tell of a decision.
DECISIONS = ("switch", "migrate", "replace", "instead", "decided", "moved to")


def engrams(calls: DataFrame) -> DataFrame:
    """id, session_id, trigger, label, category of the calls worth remembering: commits, and calls after which errors are gone.

    calls: id, session_id, ts, command, tool, errors (how many were open before), errors_now,
    resolved (the error's text or null).
    """
    commit = F.col("command").contains("git commit")
    solved = (F.col("errors") > 0) & (F.col("errors_now") == 0)
    cut = safe_slice
    label = F.when(commit, F.concat(F.lit("Committed: "), cut(F.coalesce(commit_message(F.col("command")), F.lit("commit")), 60))).otherwise(
        F.when(F.col("resolved").isNotNull(), F.concat(F.lit("Fixed "), F.col("tool"), F.lit(" error: "), cut(F.col("resolved"), 50))).otherwise(F.concat(F.lit("Resolved "), F.col("tool"), F.lit(" error"))))
    found = calls.where(commit | solved).select("id", "session_id", F.when(commit, "Commit").otherwise("ErrorResolved").alias("trigger"), label.alias("label"))
    decided = contains_any(F.lower("label"), DECISIONS)
    return found.withColumn("category", F.when(F.col("trigger") == "ErrorResolved", "gotcha").when(decided, "decision").otherwise("progress"))


def extract_errors(lines: DataFrame, most: int = 5, cap: int = 200) -> DataFrame:
    """doc_id, errors: blocks from a line that opens an error to a blank one, distinct, the first ones.

    A block's lines share the number of openings and blanks above them.
    """
    along = Window.partitionBy("doc_id").orderBy("i")
    opens = F.col("line").rlike(r"^\s*(error|Error|ERROR|fatal|panic)\b")
    ends = (F.trim("line") == "") | F.col("line").startswith("Warning:")
    own = lines.withColumn("mark", F.when(opens, 1).when(ends, 0)).withColumn("inside", F.last("mark", ignorenulls=True).over(along)).withColumn("block", F.sum(F.coalesce("mark", F.lit(0))).over(along))
    blocks = own.where("inside = 1").groupBy("doc_id", "block").agg(F.min("i").alias("i"), F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n"), 1, cap).alias("text"))
    firsts = blocks.groupBy("doc_id", "text").agg(F.min("i").alias("i"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    kept = firsts.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda r: r["text"]), "\n--\n").alias("errors"), F.count("*").alias("n_errors"))
