"""Summaries of tools' outputs: counts and short lists for each document of lines (doc_id, i, line).

A summary is a table of what to count and what to list. Counting is one aggregation by
document; lists keep the first n by order, chosen from (i, line) pairs that match only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import classify

Rule = Callable[[Column], Column]


def _re(pattern: str) -> Rule:
    return lambda line: line.rlike(pattern)


def _severity(level: str, *higher: str) -> Rule:
    def rule(line: Column) -> Column:
        hit = line.contains(level)
        for h in higher:
            hit = hit & ~line.contains(h)
        return hit

    return rule


#: What to count, by tool.
COUNTS: dict[str, dict[str, Rule]] = {
    "test": {"passed": _re(r"\.\.\. ok$|^--- PASS|^[✓✔]"), "failed": _re(r"\.\.\. FAILED$|^--- FAIL|^FAILED |^[✗✘]"), "ignored": _re(r"\.\.\. ignored$")},
    "build": {"errors": classify.carries_failure, "warnings": lambda x: classify.is_diagnostic(x) & ~classify.carries_failure(x), "steps": classify.is_progress},
    "security": {"critical": _severity("CRITICAL"), "high": _severity("HIGH", "CRITICAL"), "medium": _severity("MEDIUM", "CRITICAL", "HIGH"), "low": _severity("LOW", "CRITICAL", "HIGH", "MEDIUM")},
    "docker_ps": {"total": lambda x: ~x.startswith("CONTAINER ID"), "running": lambda x: x.rlike(r"\sUp\s"), "exited": lambda x: x.rlike(r"\sExited\s")},
    "docker_build": {"steps": _re(r"^Step \d+/\d+"), "cached": lambda x: F.lower(x).contains("using cache"), "built": lambda x: x.contains("Successfully built")},
    "helm": {"deployed": _re(r"\sdeployed\s"), "failed": _re(r"\sfailed\s"), "pending": _re(r"\spending")},
    "terraform": {"add": _re(r"^\s*# \S+ will be created"), "change": _re(r"^\s*# \S+ will be updated"), "destroy": _re(r"^\s*# \S+ will be destroyed")},
    "tsc": {"errors": _re(r"error TS\d+:"), "located": _re(r"^\S+\(\d+,\d+\): error TS\d+:")},
    "prettier": {"unformatted": lambda x: x.startswith("[warn] "), "unchanged": lambda x: x.contains("(unchanged)"), "reformatted": lambda x: x.rlike(r" \d+ms$")},
    "ls": {"items": lambda x: ~x.startswith("total "), "files": lambda x: x.startswith("-"), "dirs": lambda x: x.startswith("d"), "links": lambda x: x.startswith("l")},
    "log": {"errors": lambda x: F.lower(x).contains("error"), "warnings": lambda x: F.lower(x).contains("warn")},
    "database": {"errors": _re(r"^(ERROR|FATAL|PANIC):"), "hints": lambda x: x.startswith("HINT:"), "rows": _re(r"^\(\d+ rows?\)$")},
}

#: What to list, by tool: the rule and how many.
LISTS: dict[str, dict[str, tuple[Rule, int]]] = {
    "test": {"failures": (COUNTS["test"]["failed"], 10)}, "build": {"first_errors": (COUNTS["build"]["errors"], 5)}, "security": {"worst": (COUNTS["security"]["critical"], 5)},
    "docker_ps": {"names": (COUNTS["docker_ps"]["exited"], 5)}, "terraform": {"resources": (_re(r"^\s*# \S+ will be "), 5)}, "database": {"first_errors": (COUNTS["database"]["errors"], 3)},
    "vcs_list": {"shown": (lambda x: F.trim(x) != "", 10)}, "tree": {"top": (_re(r"^[├└]── "), 8)}, "log": {"first_errors": (COUNTS["log"]["errors"], 10)},
}


def first_lines(rule: Column, n: int) -> Column:
    """The first n lines of a document that match, joined by newlines."""
    rows = F.sort_array(F.collect_list(F.when(rule, F.struct("i", "line"))))
    return F.array_join(F.transform(F.slice(rows, 1, n), lambda r: r["line"]), "\n")


def summary(lines: DataFrame, tool: str) -> DataFrame:
    """doc_id, n_lines, and the counts and lists of a tool."""
    counts = [F.count_if(rule(F.col("line"))).alias(name) for name, rule in COUNTS.get(tool, {}).items()]
    lists = [first_lines(rule(F.col("line")), n).alias(name) for name, (rule, n) in LISTS.get(tool, {}).items()]
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), *counts, *lists)


def git_status(lines: DataFrame) -> DataFrame:
    """doc_id, branch, staged, modified, untracked: a file belongs to the last section header above it."""
    along = Window.partitionBy("doc_id").orderBy("i")
    header = F.when(F.col("line").startswith("Changes to be committed"), "staged").when(F.col("line").startswith("Changes not staged"), "modified").when(F.col("line").startswith("Untracked files"), "untracked")
    own = lines.withColumn("section", F.last(header, ignorenulls=True).over(along))
    entry = F.col("line").rlike(r"^(\t|    )\S")
    return own.groupBy("doc_id").agg(
        F.max(F.when(F.col("line").startswith("On branch "), F.substring("line", 11, 200))).alias("branch"),
        *[F.count_if(entry & (F.col("section") == s)).alias(s) for s in ("staged", "modified", "untracked")],
    )


def git_log(lines: DataFrame) -> DataFrame:
    """doc_id, i, entry: `hash7 subject` of each commit; the subject is its first indented line."""
    along = Window.partitionBy("doc_id").orderBy("i")
    own = lines.withColumn("commit", F.sum(F.col("line").rlike("^commit [0-9a-f]{7,40}").cast("long")).over(along)).where("commit > 0")
    rows = own.groupBy("doc_id", "commit").agg(F.min("i").alias("i"), F.min(F.when(F.col("line").startswith("commit "), F.substring("line", 8, 7))).alias("hash"), F.min(F.when(F.col("line").startswith("    "), F.struct("i", "line"))).alias("subject"))
    return rows.select("doc_id", "i", F.concat_ws(" ", "hash", F.trim("subject.line")).alias("entry"))


def git_diff(lines: DataFrame) -> DataFrame:
    """doc_id, files, added, removed. Headers of a file aren't changes: they stand between `diff --git` and the first hunk."""
    along = Window.partitionBy("doc_id").orderBy("i")
    mark = F.when(F.col("line").startswith("diff --git"), "head").when(F.col("line").startswith("@@ "), "hunk")
    own = lines.withColumn("where", F.last(mark, ignorenulls=True).over(along))
    inside = F.col("where") == "hunk"
    return own.groupBy("doc_id").agg(
        F.count_if(F.col("line").startswith("diff --git")).alias("files"), F.count_if(inside & F.col("line").startswith("+")).alias("added"), F.count_if(inside & F.col("line").startswith("-")).alias("removed"),
    )


def eslint(lines: DataFrame) -> DataFrame:
    """doc_id, file, errors, warnings: a finding belongs to the last path above it."""
    along = Window.partitionBy("doc_id").orderBy("i")
    path = F.when(F.col("line").rlike(r"^/\S+$|^\S+\.(js|ts|jsx|tsx)$"), F.col("line"))
    own = lines.withColumn("file", F.last(path, ignorenulls=True).over(along))
    kind = F.regexp_extract("line", r"^\s+\d+:\d+\s+(error|warning)\s", 1)
    return own.withColumn("kind", kind).where("kind <> '' AND file IS NOT NULL").groupBy("doc_id", "file").agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "warning").alias("warnings"))


def grep_files(lines: DataFrame, files: int = 10, each: int = 3) -> DataFrame:
    """doc_id, file, matches, place, shown: the files with most matches and their first lines."""
    own = lines.select("doc_id", "i", "line", F.regexp_extract("line", r"^([^:\s]+):\d+:", 1).alias("file")).where("file <> ''")
    counts = own.groupBy("doc_id", "file").agg(F.count("*").alias("matches"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("matches"), "file")).cast("long")).where(F.col("place") <= files)
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "file").orderBy("i"))).where(F.col("k") <= each)
    return top.join(first, ["doc_id", "file"]).groupBy("doc_id", "file", "matches", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("shown"))


def tsc_files(lines: DataFrame, files: int = 5) -> DataFrame:
    """doc_id, file, errors, place: the files with most errors."""
    own = lines.select("doc_id", F.regexp_extract("line", r"^(?:\S*/)?([^/\s(]+)\(\d+,\d+\): error TS", 1).alias("file")).where("file <> ''")
    counts = own.groupBy("doc_id", "file").agg(F.count("*").alias("errors"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("errors"), "file")).cast("long")).where(F.col("place") <= files)


def find_prefix(lines: DataFrame) -> DataFrame:
    """doc_id, prefix, n_paths: the folder that all paths share; that of the least and greatest path is that of all."""
    own = lines.where("line <> ''").groupBy("doc_id").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count("*").alias("n_paths"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length("low"), F.length("high")), F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(F.col("low"), F.lit(1), k) == F.substring(F.col("high"), F.lit(1), k)), k).otherwise(n))
    return own.select("doc_id", F.regexp_extract(F.substring(F.col("low"), F.lit(1), same), "^(.*/)", 1).alias("prefix"), "n_paths")


#: Structural lines of a source file by kind.
OUTLINE = {
    "import": r"^\s*(use |import |from \S+ import|#include|require\()", "api": r"^\s*(pub |export |def |class |func |public |async def )", "risk": r"(unsafe|TODO|FIXME|unwrap\(\)|eval\()",
}


def outline(lines: DataFrame) -> DataFrame:
    """doc_id, kind, n, first: structural lines of source files."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(OUTLINE.items())):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    return lines.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min_by("line", "i").alias("first"))


def generic(tiered: DataFrame, most: int = 100) -> DataFrame:
    """doc_id, i, line, gap: the lines that matter most, in order, with the number of lines left out before each."""
    rank = F.when(F.col("tier").isin("Critical", "Important"), 0).when(F.col("tier") == "Context", 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "i"))
    kept = tiered.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("place", place).where(F.col("place") <= most)
    return kept.select("doc_id", "i", "line", (F.col("i") - F.coalesce(F.lag("i").over(Window.partitionBy("doc_id").orderBy("i")), F.lit(0)) - 1).alias("gap"))
