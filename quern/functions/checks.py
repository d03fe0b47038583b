"""Small checks as columns: what a command does, whether a loop's settings are sound, versions and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import contains_any

#: What commands that change something, and commands that read files, contain in small letters.
CHANGES = (
    "rm ", "delete ", "mv ", "cp ", "git checkout", "git reset", "git add", "cargo build", "cargo install", "cargo clean", "npm install", "npm run build", "rm -rf", "docker build", "docker run",
    "kubectl apply", "kubectl delete", "write ", "edit ", "replace ", "touch ", "mkdir ",
)
READS = ("cat ", "less ", "head ", "tail ", "grep ")
#: Variables that are never handed on, in any case.
DENIED = (
    "BASH_ENV", "ENV", "ZDOTDIR", "BASH_PROFILE", "NODE_OPTIONS", "NODE_EXTRA_CA_CERTS", "PYTHONSTARTUP", "PYTHONPATH", "PYTHONHOME", "RUBYOPT", "RUBYLIB", "LD_PRELOAD", "LD_LIBRARY_PATH", "LD_AUDIT",
    "DYLD_INSERT_LIBRARIES", "DYLD_FORCE_FLAT_NAMESPACE", "GIT_EXEC_PATH", "GIT_ASKPASS", "GIT_TEMPLATE_DIR", "JAVA_TOOL_OPTIONS", "_JAVA_OPTIONS", "IFS", "CDPATH", "PROMPT_COMMAND", "SSH_ASKPASS",
    "SSH_AUTH_SOCK", "GIT_SSH_COMMAND", "GIT_SSH", "SVN_SSH", "CVS_RSH", "PERL5LIB", "PERL5OPT", "PERLLIB", "AWKPATH", "AWKLIBPATH", "XAUTHORITY", "DISPLAY", "WAYLAND_DISPLAY", "LOCPATH", "NLSPATH",
    "GCONV_PATH", "GIT_EXTERNAL_DIFF", "GIT_MERGE_AUTOEDIT", "PAGER", "EDITOR", "VISUAL", "MANPAGER", "MANPATH", "HOSTALIASES",
)
#: Bounds of a loop's id, goal and budget.
LOOP_ID, LOOP_GOAL, LOOP_BUDGET = 64, 500, 10_000_000
NEAR_FLAG = 2


def is_mutating(command: Column) -> Column:
    return contains_any(F.lower(command), CHANGES)


def is_reading(command: Column) -> Column:
    return contains_any(F.lower(command), READS)


def target_file(command: Column) -> Column:
    """The file that a reading command names, or null: after `cat`, `head` or `tail`; at the end of a search."""
    words = F.filter(F.split(command, r"\s+"), lambda x: x != "")
    first, last = F.get(words, F.lit(0)), F.element_at(words, -1)
    return F.when(first.isin("cat", "head", "tail"), F.get(words, F.lit(1))).when(first.isin("grep", "rg") & ~last.startswith("-"), last)


def loop_error(loop_id: Column, goal: Column, budget: Column) -> Column:
    """What is wrong with a loop's settings first, or null; nulls are not set."""
    return (
        F.when(~loop_id.rlike(r"^[\p{L}\p{N}-]*$") | (F.octet_length(loop_id) > LOOP_ID), "InvalidLoopId").when(F.octet_length(goal) > LOOP_GOAL, "GoalTooLong")
        .when(goal.rlike(r"[`$;|&><()]"), "GoalContainsShellMetachars").when(budget > LOOP_BUDGET, "BudgetTooLarge")
    )


def allowed_variables(variables: DataFrame, name: str = "name") -> DataFrame:
    """variables without those that must not be handed on."""
    return variables.where(~F.upper(name).isin(*DENIED))


def is_newer(latest: Column, current: Column) -> Column:
    """Whether one version comes after another; with equal numbers, one with a suffix comes before its release."""

    def numbers(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda part: F.coalesce(F.expr("bigint(0)") + F.regexp_extract(part, r"^(\d+)(?:-|$)", 1).try_cast("bigint"), F.lit(0).cast("bigint")))

    def suffix(v: Column) -> Column:
        return F.coalesce(F.get(F.split(v, "-"), F.lit(1)), F.lit(""))

    a, b, p, q = numbers(latest), numbers(current), suffix(latest), suffix(current)
    both = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both)
    after = F.when(F.size(a) != F.size(b), F.size(a) > F.size(b)).when((p == "") | (q == ""), (p == "") & (q != "")).otherwise(p > q)
    return F.when(x == y, after).otherwise(x > y)


def nearest_flag(said: DataFrame, flags: list[str]) -> DataFrame:
    """said (flag) with `nearest`: the first of the long flags that two edits at most make of it, or null."""
    far = F.array(*[F.struct(F.levenshtein(F.col("flag"), F.lit(f)).alias("far"), F.lit(k).alias("k"), F.lit(f).alias("name")) for k, f in enumerate(flags) if f.startswith("--")])
    best = F.array_min(F.filter(far, lambda x: x["far"] <= NEAR_FLAG))
    return said.withColumn("nearest", best["name"])
