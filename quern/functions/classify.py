"""What a line says: failure, diagnosis, progress, noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions.text import contains_any, starts_any, trim_u

#: A whole word fail or failed without a bare 0 on either side. \s and word characters are Unicode ones.
VERDICT = r"(?U)(?<![\p{L}\p{N}_])(?<!(?<![0-9])0\s{0,40})fail(?:ed)?(?![\p{L}\p{N}_])(?!\s*0(?![0-9]))"
#: A tally of tests, and a path with a line number.
TALLY = r"(?U)^\s*\d+\s+(pass|passed|fail|failed|skip|skipped|todo)\b"
PATH_WITH_LINE = r"(?U)[\w./\-]+\.\w+:\d+(:\d+)?"


def line_tier(line: Column) -> Column:
    """The case-sensitive tier of one line."""
    c = trim_u(line)
    return (
        F.when(contains_any(c, K.CRITICAL_MARKS), "Critical")
        .when(contains_any(c, K.NOISE_MARKS) | starts_any(c, K.NOISE_STARTS), "Noise")
        .when(contains_any(c, K.IMPORTANT_MARKS) | (c == "ok"), "Important")
        .otherwise("Context")
    )


def carries_failure(line: Column, tool: str | None = None) -> Column:
    """Whether one line states a failure."""
    low = F.lower(line)
    head = F.regexp_replace(low, r"(?U)^\s+", "")
    own = contains_any(low, K.TOOL_CRITICAL[tool]) if tool in K.TOOL_CRITICAL else F.lit(False)
    return own | head.rlike(f"^[{K.FAIL_GLYPHS}]") | contains_any(low, K.FAILURE_MARKS) | low.startswith("error ") | (low.contains("fail") & ~head.rlike(f"^[{K.PASS_GLYPHS}]") & low.rlike(VERDICT))


def is_progress(line: Column) -> Column:
    """A build step, a bar of # or =, or a percentage beside a divider."""
    bars = F.length(F.regexp_replace(line, "[^#=]", ""))
    percent = F.regexp_extract(line, "^([^%]*)%", 1)
    return starts_any(F.lower(line), K.PROGRESS_STARTS) | ((bars > 10) & (bars > F.floor(F.octet_length(line) / 4))) | ((line.contains("% |") | line.contains(" | ")) & line.contains("%") & percent.rlike("[0-9]$"))


def is_decorative(line: Column) -> Column:
    return trim_u(line).rlike(r"^[-=*_]*$")


def is_diagnostic(line: Column, tool: str | None = None) -> Column:
    low = F.lower(line)
    own = contains_any(low, K.TOOL_DIAGNOSTIC[tool]) if tool in K.TOOL_DIAGNOSTIC else F.lit(False)
    return own | contains_any(low, K.DIAGNOSTIC_MARKS) | (low.startswith("ran ") & low.contains(" test")) | low.rlike(TALLY) | low.startswith("warning[") | (low == "ok")


def is_context(line: Column) -> Column:
    return line.rlike(PATH_WITH_LINE) | (trim_u(line).startswith("at ") & line.contains("(") & line.contains(")")) | line.startswith("    ") | line.startswith("\t")


def is_data(line: Column) -> Column:
    c = trim_u(line)
    return (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))


def block_class(line: Column, tool: str | None = None) -> Column:
    """(class, score) of a block of one line; the first that fits."""
    pair = lambda name, score: F.struct(F.lit(name).alias("class"), F.lit(score).alias("score"))
    return (
        F.when(is_progress(line), pair("Progress", 0.9)).when(is_decorative(line), pair("Noise", 0.9)).when(carries_failure(line, tool), pair("Critical", 0.9))
        .when(is_diagnostic(line, tool), pair("Diagnostic", 0.8)).when(is_context(line), pair("Context", 0.7)).when(is_data(line), pair("Data", 0.8)).otherwise(pair("Context", 0.4))
    )


def tier_of(block: Column) -> Column:
    return F.when(block == "Critical", "Critical").when(block == "Diagnostic", "Important").when(block.isin("Context", "Data"), "Context").otherwise("Noise")
