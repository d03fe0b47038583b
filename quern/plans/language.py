"""The query language: four forms, keywords in any case, to a DataFrame."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import lines, savings_pct
from quern.operators import lines as L
from quern.operators.memory import command_of_hash


class Query(NamedTuple):
    form: str
    value: str = ""


_FORMS = (("errors", r"errors in last (\d+)\b.*"), ("warnings", r"warnings from (\S.*)"), ("context", r"context for (\S.*)"), ("timeline", r"timeline today()"))


def parse(said: str) -> Query | None:
    """None if it is none of the forms. A file keeps its case, a tool does not."""
    for form, pattern in _FORMS:
        if m := re.fullmatch(pattern, said.strip(), re.IGNORECASE):
            value = m[1].strip()
            return Query(form, value.lower() if form == "warnings" else value)
    return None


#: How many archived calls a question about a tool, and how many texts one about a file, looks at.
TOOL_CALLS, FILE_TEXTS = 50, 20


def _lines_of(calls: DataFrame, archive: DataFrame, tier: str) -> DataFrame:
    """The lines of a tier in the archived outputs of some calls."""
    own = calls.join(archive.select(F.col("hash").alias("rewind_hash"), "content"), "rewind_hash")
    lines = L.explode_lines(own, "id", "content").withColumnRenamed("doc_id", "id")
    tiered = L.boosted(L.classified(lines.withColumnRenamed("id", "doc_id"))).where(F.col("tier") == tier)
    return tiered.join(calls.select(F.col("id").alias("doc_id"), "ts", "command"), "doc_id").select(F.col("doc_id").alias("id"), "ts", "command", "i", "line")


def _newest(calls: DataFrame, most: int) -> DataFrame:
    return calls.where("rewind_hash <> ''").orderBy(F.desc("ts"), F.desc("id")).limit(most)


def planned(query: Query, history: DataFrame, archive: DataFrame, now: int | None = None) -> DataFrame:
    """The answer from the history of calls and the archive (hash, ts, content); `now` is by default the newest call's time.

    errors, warnings: id, ts, command, i, line. context: hash, ts, command, matches, lines.
    timeline: id, ts, command, route, saved_pct (null where the command failed).
    """
    if query.form == "errors":
        return _lines_of(_newest(history, int(query.value)), archive, "Critical")
    if query.form == "warnings":
        asked = F.lower("command").startswith(query.value) | F.lower("filter_name").startswith(query.value)
        return _lines_of(_newest(history.where(asked), TOOL_CALLS), archive, "Important")
    if query.form == "context":
        texts = archive.where(F.lower("content").contains(query.value.lower())).orderBy(F.desc("ts"), "hash").limit(FILE_TEXTS)
        found = texts.withColumn("own", F.filter(lines(F.col("content")), lambda x: x.contains(query.value))).where(F.size("own") > 0)
        named = found.join(command_of_hash(history).withColumnRenamed("rewind_hash", "hash"), "hash", "left")
        return named.select("hash", "ts", F.coalesce("command", F.lit("unknown")).alias("command"), F.size("own").cast("long").alias("matches"), F.array_join("own", "\n").alias("lines"))
    until = history.agg((F.max("ts") if now is None else F.lit(now)).cast("long").alias("now"))
    today = history.crossJoin(F.broadcast(until)).where(F.col("ts") >= F.col("now") - F.col("now") % 86400).drop("now")  # until is one row
    pct = savings_pct(F.col("input_bytes"), F.col("output_bytes"))
    return today.select("id", "ts", "command", "route", F.when(F.col("route") != "Error", F.round(pct, 6)).alias("saved_pct")).orderBy("ts", "id")
