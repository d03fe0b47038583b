"""Queries of shell commands and long texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import shell
from quern.plans.catalog import query
from quern.sources.views import table

_NAMES = ("HOME", "API_TOKEN", "MY_SECRET", "SORT_KEY", "PASS", "DB_PASSWORD", "LANG", "MONKEY", "AWS_REGION", "CLIENT_SECRET_ID")
#: Fixed expectations: which of the names are redacted for the value v-<number>.
_REDACTED = (False, True, True, False, True, True, False, False, True, True)


def _line_sql() -> str:
    names, flags = ", ".join(f"'{n}'" for n in _NAMES), ", ".join(str(f).lower() for f in _REDACTED)
    return f"SELECT event_id, CASE WHEN [{flags}][event_id % {len(_NAMES)} + 1] THEN [{names}][event_id % {len(_NAMES)} + 1] || '={shell.MASK}' ELSE [{names}][event_id % {len(_NAMES)} + 1] || '=v-' || event_id END AS line FROM events"


@query(_line_sql())
def redact_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % len(_NAMES)).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", shell.redact_line(F.concat(name, F.lit("=v-"), F.col("event_id").cast("string"))).alias("line"))


@query("""SELECT event_id, ['make ' || event_type, 'grep ' || event_type, 'a ' || event_type || ' "x; y"', NULL][event_id % 4 + 1] AS producer, [3, 2, 1, 2][event_id % 4 + 1]::INTEGER AS n_commands FROM events""")
def sole_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    made = F.array(F.concat(F.lit("cd /x && A=1 make "), kind, F.lit("; true")), F.concat(F.lit("cd /y\nls | grep "), kind), F.concat(F.lit("a "), kind, F.lit(' "x; y"')), F.concat(F.lit("ls; cat "), kind))
    command = F.element_at(made, (F.col("event_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", shell.sole_output_command(command).alias("producer"), F.size(shell.split_sequential(command)).alias("n_commands"))


@query()
def head_tail_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts at bytes and line breaks; tested against its rules."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(shell.head_tail(2000)(F.col("text"))).alias("n_bytes"))
