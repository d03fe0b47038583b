"""Readers of payloads, transcripts and source trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import constants as K

#: Largest payload that is read, and files of a source tree that are.
MAX_PAYLOAD = 16 * 1024 * 1024
MAX_SOURCE = 512 * 1024
#: Extensions of a source tree, and folders that are passed over.
EXTENSIONS = ("rs", "py", "js", "ts", "jsx", "tsx", "go")
SKIPPED = ("node_modules", "target", ".git", "dist", "build", "vendor", "__pycache__", ".venv")

TRANSCRIPT = "session_id string, updated_at long, entries array<struct<id:string,ts:long,kind:string,payload:string,status:string,result:string,command:string>>"


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, valid: whole files up to MAX_PAYLOAD; bytes that aren't UTF-8 have a null text."""
    files = spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= MAX_PAYLOAD))
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).withColumn("valid", F.col("text").isNotNull())


def transcripts(spark: SparkSession, path: str, most: int, now: int, days: int = K.TRACE_DAYS) -> DataFrame:
    """Entries of the newest transcripts (by file time) that are not too old, one row each, in order."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("changed", F.col("_metadata.file_modification_time"))
    newest = files.where(F.col("updated_at") >= now - days * 86400).orderBy(F.desc("changed"), "session_id").limit(most)
    return newest.select("session_id", "changed", F.posexplode("entries").alias("pos", "entry")).select("session_id", "changed", "pos", "entry.*")


def pending_session(entries: DataFrame) -> DataFrame:
    """The newest session with entries that wait."""
    return entries.where("status = 'pending'").groupBy("session_id").agg(F.max("changed").alias("changed"), F.count("*").alias("pending")).orderBy(F.desc("changed"), "session_id").limit(1)


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), text of the source files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    below = F.regexp_replace("path", "^(file:)?/*" + root.strip("/").replace(".", r"\.") + "/*", "")
    skipped = F.lit(False)
    for name in SKIPPED:
        skipped = skipped | F.concat(F.lit("/"), F.col("path")).contains(f"/{name}/")
    return files.where(F.col("length") <= MAX_SOURCE).select(below.alias("path"), F.col("content").cast("string").alias("text")).where(~skipped)


def traces(rows: DataFrame, since: int) -> DataFrame:
    """Traces that a reader's tool made, in order: what a replay runs over."""
    return rows.where((F.col("ts") >= since) & F.col("agent_id").isNotNull() & (F.col("agent_id") != "terminal")).orderBy("ts", "id")


def capped(stdout: Column, agent: Column) -> Column:
    """Whether a host has already cut this output."""
    return (agent == "claude_code") & (F.octet_length(stdout) >= 30_000)
