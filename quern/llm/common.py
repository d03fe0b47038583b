"""What the training-data operators share: table access, the shared folder, folds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that split words, as a Java regular expression.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local one is made, but only if driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder is not None:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = f"{tempfile.gettempdir()}/quern-shared-{os.getpid()}"
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables that settle() wrote for this application; results that read them must be written by then."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@functools.cache
def _cleared_at_exit(application: str) -> None:
    """A driver that ends in order leaves no tables: what could read them ends with it."""

    def run() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone by now
                clear(spark)

    atexit.register(run)


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back.

    The table can be read again after an executor is lost, and readers of it see the
    same rows however often a task is retried. clear() deletes it, at the latest when the
    driver ends.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    _cleared_at_exit(application)
    path = f"{shared_dir(spark)}/quern-{application}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: rows with 0 are held out from every training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """A row without an id is in no fold: it is neither held out nor learnt from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def content_key(col: Column) -> Column:
    """16 bytes that stand for a text: the first half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(col, F.lit("")), 256), 1, 32))


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


#: What empties the memories that a Python worker keeps between tasks.
MEMORIES: list = []


def forget() -> None:
    """Empties what other operators remember in this Python worker; called where a stage of its own begins."""
    for empty in MEMORIES:
        empty()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers are used again and share a host's memory."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows that go to Python at once; Spark bounds their bytes beside.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches kept small: texts are wide, and each batch is held a few times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, rows: int = 256):
    """Short pieces of a batch, so that Python holds few texts at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
