"""Where rows go: append-only facts, upserts as views over them, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Adds rows to a fact, one folder a day."""
    rows.withColumn("dt", F.to_date(F.timestamp_seconds(ts))).write.mode("append").partitionBy("dt").parquet(path)


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An upsert that replaces: the newest row of each key. Partial sums, no sorted groups."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*keys, *[F.col("row").getField(c).alias(c) for c in rest])


def counted_by_key(log: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """An upsert that counts: times seen, first and last time, newest value."""
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max_by(value, F.struct(ts, value)).alias(value))


def first_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """An insert that leaves what is there."""
    rest = [c for c in log.columns if c not in keys]
    oldest = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return oldest.select(*keys, *[F.col("row").getField(c).alias(c) for c in rest])


def live(memory: DataFrame, now: int, default_days: int = 30) -> DataFrame:
    """Rows whose own time to live, in days, is not over."""
    return memory.where(F.col("last_seen") >= now - F.coalesce("ttl_days", F.lit(default_days)) * 86400)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def as_json(row: Column) -> Column:
    return F.to_json(row)


def newest(rows: DataFrame, keys: list[str], order: Column, most: int) -> DataFrame:
    """A bounded list of each key, newest first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("place", place).where(F.col("place") <= most)
