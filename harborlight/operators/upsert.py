"""Keyed writes as snapshots: merge, insert-ignore, retention with archive, versions on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the new ones over the old, one for each key."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("r")).select(*keys, "r.*").select(old.columns)


def fill_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with their nulls filled from new rows of the same key, and new rows of new keys."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.select(*keys, F.struct(*rest).alias("o")).join(new.select(*keys, F.struct(*rest).alias("n")), keys, "full")
    return joined.select(*keys, *(F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in rest)).select(old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(new.columns)


def split_expired(rows: DataFrame, time: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows older than the cutoff, and the others; rows without a time stay."""
    old = F.coalesce(F.col(time) < cutoff, F.lit(False))
    return rows.where(old), rows.where(~old)


def archive(rows: DataFrame, path: str, time: str) -> None:
    """Append rows as JSON lines below a folder for each day."""
    rows.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").json(path)


def write_snapshot(rows: DataFrame, path: str, version: int) -> None:
    """Write a whole version beside the others, so that readers and the job's own input stay whole."""
    rows.write.mode("overwrite").parquet(f"{path}/version={version:010d}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version: one with Spark's success mark."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
    return spark.read.parquet(max(f.getPath().getParent().toString() for f in files))
