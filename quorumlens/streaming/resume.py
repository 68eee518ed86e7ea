"""Resuming an interrupted generation output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_state(expected: DataFrame, done: DataFrame, partition: str, key: str) -> DataFrame:
    """An output partition is complete when its ids are exactly the expected ones without duplicates."""
    want = expected.groupBy(partition, key).agg(F.lit(1).alias("_w"))
    have = done.groupBy(partition, key).agg(F.count(F.lit(1)).alias("_h"))
    j = want.join(have, [partition, key], "full")
    return j.groupBy(partition).agg(
        F.sum(F.coalesce("_w", F.lit(0))).cast("long").alias("expected"), F.sum((F.col("_h").isNotNull() & F.col("_w").isNotNull()).cast("long")).alias("present"),
        F.sum((F.col("_w").isNull()).cast("long")).alias("unexpected"), F.sum(F.coalesce(F.col("_h") - 1, F.lit(0))).alias("duplicates"),
    ).withColumn("complete", (F.col("expected") == F.col("present")) & (F.col("unexpected") == 0) & (F.col("duplicates") == 0))


def pending(expected: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows that have no output yet."""
    return expected.join(done.select(*key), key, "left_anti")


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in `df`, so a rerun is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
