"""Dense ids for labels of any type: a sorted dictionary that no task or driver holds whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import range_positions


def dictionary(*tables: tuple[DataFrame, str]) -> DataFrame:
    """(label, id): the distinct labels of the given (table, column) pairs and their ranks from 0 in the order of the type.

    Null labels are left out.  Ranks come from a range sort, so they need no table on the driver; the mapping is checkpointed.
    """
    every = None
    for df, column in tables:
        part = df.select(F.col(column).alias("label")).filter("label IS NOT NULL")
        every = part if every is None else every.unionByName(part)
    return range_positions(every.distinct(), [], ["label"], "id")


def encoded(df: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with ids in place of the labels in `columns`; rows with a label that is null or unknown go."""
    out = df
    for c in columns:
        out = out.join(ids.select(F.col("label").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*df.columns)


def decoded(df: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with labels in place of the ids in `columns`."""
    out = df
    for c in columns:
        out = out.join(ids.select(F.col("id").alias(c), F.col("label").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*df.columns)
