"""Ranks, neighbours and order statistics that never gather a whole group in one task.

A key may hold a third of all rows, so a plain `Window.partitionBy(key)` is unsafe for anything whose
group size grows with the data.  The helpers here cut a group into blocks along its sort order, count the
blocks (a small aggregate), and combine block offsets with ranks inside a block.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import hash60
from .lineage import checkpointed

# Rows per block for dense integer positions.
BLOCK = 4096


def _order_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, out: str = "pos"
) -> DataFrame:
    """Exact 0-based rank inside `keys` under `order`.

    `block` must be non-decreasing along `order`; it decides how a hot key is split.  Keys must not be null.
    """
    keys = list(keys)
    staged = df.withColumn("_blk", block)
    offsets = (
        staged.groupBy(*keys, "_blk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    local = Window.partitionBy(*keys, "_blk").orderBy(*[_order_col(c) for c in order])
    return (
        staged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_before") + F.col("_local") - 1).cast("long"))
        .drop("_blk", "_local", "_before")
    )


def range_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "pos", total: str | None = None) -> DataFrame:
    """Exact 0-based rank inside `keys` under `order`, and the size of the group as `total`, whatever the values are.

    Rows are range-partitioned over keys and order together, so the borders are drawn by Spark's sample of the whole sort
    key: a key, or one value of the order, that a large part of the rows share is cut by the columns after it.  Ranks are offsets
    of (key, partition) plus the place in the partition.  The order should end in an id; rows alike in all of it stay together
    and tie arbitrarily.  Null keys are a group.  The sorted rows are checkpointed, so the ranks survive a lost executor.
    """
    keys = list(keys)
    sort = [*[F.col(k) for k in keys], *[_order_col(c) for c in order]]
    placed = checkpointed(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the upper bits of the id are the partition
    pieces = placed.groupBy(*keys, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys)  # a row for each key and partition
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(group).alias("_total"))
    same = F.col("_p") == part
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = placed.join(pieces, same).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.select(*df.columns, out, *([total] if total else []))


def hash_positions(
    df: DataFrame, keys: Sequence[str], seed: object, ids: Sequence[str], out: str = "pos"
) -> DataFrame:
    """0-based rank inside `keys` in a seeded pseudo-random order; independent of partitioning."""
    staged = df.withColumn("_h", hash60(F.lit(str(seed)), *[F.col(c) for c in ids]))
    # 60-bit hash, so the top 12 bits give 4096 even blocks per key.
    ranked = positions(staged, keys, ["_h", *ids], F.shiftright("_h", 48), out)
    return ranked.drop("_h")


def ahead(
    df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str], lags: Sequence[int] = (1,), width: int = BLOCK
) -> DataFrame:
    """Attach `next{k}`, the struct of `cols` found `k` dense positions later, for each lag.

    Rows at the start of a block are also sent to the block before it, so one window over
    (keys, block) sees every successor it needs.
    """
    keys, reach = list(keys), max(lags)
    own = F.floor(F.col(pos) / width)
    spread = F.when((F.col(pos) >= width) & (F.col(pos) % width < reach), F.array(own, own - 1)).otherwise(
        F.array(own)
    )
    halo = df.withColumn("_blk", F.explode(spread))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    picked = halo.select(
        "*", *[F.lead(F.struct(*cols), k).over(w).alias(f"next{k}") for k in lags]
    )
    return picked.filter(F.col("_blk") == own).drop("_blk")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], width: float, method: str = "linear"
) -> DataFrame:
    """Exact percentiles per key, one row per (keys, prob) with column `q`.

    Equal values are merged first, then blocks of `width` are counted to find the block that holds each
    requested rank; only those blocks are ordered.  `method` is "linear" (interpolated) or "floor"
    (value at floor(prob * n), clamped to the last row).
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_blk", F.floor(F.col("_v") / F.lit(float(width))))
    )
    per_block = counted.groupBy(*keys, "_blk").agg(F.sum("_n").alias("_bn"))
    by_key = Window.partitionBy(*keys)
    cum = by_key.orderBy("_blk")
    blocks = per_block.select(
        *keys,
        "_blk",
        F.sum("_bn").over(by_key).alias("_total"),
        (F.sum("_bn").over(cum) - F.col("_bn")).alias("_start"),
        "_bn",
    )
    prob = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    if method == "linear":
        target = (F.col("_total") - 1) * F.col("prob")
        low, high = F.floor(target), F.ceil(target)
    else:
        target = F.least(F.floor(F.col("_total") * F.col("prob")), F.col("_total") - 1)
        low = high = target
    wanted = (
        blocks.select("*", prob)
        .withColumn("_t", target.cast("double"))
        .withColumn("_at", F.explode(F.array_distinct(F.array(low.cast("long"), high.cast("long")))))
        .filter((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_bn")))
        .select(*keys, "_blk", "_start", "prob", "_t", "_at")
    )
    local = Window.partitionBy(*keys, "_blk").orderBy("_v")
    inside = counted.withColumn("_hi", F.sum("_n").over(local)).withColumn("_lo", F.col("_hi") - F.col("_n"))
    hit = inside.join(wanted, [*keys, "_blk"]).filter(
        (F.col("_at") - F.col("_start") >= F.col("_lo")) & (F.col("_at") - F.col("_start") < F.col("_hi"))
    )
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("_t") - F.col("_at")))
    return hit.groupBy(*keys, "prob").agg(F.sum(F.col("_v") * weight).alias("q"))


def median_of(df: DataFrame, keys: Sequence[str], value: str, width: float, out: str = "median") -> DataFrame:
    """Exact interpolated median per key."""
    return order_statistics(df, keys, value, [0.5], width).select(*keys, F.col("q").alias(out))
