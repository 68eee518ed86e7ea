"""Region transition statistics between turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import ROLE_PAIRS, small_side

# Floor of the entropy weight, density and reliability thresholds.
WEIGHT_FLOOR = 0.05
DENSE_FROM, SPARSE_TO = 0.67, 0.33
NOTICEABLE_MAX, NOTICEABLE_MEAN = 0.05, 0.01


def pair_ends(pairs: DataFrame, space: DataFrame) -> DataFrame:
    """Join both ends of each pair with their item columns (`dist`, plus whatever else `space` carries)."""
    rest = [c for c in space.columns if c != "item"]
    s = space.select(F.col("item").alias("s_item"), *[F.col(c).alias("s_" + c) for c in rest])
    t = space.select(F.col("item").alias("t_item"), *[F.col(c).alias("t_" + c) for c in rest])
    return pairs.select("pair", "s_item", "t_item").join(s, "s_item").join(t, "t_item")


def soft_counts(ends: DataFrame, regions: int, weight: Column | None = None) -> DataFrame:
    """Sum over pairs of p_s(i) * p_t(j), plain and times `weight`.

    The outer product is never written out as rows before a shuffle: each (i, j) cell is one partial sum,
    so a task emits regions^2 numbers per role pair whatever its input size.
    """
    w = F.lit(1.0) if weight is None else weight
    base = ends.withColumn("_w", w)
    # One pass per source region keeps generated code small: the source index is exploded, the targets are sums.
    exploded = base.select("pair", "_w", F.posexplode("s_dist").alias("source", "_ps"), "t_dist")
    cells = [F.sum(F.col("_ps") * F.element_at("t_dist", j + 1)).alias(f"u{j}") for j in range(regions)]
    weighted = [F.sum(F.col("_ps") * F.element_at("t_dist", j + 1) * F.col("_w")).alias(f"w{j}") for j in range(regions)]
    agg = exploded.groupBy("pair", F.col("source").cast("long").alias("source")).agg(*cells, *weighted)
    out = F.explode(
        F.array(
            *[
                F.struct(F.lit(j).cast("long").alias("target"), F.col(f"u{j}").alias("n"), F.col(f"w{j}").alias("wn"))
                for j in range(regions)
            ]
        )
    ).alias("c")
    return agg.select("pair", "source", out).select("pair", "source", "c.target", "c.n", "c.wn")


def reliability_weight() -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.col("s_reliability") * F.col("t_reliability")))


def entropy_weight(regions: int) -> Column:
    top = F.ln(F.lit(float(max(regions, 2))))
    return F.greatest(F.lit(WEIGHT_FLOOR), (1 - F.col("s_entropy") / top) * (1 - F.col("t_entropy") / top))


def grid(df: DataFrame, regions: int, pair_types: list[str] = ROLE_PAIRS) -> DataFrame:
    """Dense (pair, source, target) grid: 4 * regions^2 rows, a size set by parameters."""
    spark = df.sparkSession
    cell = spark.range(regions * regions).select(
        F.floor(F.col("id") / regions).alias("source"), (F.col("id") % regions).alias("target")
    )
    return cell.select(F.explode(F.array(*[F.lit(p) for p in pair_types])).alias("pair"), "source", "target")


def conditionals(
    counts: DataFrame, regions: int, alpha: float = 0.1, value: str = "wn", pair_types: list[str] = ROLE_PAIRS
) -> DataFrame:
    """P(j | i) = (n_ij + alpha) / (n_i + alpha * C) on the dense grid with source and target marginals."""
    # Windows below run over the grid (regions^2 rows per pair), never over items.
    full = grid(counts, regions, pair_types).join(counts.select("pair", "source", "target", F.col(value).alias("n")),
                                      ["pair", "source", "target"], "left").fillna(0.0, ["n"])
    row, col, kind = (Window.partitionBy(*k) for k in (["pair", "source"], ["pair", "target"], ["pair"]))
    n_i, n_j, n_all = (F.sum("n").over(w) for w in (row, col, kind))
    full = full.select("*", n_i.alias("_ni"), n_j.alias("_nj"), n_all.alias("_nn"))
    denom = F.col("_ni") + alpha * regions
    share = lambda c: F.when(F.col("_nn") > 0, F.col(c) / F.col("_nn")).otherwise(0.0)
    return full.select(
        "pair",
        "source",
        "target",
        "n",
        (F.col("n") + alpha).alias("smoothed"),
        share("_ni").alias("source_marginal"),
        share("_nj").alias("target_marginal"),
        F.when(denom > 0, (F.col("n") + alpha) / denom).otherwise(1.0 / regions).alias("cond"),
    )


def association(counts: DataFrame, regions: int, value: str = "wn") -> DataFrame:
    """T4: joint, marginals, PMI (log2, null where the joint is 0), PPMI and lift on the dense grid."""
    base = conditionals(counts, regions, 0.0, value)
    total = F.sum("n").over(Window.partitionBy("pair"))
    joint = base.withColumn("_t", total).withColumn(
        "joint", F.when(F.col("_t") > 0, F.col("n") / F.col("_t")).otherwise(0.0)
    )
    denom = F.col("source_marginal") * F.col("target_marginal")
    ok = (F.col("joint") > 0) & (denom > 0)
    lift = F.when(ok, F.col("joint") / denom).otherwise(0.0)
    scored = joint.withColumn("lift", lift).withColumn("pmi", F.when(ok, F.log2("lift")))
    return scored.select(
        "pair", "source", "target", "n", "joint", "source_marginal", "target_marginal", "pmi",
        F.greatest(F.lit(0.0), F.coalesce("pmi", F.lit(0.0))).alias("ppmi"), "lift",
    )


def instances(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("instances"))


def summary(counts: DataFrame, pairs: DataFrame, regions: int, alpha: float = 0.1) -> DataFrame:
    """T5: instances, total count, nonzero edges, density, and how far the weighting moves the conditionals."""
    w = conditionals(counts, regions, alpha, "wn").select("pair", "source", "target", F.col("n").alias("wn"), F.col("cond").alias("a"))
    u = conditionals(counts, regions, alpha, "n").select("pair", "source", "target", F.col("cond").alias("b"))
    cells = float(regions * regions)
    stats = w.join(u, ["pair", "source", "target"]).groupBy("pair").agg(
        F.sum("wn").alias("total"),
        F.sum((F.col("wn") > 0).cast("long")).alias("nonzero_edges"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_delta"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_delta"),
    )
    out = stats.join(instances(pairs), "pair", "left").fillna(0, ["instances"])
    return out.withColumn("density", F.col("nonzero_edges") / cells)


def source_concentration(cond: DataFrame, regions: int) -> DataFrame:
    """Per source the entropy (nats), normalised entropy, and the most likely target."""
    agg = cond.groupBy("pair", "source").agg(
        (-F.sum(F.when(F.col("cond") > 0, F.col("cond") * F.ln("cond")).otherwise(0.0))).alias("entropy"),
        F.min(F.struct((-F.round("cond", 12)).alias("n"), F.col("target").alias("t"))).alias("_top"),
        F.max("cond").alias("top_p"),
    )
    return agg.select(
        "pair", "source", "entropy", (F.col("entropy") / F.ln(F.lit(float(regions)))).alias("norm_entropy"),
        F.col("_top.t").alias("top_target"), "top_p",
    )


def graph_summary(cond: DataFrame, regions: int) -> DataFrame:
    """Density and concentration of one conditional table per role pair."""
    edges = cond.groupBy("pair").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("nonzero_edges"), F.sum("n").alias("total")
    )
    conc = source_concentration(cond, regions).groupBy("pair").agg(
        F.avg("entropy").alias("mean_entropy"),
        F.avg("norm_entropy").alias("mean_norm_entropy"),
        F.avg("top_p").alias("mean_top_p"),
        F.max("top_p").alias("max_top_p"),
    )
    return edges.join(conc, "pair").withColumn("density", F.col("nonzero_edges") / float(regions * regions))


def strongest(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k strongest cells by `value` (nulls skipped; ties by source, then target)."""
    return rows.filter(F.col(value).isNotNull()).orderBy(F.desc(F.round(value, 9)), "pair", "source", "target").limit(k)


def outgoing_winners(cond: DataFrame) -> DataFrame:
    """The most likely target of every source."""
    w = Window.partitionBy("pair", "source").orderBy(F.desc(F.round("cond", 9)), "target")
    return cond.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def common_targets(cond: DataFrame, k: int) -> DataFrame:
    """The k targets with the largest marginal."""
    per = cond.groupBy("pair", "target").agg(F.max("target_marginal").alias("target_marginal"))
    return per.orderBy(F.desc(F.round("target_marginal", 9)), "pair", "target").limit(k)


def metric_mean(metrics: DataFrame, metric: str, where: dict[str, object]) -> DataFrame:
    """Mean of one stored metric over the rows that match all given values."""
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in where.items()], F.lit(True))
    return metrics.filter(cond).agg(F.avg(metric).alias("mean_value"), F.count(metric).alias("n"))


def stored_matrix_stats(wide: DataFrame, row_key: str, cols: list[str]) -> DataFrame:
    """Density and mean row entropy (nats) of a stored wide matrix."""
    long = wide.unpivot([row_key], cols, "target", "value")
    total = F.sum("value").over(Window.partitionBy(row_key))
    p = F.when(F.col("_t") > 0, F.col("value") / F.col("_t"))
    per = long.withColumn("_t", total).groupBy(row_key).agg(
        (-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0))).alias("h"),
        F.sum((F.col("value") > 0).cast("long")).alias("nz"),
        F.count(F.lit(1)).alias("cells"),
    )
    return per.agg((F.sum("nz") / F.sum("cells")).alias("density"), F.avg("h").alias("mean_row_entropy"))


def graph_prior(sources: DataFrame, cond: DataFrame, regions: int, pair: str = "pair", dist: str = "s_dist") -> DataFrame:
    """prior(j) = sum_i p_s(i) * P(j | i) for the row's role pair (fallback A2B), renormalised.

    The conditional table becomes one small row per role pair (a map to a flat matrix), so the item side is
    neither exploded nor shuffled.
    """
    cells = cond.groupBy("pair").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("source", "target", "cond"))), lambda x: x["cond"]
        ).alias("_m")
    )
    # Bounded: four role pairs, regions^2 numbers each.
    table = cells.agg(F.map_from_entries(F.collect_list(F.struct("pair", "_m"))).alias("_tables"))
    joined = sources.crossJoin(F.broadcast(table))
    flat = F.coalesce(F.try_element_at("_tables", F.col(pair)), F.try_element_at("_tables", F.lit("A2B")))
    withm = joined.withColumn("_flat", flat)
    mass = [
        F.aggregate(
            F.zip_with(dist, F.transform(F.sequence(F.lit(0), F.lit(regions - 1)),
                                         lambda i: F.element_at("_flat", (i * regions + j + 1).cast("int"))),
                       lambda p, c: p * c),
            F.lit(0.0), lambda s, x: s + x)
        for j in range(regions)
    ]
    raw = withm.withColumn("_raw", F.array(*mass))
    total = F.greatest(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x), F.lit(1e-12))
    return raw.withColumn("prior", F.transform("_raw", lambda x: x / total)).drop("_raw", "_flat", "_tables")


def repaired_graph(rows: DataFrame, pair: str, regions: int) -> DataFrame:
    """Rows of one type on the dense grid, each source renormalised; a source without mass is uniform."""
    one = rows.filter(F.col("pair") == pair).select("source", "target", "cond")
    full = grid(rows, regions, [pair]).join(small_side(one), ["source", "target"], "left").fillna(0.0, ["cond"])
    total = F.sum("cond").over(Window.partitionBy("source"))
    fixed = F.when(F.col("_t") > 0, F.col("cond") / F.col("_t")).otherwise(1.0 / regions)
    return full.withColumn("_t", total).select("pair", "source", "target", fixed.alias("cond"))


def qualitative(summary_rows: DataFrame) -> DataFrame:
    """Density word and whether the reliability weighting has a noticeable effect."""
    density = (
        F.when(F.col("density") >= DENSE_FROM, "dense").when(F.col("density") <= SPARSE_TO, "sparse")
        .otherwise("moderately dense")
    )
    effect = F.when(
        (F.col("max_delta") >= NOTICEABLE_MAX) | (F.col("mean_delta") >= NOTICEABLE_MEAN), "noticeable"
    ).otherwise("small")
    return summary_rows.select("pair", density.alias("density_word"), effect.alias("reliability_effect"))
