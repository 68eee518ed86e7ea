"""Linear operators between region-conditioned vectors, and prototypes.

All fits start from `functions.moments`: one pass over the pairs gives sums whose size depends on the vector
dimension only; the small systems are solved per (pair type, source, target) group.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import ranking
from ..functions.keys import small_side
from ..functions.lineage import checkpointed
from ..functions.moments import TILE, add_tiles, assembler, pair_moments

# Ridge strength, multiplier under low support, support limits, output temperature and list length.
RIDGE, STRONG, MIN_EFFECTIVE, MIN_SOFT = 1.0, 10.0, 30.0, 5.0
TAU_OUT, TOP_K = 0.15, 5
AFFINE_RIDGE = 1e-2

FIT_SCHEMA = (
    "pair string, source long, target long, status string, backoff string, n long, soft_support double, "
    "effective_support double, ridge double, a array<double>, b array<double>, mse double, weighted_mse double"
)


def conditioned_lists(conditioned: DataFrame) -> DataFrame:
    """item -> array of (region, p, vector): at most one entry per region."""
    return conditioned.groupBy("item").agg(
        F.collect_list(F.struct(F.col("region"), F.col("r").alias("p"), "vector")).alias("vecs")
    )


def sample_pairs(pairs: DataFrame, lists: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """Pairs with the vector lists of both ends; weight is sqrt(rel_s * rel_t), or 1 without `weight`."""
    s = lists.select(F.col("item").alias("s_item"), F.col("vecs").alias("s_vecs"))
    t = lists.select(F.col("item").alias("t_item"), F.col("vecs").alias("t_vecs"))
    out = pairs.select("pair", "s_item", "t_item").join(s, "s_item").join(t, "t_item")
    if weight is None:
        return out.withColumn("w", F.lit(1.0))
    ws = weight.select(F.col("item").alias("s_item"), F.col("reliability").alias("_rs"))
    wt = weight.select(F.col("item").alias("t_item"), F.col("reliability").alias("_rt"))
    rel = F.sqrt(F.greatest(F.lit(0.0), F.col("_rs") * F.col("_rt")))
    return out.join(ws, "s_item").join(wt, "t_item").withColumn("w", rel).drop("_rs", "_rt")


def _solver(dim: int):
    """Nested helpers, shipped to executors by value."""

    def solve(moments, ridge: float):
        m = np.asarray(moments, dtype=float).reshape(2 * dim + 1, 2 * dim + 1)
        k = dim + 1
        reg = np.eye(k) * ridge
        reg[-1, -1] = 0.0
        return np.linalg.solve(m[:k, :k] + reg, m[:k, k:])

    def squared(moments, coef) -> float:
        """Sum of w * |y - x A - b|^2 from the moments alone."""
        m = np.asarray(moments, dtype=float).reshape(2 * dim + 1, 2 * dim + 1)
        k = dim + 1
        full = np.vstack([-coef, np.eye(dim)])
        return float(max(np.trace(full.T @ m @ full), 0.0)) if k else 0.0

    return solve, squared


def shared_operators(moments: DataFrame, dim: int, ridge: float = RIDGE) -> DataFrame:
    """R2: one operator per pair type, from the moments summed over all source and target regions."""
    total = add_tiles(moments, ["pair"])
    solve, squared = _solver(dim)
    assembled = assembler(2 * dim + 1)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (n, sw, sw2), mw, mu = assembled(pdf)
        coef = solve(mw, ridge)
        return pd.DataFrame([{
            "pair": key[0], "a": coef[:-1].ravel().tolist(), "b": coef[-1].tolist(), "n": int(n), "soft_support": sw,
            "effective_support": sw * sw / sw2 if sw2 > 0 else 0.0,
            "mse": squared(mu, coef) / n, "weighted_mse": squared(mw, coef) / sw if sw > 0 else 0.0,
        }])

    schema = ("pair string, a array<double>, b array<double>, n long, soft_support double, effective_support double, "
              "mse double, weighted_mse double")
    return total.groupBy("pair").applyInPandas(fit, schema)


def target_centroids(moments: DataFrame, dim: int) -> DataFrame:
    """Weighted mean of the target vectors per (pair type, target region); only the tiles beside the row of ones are read."""
    at = dim // TILE
    some = add_tiles(moments.filter((F.col("i") == at) | (F.col("j") == at) | (F.col("i") + F.col("j") == 0)), ["pair", "target"])
    assembled = assembler(2 * dim + 1)

    def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (_, sw, _), mw, _ = assembled(pdf)
        return pd.DataFrame([{"pair": key[0], "target": key[1], "centroid": (mw[dim, dim + 1:] / sw).tolist()}])

    return some.groupBy("pair", "target").applyInPandas(mean, "pair string, target long, centroid array<double>")


def fit_operators(
    moments: DataFrame, dim: int, ridge: float = RIDGE, strong: float = STRONG,
    min_effective: float = MIN_EFFECTIVE, min_soft: float = MIN_SOFT, grid: DataFrame | None = None,
) -> DataFrame:
    """R1 + R4: weighted ridge per (pair, source, target) with support gating and back-off.

    Soft support below `min_soft` or fewer than two samples falls back to the shared operator of the type (or
    the target centroid when there is none); effective support below `min_effective` raises the ridge.
    `grid` lists the cells (pair, source, target) to fit, with or without samples; without it only those that have samples.
    """
    solve, squared = _solver(dim)
    assembled = assembler(2 * dim + 1)
    moments = checkpointed(moments)  # parameter-sized, read three times
    shared = shared_operators(moments, dim, ridge).select(
        "pair", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("n").alias("sn")
    )
    cells = moments.select("pair", "source", "target").distinct() if grid is None else grid.select("pair", "source", "target").distinct()
    # What a cell falls back to is one row of its own, so that it does not travel with every tile.
    rest = cells.join(shared, "pair", "left").join(target_centroids(moments, dim), ["pair", "target"], "left")
    key = ["pair", "source", "target"]
    rest = rest.select(*[F.col(k).alias(f"_{k}") for k in key], "sa", "sb", "sn", "centroid")

    def fit(key: tuple, tiles: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(other):
            return pd.DataFrame(columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])
        r = other.iloc[0]
        (n, sw, sw2), mw, mu = assembled(tiles)
        eff = sw * sw / sw2 if sw2 > 0 else 0.0
        lam, status, backoff = ridge, "learned", "none"
        if sw < min_soft or n < 2:
            status = "low_support"
            if r["sa"] is not None and r["sn"] > 0:
                coef = np.vstack([np.reshape(r["sa"], (dim, dim)), np.reshape(r["sb"], (1, dim))])
                backoff = "shared_operator"
            else:
                coef = np.vstack([np.zeros((dim, dim)), np.zeros((1, dim)) if r["centroid"] is None else np.reshape(r["centroid"], (1, dim))])
                backoff = "target_centroid"
        else:
            if eff < min_effective:
                lam, status = ridge * strong * min_effective / max(eff, 1e-12), "learned_strong_ridge"
            coef = solve(mw, lam)
        return pd.DataFrame([{
            "pair": key[0], "source": key[1], "target": key[2], "status": status, "backoff": backoff,
            "n": int(n), "soft_support": sw, "effective_support": eff, "ridge": lam,
            "a": coef[:-1].ravel().tolist(), "b": coef[-1].tolist(),
            "mse": squared(mu, coef) / n if n else 0.0, "weighted_mse": squared(mw, coef) / sw if sw > 0 else 0.0,
        }])

    return moments.groupBy(*key).cogroup(rest.groupBy(*[f"_{k}" for k in key])).applyInPandas(fit, FIT_SCHEMA)


def applied(x: Column, a: Column, b: Column, dim: int) -> Column:
    """x A + b for a row-major (dim x dim) array column `a`."""
    parts = [
        F.aggregate(
            F.zip_with(x, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.element_at(a, (i * dim + j + 1).cast("int"))),
                       lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        + F.element_at(b, j + 1)
        for j in range(dim)
    ]
    return F.array(*parts)


def score_operators(samples: DataFrame, fits: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """Mean and weighted squared error of operators on samples (keys, x, y, w)."""
    table = small_side(fits.select(*keys, "a", "b"))
    joined = samples.join(table, list(keys))
    err = D.vsum(F.zip_with(applied(F.col("x"), F.col("a"), F.col("b"), dim), F.col("y"), lambda p, q: (p - q) * (p - q)))
    e = joined.withColumn("_e", err)
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_e").alias("mse"),
        F.when(F.sum("w") > 0, F.sum(F.col("w") * F.col("_e")) / F.sum("w")).otherwise(0.0).alias("weighted_mse"),
    )


def output_distribution(queries: DataFrame, local: DataFrame, ids: Sequence[str], dim: int, tau: float = TAU_OUT, k: int = TOP_K) -> DataFrame:
    """The k labels of the target region closest to a predicted vector, softmax(sim / tau), affect vector.

    queries: ids, target, predicted.  local: label, region, v — members of a region, bounded by the label set;
    the region's members are kept as one array per region, so a query row is not multiplied before scoring.
    """
    members = local.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("label", "v"))).alias("_m"))
    joined = queries.join(small_side(members), queries["target"] == members["region"])
    p = F.col("predicted")

    def score(m: Column) -> Column:
        sim = D.dot(m["v"], p) / F.greatest(D.norm2(m["v"]) * D.norm2(p), F.lit(1e-12))
        return F.struct((-F.round(sim, 12)).alias("n"), m["label"].alias("label"), m["v"].alias("v"))

    best = joined.withColumn("_s", F.slice(F.sort_array(F.transform("_m", score)), 1, k))
    weights = D.softmax(F.transform("_s", lambda s: -s["n"] / tau))
    best = best.withColumn("weights", weights)
    affect = [D.dot(F.col("weights"), F.transform("_s", lambda s: F.element_at(s["v"], d + 1))) for d in range(dim)]
    return best.select(*ids, "target", F.transform("_s", lambda s: s["label"]).alias("labels"), "weights",
                       F.array(*affect).alias("affect"))


def transition_examples(
    samples: DataFrame, cond: DataFrame, fits: DataFrame, local: DataFrame, dim: int, total: int
) -> DataFrame:
    """The most reliable pairs (two thirds A2B, the rest B2A), their most likely target region, the predicted
    vector and its output distribution.  samples: pair, s_item, t_item, source, x, w."""
    n_ab = total * 2 // 3
    quota = F.when(F.col("pair") == "A2B", n_ab).when(F.col("pair") == "B2A", total - n_ab).otherwise(0)
    ranked = ranking.range_positions(samples, ["pair"], [F.desc("w"), "s_item", "t_item"], "_pos")
    picked = ranked.filter(F.col("_pos") < quota)
    w = Window.partitionBy("pair", "source").orderBy(F.desc(F.round("cond", 9)), "target")  # grid rows only
    likely = cond.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("pair", "source", "target")
    withop = picked.join(small_side(likely), ["pair", "source"]).join(
        small_side(fits.select("pair", "source", "target", "a", "b")), ["pair", "source", "target"]
    )
    q = withop.withColumn("predicted", applied(F.col("x"), F.col("a"), F.col("b"), dim))
    ids = ["pair", "s_item", "t_item", "source", "w"]
    return output_distribution(q.select(*ids, "target", "predicted"), local, ids, dim)


def affine_maps(rows: DataFrame, dim: int, ridge: float = AFFINE_RIDGE) -> DataFrame:
    """Unweighted ridge per role pair, with the global map where a role pair has fewer than max(4, d/2) rows.

    rows: pair, x, y.  The null pair in the result is the global map, for role pairs never seen in training.
    """
    one = lambda c: F.array(F.struct(F.lit(0).cast("long").alias("region"), F.lit(1.0).alias("p"), F.col(c).alias("vector")))
    m = checkpointed(pair_moments(rows.select("pair", F.lit(1.0).alias("w"), one("x").alias("s_vecs"), one("y").alias("t_vecs")), dim))
    # The moments are small from here on: the tiles of each role pair.
    every = add_tiles(m.withColumn("pair", F.lit("*")), ["pair"])
    solve, _ = _solver(dim)
    assembled = assembler(2 * dim + 1)
    least = max(4, dim // 2)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (n, _, _), mw, _ = assembled(pdf)
        coef = solve(mw, ridge)
        return pd.DataFrame([{"pair": key[0], "n": int(n), "a": coef[:-1].ravel().tolist(), "b": coef[-1].tolist()}])

    schema = "pair string, n long, a array<double>, b array<double>"
    own = m.select("pair", "i", "j", "head", "mw", "mu").unionByName(every).groupBy("pair").applyInPandas(fit, schema)
    glob = own.filter("pair = '*'").select(F.col("a").alias("_ga"), F.col("b").alias("_gb"))
    few = F.col("n") < least
    return own.crossJoin(F.broadcast(glob)).select(  # one-row side
        "pair", "n", F.when(few, F.col("_ga")).otherwise(F.col("a")).alias("a"),
        F.when(few, F.col("_gb")).otherwise(F.col("b")).alias("b"), few.alias("used_global"),
    )


def prototypes(rows: DataFrame, dist: str, vec: str, regions: int, dim: int) -> DataFrame:
    """sum(q * z) / sum(q) per region; the global mean where a region has no weight."""
    long = rows.select(F.posexplode(dist).alias("region", "q"), F.col(vec).alias("z"))
    sums = [F.sum(F.col("q") * F.element_at("z", d + 1)).alias(f"s{d}") for d in range(dim)]
    plain = [F.avg(F.element_at(F.col(vec), d + 1)) for d in range(dim)]
    mean = rows.agg(F.array(*plain).alias("_mean"))
    agg = long.groupBy(F.col("region").cast("long").alias("region")).agg(F.sum("q").alias("weight"), *sums)
    ratio = F.array(*[F.col(f"s{d}") / F.greatest(F.col("weight"), F.lit(1e-12)) for d in range(dim)])
    base = rows.sparkSession.range(regions).withColumnRenamed("id", "region").join(agg, "region", "left")
    return base.crossJoin(F.broadcast(mean)).select(  # one-row side
        "region", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.when(F.coalesce("weight", F.lit(0.0)) > 1e-12, ratio).otherwise(F.col("_mean")).alias("prototype"),
    )


def reconstruct(rows: DataFrame, pred: str, protos: DataFrame, regions: int, dim: int) -> DataFrame:
    """Clipped and normalised prediction as the target distribution and q * prototypes as the vector;
    the gold columns are kept.  The prototype table is one row per region and travels as a single array row."""
    clipped = F.transform(pred, lambda x: F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    total = F.greatest(D.vsum(F.col("_c")), F.lit(1e-12))
    table = protos.agg(F.transform(F.sort_array(F.collect_list(F.struct("region", "prototype"))), lambda e: e["prototype"]).alias("_p"))
    q = rows.withColumn("_c", clipped).withColumn("target_dist", F.transform("_c", lambda x: x / total)).drop("_c")
    withp = q.crossJoin(F.broadcast(table))
    parts = [D.dot(F.col("target_dist"), F.transform("_p", lambda v: F.element_at(v, d + 1))) for d in range(dim)]
    h = -D.vsum(F.transform("target_dist", lambda x: x * F.ln(x + 1e-12)))
    return withp.withColumns({"target_vector": F.array(*parts), "pred_entropy": h}).drop("_p")


def class_weights(rows: DataFrame, dist: str, power: float = 0.5, eps: float = 1e-6) -> DataFrame:
    """(1 / max(share, eps)) ^ power per class, scaled to mean 1."""
    s = rows.select(F.posexplode(dist).alias("region", "q")).groupBy("region").agg(F.sum("q").alias("s"))
    every = Window.partitionBy()  # one row per class
    share = F.col("s") / F.greatest(F.sum("s").over(every), F.lit(eps))
    w = s.withColumn("w", F.pow(1 / F.greatest(share, F.lit(eps)), F.lit(power)))
    return w.select(F.col("region").cast("long").alias("region"), (F.col("w") / F.avg("w").over(every)).alias("weight"))
