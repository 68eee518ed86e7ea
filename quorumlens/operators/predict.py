"""Soft prediction, fusion with graph priors, calibration and gates."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import ranking
from ..functions import vectors as V
from ..functions.moments import add_arrays, scatterer
from . import metrics as M

# Parameter grids and prior strengths.
TAU_GRID = [0.05, 0.08, 0.1, 0.15, 0.2, 0.35, 0.5, 0.8]
ALPHA_GRID = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
BETA_GRID = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
RESIDUAL_BETA_GRID = [-0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0]
RIDGE_GRID = [0.01, 0.1, 1.0, 10.0, 100.0]
TEMPERATURE_GRID = [0.25, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0]
CENTROID_PRIOR, RIDGE_PRIOR = 0.15, 0.05
F1_THRESHOLDS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8]


# ---- C1, C2: classifiers on sparse vectors: item, f (array of bucket, x), see `functions.vectors` -----------

def class_prior(train: DataFrame, gold: str, classes: int) -> DataFrame:
    """One row with the normalised class masses of the training targets."""
    sums = train.agg(F.array(*[F.sum(F.element_at(F.col(gold), k + 1)) for k in range(classes)]).alias("_s"))
    total = D.vsum(F.col("_s"))
    return sums.select(F.transform("_s", lambda x: F.greatest(x, F.lit(0.0)) / total).alias("class_prior"))


def class_centroids(features: DataFrame, train: DataFrame, gold: str, classes: int, dim: int) -> DataFrame:
    """C1 fit: one row with the class centroids, each of unit length, as an array over buckets of arrays over classes.

    features: item, f; train: item, gold.  Only bucket sums, whose number is a parameter of the encoder, are shuffled after the join.
    """
    joined = features.join(train.select("item", F.col(gold).alias("_q")), "item").select("_q", F.explode("f").alias("e"))
    sums = joined.groupBy("e.bucket").agg(*[F.sum(F.col("e.x") * F.element_at("_q", k + 1)).alias(f"c{k}") for k in range(classes)])
    # The class weight scales a whole centroid and cancels when it is brought to unit length.
    lengths = F.array(*[F.sqrt(F.sum(F.col(f"c{k}") * F.col(f"c{k}"))) for k in range(classes)]).alias("_n")
    table = sums.agg(lengths, F.map_from_entries(F.collect_list(F.struct("bucket", F.array(*[F.col(f"c{k}") for k in range(classes)])))).alias("_c"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    unit = lambda c: F.zip_with(c, "_n", lambda v, n: F.when(n > 0, v / n).otherwise(0.0))
    zero = F.array_repeat(F.lit(0.0), classes)
    return table.select(F.transform(every, lambda b: F.coalesce(unit(F.try_element_at("_c", b)), zero)).alias("centroids"))


def centroid_cosines(features: DataFrame, centroids: DataFrame, classes: int) -> DataFrame:
    """C1 score: cosine of each item to each class centroid, 0 for an item without tokens."""
    joined = features.crossJoin(F.broadcast(centroids))  # one row of fixed size
    n = F.sqrt(V.square(F.col("f")))
    dots = V.against(F.col("f"), F.col("centroids"), classes)
    return joined.select("item", F.transform(dots, lambda v: F.when(n > 0, v / n).otherwise(0.0)).alias("cosines"))


def centroid_probabilities(cosines: DataFrame, prior: DataFrame, tau: Column | float) -> DataFrame:
    """softmax(cos / tau + 0.15 * ln prior)."""
    t = tau if isinstance(tau, Column) else F.lit(float(tau))
    joined = cosines.crossJoin(F.broadcast(prior))  # one-row side
    logits = F.zip_with("cosines", "class_prior", lambda c, p: c / t + CENTROID_PRIOR * F.ln(F.greatest(p, F.lit(D.EPS))))
    return joined.withColumn("pred", D.softmax(logits)).drop("class_prior")


def choose_tau(cosines: DataFrame, prior: DataFrame, valid: DataFrame, gold: str, grid: Sequence[float] = tuple(TAU_GRID)) -> DataFrame:
    """Validation cross-entropy of every tau; the smallest wins, the earlier on ties.  One pass for the grid."""
    taus = F.posexplode(F.array(*[F.lit(float(v)) for v in grid])).alias("order", "tau")
    rows = valid.select("item", F.col(gold).alias("_q")).join(cosines, "item").select("*", taus)
    scored = centroid_probabilities(rows, prior, F.col("tau"))
    ce = scored.groupBy("order", "tau").agg(F.avg(D.soft_cross_entropy(F.col("_q"), F.col("pred"))).alias("ce"))
    return best_row(ce, ["tau"])


def best_row(grid: DataFrame, params: Sequence[str]) -> DataFrame:
    """Smallest `ce` of a parameter grid, the first of the grid on (numerical) ties."""
    best = grid.agg(F.min(F.struct(F.round("ce", 12).alias("ce"), "order", *params)).alias("b"))
    return best.select(*[F.col(f"b.{p}").alias(p) for p in params], F.col("b.ce").alias("ce"))


def ridge_moments(lists: DataFrame, gold: str, dim: int, classes: int) -> DataFrame:
    """One row with X'X and X'Y of the bias-augmented vectors `f`, added up by Arrow batch and task; an item without tokens counts for the bias."""
    scatter = scatterer()

    def partial(batches):
        gram = np.zeros((dim + 1, dim + 1))
        right = np.zeros((dim + 1, classes))
        n = 0
        for pdf in batches:
            x = scatter(pdf["bucket"], pdf["x"], dim + 1)
            x[:, dim] = 1.0
            y = np.stack(pdf["q"].to_numpy()) if len(pdf) else np.zeros((0, classes))
            gram += x.T @ x
            right += x.T @ y
            n += len(pdf)
        if n:
            yield pd.DataFrame([{"one": 1, "gram": gram.ravel().tolist(), "rhs": right.ravel().tolist()}])

    rows = lists.select(F.col("f.bucket").alias("bucket"), F.col("f.x").alias("x"), F.col(gold).alias("q"))
    return add_arrays(rows.mapInPandas(partial, "one int, gram array<double>, rhs array<double>"), ["one"], ["gram", "rhs"])


def ridge_weights(moments: DataFrame, dim: int, classes: int, grid: Sequence[float] = tuple(RIDGE_GRID)) -> DataFrame:
    """Per lambda one row with the class weights: an array over buckets of arrays over classes; bucket `dim` is the bias."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.asarray(pdf["gram"].iloc[0]).reshape(dim + 1, dim + 1)
        rhs = np.asarray(pdf["rhs"].iloc[0]).reshape(dim + 1, classes)
        reg = np.eye(dim + 1) * pdf["lam"].iloc[0]
        reg[-1, -1] = 0.0
        w = np.linalg.solve(gram + reg, rhs)
        return pd.DataFrame([{"order": pdf["order"].iloc[0], "lam": pdf["lam"].iloc[0], "c": w.tolist()}])

    lams = F.posexplode(F.array(*[F.lit(float(v)) for v in grid])).alias("order", "lam")
    return moments.select("*", lams).groupBy("order").applyInPandas(solve, "order int, lam double, c array<array<double>>")


def ridge_scores(features: DataFrame, weights: DataFrame, dim: int, classes: int) -> DataFrame:
    """Raw scores per (item, lambda); an item without tokens gets the bias.  Weights: one row per lambda, of a size set by parameters."""
    grid = weights.agg(F.sort_array(F.collect_list(F.struct("order", "lam", "c"))).alias("_g"))
    bias = F.array(F.struct(F.lit(dim).cast("long").alias("bucket"), F.lit(1.0).alias("x")))
    joined = features.select("item", F.concat("f", bias).alias("f")).crossJoin(F.broadcast(grid))  # one row
    flat = joined.select("item", "f", F.explode("_g").alias("g"))
    return flat.select("item", "g.order", "g.lam", V.against(F.col("f"), F.col("g.c"), classes).alias("scores"))


def ridge_probabilities(scores: DataFrame, prior: DataFrame, temperature: Column) -> DataFrame:
    """softmax(score / T + 0.05 * ln prior)."""
    joined = scores.crossJoin(F.broadcast(prior))  # one-row side
    logits = F.zip_with("scores", "class_prior", lambda s, p: s / temperature + RIDGE_PRIOR * F.ln(F.greatest(p, F.lit(D.EPS))))
    return joined.withColumn("pred", D.softmax(logits)).drop("class_prior")


def choose_ridge(scores: DataFrame, prior: DataFrame, valid: DataFrame, gold: str) -> DataFrame:
    """Lambda and temperature with the smallest validation cross-entropy."""
    temps = F.posexplode(F.array(*[F.lit(v) for v in TEMPERATURE_GRID])).alias("t_order", "temperature")
    rows = scores.join(valid.select("item", F.col(gold).alias("_q")), "item").select("*", temps)
    p = ridge_probabilities(rows, prior, F.col("temperature"))
    ce = p.groupBy((F.col("order") * 100 + F.col("t_order")).alias("order"), "lam", "temperature").agg(
        F.avg(D.soft_cross_entropy(F.col("_q"), F.col("pred"))).alias("ce")
    )
    return best_row(ce, ["lam", "temperature"])


# ---- C4: baselines ---------------------------------------------------------------------------------------

def majority_baseline(train: DataFrame, rows: DataFrame, gold: str, classes: int) -> DataFrame:
    """C4: one-hot (softened by 1e-12) on the most frequent top class of the training rows, smallest id on ties."""
    counts = train.groupBy(D.top_index(F.col(gold)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "k"))["k"].alias("_k"))
    hot = F.transform(D.one_hot(F.col("_k"), classes), lambda x: F.greatest(x, F.lit(D.EPS)))
    out = rows.crossJoin(F.broadcast(best)).withColumn("_h", hot)  # one-row side
    return out.withColumn("pred", F.transform("_h", lambda x: x / D.vsum(F.col("_h")))).drop("_h", "_k")


def markov_hard(rows: DataFrame, cond: DataFrame, source: str, classes: int, pair: str = "A2B") -> DataFrame:
    """C4: the conditional row of the most likely source region (uniform when that row is missing)."""
    table = cond.filter(F.col("pair") == pair).groupBy("source").agg(
        F.array(*[F.sum(F.when(F.col("target") == k, F.col("cond")).otherwise(0.0)) for k in range(classes)]).alias("_r")
    )
    joined = rows.withColumn("_s", D.top_index(F.col(source))).join(F.broadcast(table), F.col("_s") == table["source"], "left")
    total = D.vsum(F.col("_r"))
    uniform = F.array(*[F.lit(1.0 / classes)] * classes)
    return joined.withColumn("pred", F.when(total > 0, F.transform("_r", lambda x: x / total)).otherwise(uniform)).drop("_s", "_r", "source")


# ---- C5-C7: fusion ---------------------------------------------------------------------------------------

def product_of_experts(text: Column, graph: Column, alpha: Column | float, beta: Column | float) -> Column:
    return D.softmax(D.scaled_sum(D.log_clip(text), D.log_clip(graph), alpha, beta))


def residual(text: Column, graph: Column, prior: Column, beta: Column | float) -> Column:
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    gain = F.zip_with(D.log_clip(graph), D.log_clip(prior), lambda g, p: b * (g - p))
    return D.softmax(F.zip_with(D.log_clip(text), gain, lambda t, r: t + r))


def entropy_gate(text: Column, classes: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), D.entropy(text) / F.ln(F.lit(float(classes)))))


def fusion_grid(rows: DataFrame, text: str, graph: str, gold: str, kind: str, classes: int, prior: DataFrame | None = None,
                betas: Sequence[float] | None = None) -> DataFrame:
    """Cross-entropy of every grid point, all from one pass over the validation rows.

    kind: "poe" (alpha x beta), "residual", "log" (alpha 1) or "gated" (beta times the text entropy gate).
    The row is not multiplied: each grid point is one average in a single aggregate.
    """
    t, g, q = F.col("_t"), F.col("_g"), F.col("_q")
    base = rows.select(F.col(text).alias("_t"), F.col(graph).alias("_g"), F.col(gold).alias("_q"))
    if kind == "residual":
        base = base.crossJoin(F.broadcast(prior.select(F.col("class_prior").alias("_p"))))  # one-row side
    points: list[tuple[float, float]]
    if kind == "poe":
        points = [(a, b) for a in ALPHA_GRID for b in (betas or BETA_GRID)]
    else:
        points = [(1.0, b) for b in (betas or (RESIDUAL_BETA_GRID if kind == "residual" else BETA_GRID))]
    grid = F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for i, (a, b) in enumerate(points)
    ])
    exploded = base.select("*", F.explode(grid).alias("pt")).select("_t", "_g", "_q", *(["_p"] if kind == "residual" else []), "pt.*")
    if kind == "residual":
        fused = residual(t, g, F.col("_p"), F.col("beta"))
    elif kind == "gated":
        fused = product_of_experts(t, g, 1.0, F.col("beta") * entropy_gate(t, classes))
    else:
        fused = product_of_experts(t, g, F.col("alpha"), F.col("beta"))
    return exploded.groupBy("order", "alpha", "beta").agg(F.avg(D.soft_cross_entropy(q, fused)).alias("ce"))


# ---- C8-C12: records and breakdowns -----------------------------------------------------------------------

def prediction_records(rows: DataFrame, gold: str, pred: str, keep: Sequence[str]) -> DataFrame:
    """Target and predicted top class, probability of the target, row cross-entropy, top-3 hit."""
    y = D.top_index(F.col(gold))
    base = rows.withColumn("target_top", y)
    return base.select(
        *keep, "target_top", D.top_index(F.col(pred)).alias("predicted_top"),
        F.element_at(F.col(pred), (F.col("target_top") + 1).cast("int")).alias("target_p"),
        D.soft_cross_entropy(F.col(gold), F.col(pred)).alias("ce"),
        (D.hit_at(F.col(pred), F.col("target_top"), 3) > 0).alias("top3_hit"),
    )


def helped_hurt(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int = 80) -> DataFrame:
    """Rows that model b got right and a wrong (helped) or the reverse (hurt); test rows first, n per kind."""
    left = a.select(*keys, "split", "target_top", F.col("predicted_top").alias("top_a"), F.col("ce").alias("ce_a"))
    right = b.select(*keys, F.col("predicted_top").alias("top_b"), F.col("ce").alias("ce_b"))
    j = left.join(right, list(keys))
    ok_a, ok_b = F.col("top_a") == F.col("target_top"), F.col("top_b") == F.col("target_top")
    def pick(cond: Column, name: str) -> DataFrame:
        chosen = j.filter(cond).withColumn("kind", F.lit(name))
        return chosen.orderBy((F.col("split") != "test").cast("int"), F.desc(F.round(F.abs(F.col("ce_a") - F.col("ce_b")), 9)), *keys).limit(n)
    return pick(~ok_a & ok_b, "helped").unionByName(pick(ok_a & ~ok_b, "hurt"))


def target_deltas(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy and cross-entropy difference (b minus a) per target class."""
    left = a.select(*keys, "target_top", F.col("predicted_top").alias("pa"), F.col("ce").alias("ca"))
    j = left.join(b.select(*keys, F.col("predicted_top").alias("pb"), F.col("ce").alias("cb")), list(keys))
    hit = lambda c: (F.col(c) == F.col("target_top")).cast("double")
    return j.groupBy("target_top").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit("pb") - hit("pa")).alias("d_accuracy"), F.avg(F.col("cb") - F.col("ca")).alias("d_ce")
    )


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    """C11: dense true x predicted counts.  rows: y, yhat."""
    counts = rows.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(classes * classes).select(
        F.floor(F.col("id") / classes).alias("y"), (F.col("id") % classes).alias("yhat")
    )
    return grid.join(counts, ["y", "yhat"], "left").fillna(0, ["n"])


def class_table(rows: DataFrame, classes: int) -> DataFrame:
    """C11: precision, recall, F1, support, predicted count and share, soft CE per class.  rows: y, yhat, ce."""
    cell = rows.groupBy("y", "yhat").agg(F.count(F.lit(1)).alias("n"), F.sum("ce").alias("ce"))
    every = Window.partitionBy()  # at most classes^2 rows from here on
    cell = cell.withColumn("total", F.sum("n").over(every))
    k = rows.sparkSession.range(classes).withColumnRenamed("id", "region")
    hit = lambda c: F.when(c, F.col("n")).otherwise(0)
    joined = k.join(F.broadcast(cell), (cell["y"] == k["region"]) | (cell["yhat"] == k["region"]), "left")
    t, p = F.col("y") == F.col("region"), F.col("yhat") == F.col("region")
    agg = joined.groupBy("region").agg(
        F.sum(hit(t & p)).alias("tp"), F.sum(hit(t)).alias("support"), F.sum(hit(p)).alias("predicted"),
        F.sum(F.when(t, F.col("ce")).otherwise(0.0)).alias("ces"), F.max("total").alias("total"),
    )
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return agg.select(
        "region", "support", "predicted", div("predicted", "total").alias("predicted_share"), div("tp", "predicted").alias("precision"),
        div("tp", "support").alias("recall"),
        F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0).alias("f1"),
        div("ces", "support").alias("ce"),
    )


def uncertainty_groups(rows: DataFrame, measures: dict[str, float]) -> DataFrame:
    """Rows labelled `<measure>_high` (at or above the median) and `<measure>_low`, one output row per
    measure.  `measures` maps a column to the block width of its exact median; nulls join no group."""
    out = rows
    for name, width in measures.items():
        med = ranking.median_of(rows.select(name), [], name, width, f"_m_{name}")
        out = out.crossJoin(F.broadcast(med))  # one-row side
    label = lambda m: F.when(F.col(m) >= F.col(f"_m_{m}"), F.lit(m + "_high")).when(F.col(m) < F.col(f"_m_{m}"), F.lit(m + "_low"))
    groups = F.array_compact(F.array(*[label(m) for m in measures]))
    return out.select(*rows.columns, F.explode(groups).alias("group"))


def subsets(rows: DataFrame, top_p: str, entropy: str, width: float = 0.001) -> DataFrame:
    """Rows of the subsets all, high_agreement (top probability at least .75) and low_agreement (entropy at
    or above the median of the split)."""
    med = ranking.median_of(rows.select("split", entropy), ["split"], entropy, width, "_m")
    names = F.array_compact(F.array(
        F.lit("all"), F.when(F.col(top_p) >= 0.75, F.lit("high_agreement")),
        F.when(F.col(entropy) >= F.col("_m"), F.lit("low_agreement"))))
    return rows.join(med, "split").select(*rows.columns, F.explode(names).alias("subset"))


# ---- C13-C17: gates ----------------------------------------------------------------------------------------

def gate_adjust(pred: Column, gate: Column, k: int, threshold: float, boost: float, low_cap: float, high_floor: float) -> Column:
    """Raise class k to max(p * (1 + boost * g), floor) where the gate is on, else cap it; renormalise."""
    def change(x: Column, i: Column) -> Column:
        up = F.greatest(x * (1.0 + boost * gate), F.lit(high_floor))
        return F.when(i != k, x).when(gate >= threshold, up).otherwise(F.least(x, F.lit(low_cap)))

    return D.normalized(F.transform(D.normalized(pred), change))


def mix_active(vector: Column, prototype: Column, gate: Column, threshold: float, gamma: float) -> Column:
    """(1 - gamma) * vector + gamma * prototype where the gate is on."""
    mixed = F.zip_with(vector, prototype, lambda v, p: (1.0 - gamma) * v + gamma * p)
    return F.when((gate >= threshold) & F.lit(gamma > 0), mixed).otherwise(vector)


def gate_summary(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """Rates and means before (`ungated`) and after (`gated`) the gate."""
    on = (F.col("gate") >= threshold).cast("double")
    at = lambda c: F.element_at(F.col(c), k + 1)
    top = lambda c: (D.top_index(F.col(c)) == k).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("gate").alias("mean_gate"), F.avg(on).alias("active_rate"),
        F.avg(at("ungated")).alias("mean_ungated_p"), F.avg(at("gated")).alias("mean_gated_p"),
        F.avg(top("ungated")).alias("ungated_top_rate"), F.avg(top("gated")).alias("gated_top_rate"),
    )


def gate_rows(rows: DataFrame, gold: str, k: int, negatives: Sequence[int], pos_min: float, neg_min: float) -> DataFrame:
    """C14: label 1 for a confident class k, 0 for a confident class of the negative set, else dropped."""
    top, p = D.top_index(F.col(gold)), F.array_max(F.col(gold))
    label = F.when((top == k) & (p >= pos_min), 1).when(top.isin(list(negatives)) & (p >= neg_min), 0)
    return rows.withColumn("gate_label", label).filter("gate_label is not null")


def downsample_negatives(rows: DataFrame, ratio: float, ids: Sequence[str], seed: object = 0) -> DataFrame:
    """C14: keep all positives and round(positives * ratio) negatives chosen by hash rank."""
    if ratio <= 0:
        return rows
    limit = rows.agg(F.rint(F.sum("gate_label") * F.lit(float(ratio))).alias("_max"))
    neg = ranking.hash_positions(rows.filter("gate_label = 0"), [], seed, ids, "_pos")
    kept = neg.crossJoin(F.broadcast(limit)).filter("_pos < _max").drop("_pos", "_max")  # one-row side
    return rows.filter("gate_label = 1").unionByName(kept)


def threshold_scan(rows: DataFrame, label: str, prob: str, fixed: Sequence[float] = tuple(F1_THRESHOLDS), width: float = 1 / 4096) -> DataFrame:
    """Precision, recall, F1, accuracy and rates at every fixed and observed threshold.

    Rows are merged by probability, thresholds become rows with zero counts, and the counts at or above each
    threshold are cumulative sums: block totals first, then inside each block.
    """
    merged = rows.groupBy(F.col(prob).alias("t")).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    extra = rows.sparkSession.createDataFrame([(float(v), 0, 0) for v in fixed], "t double, pos long, n long")
    points = merged.unionByName(extra).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    b = points.withColumn("_b", F.floor(F.col("t") / F.lit(width)))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = b.groupBy("_b").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    blocks = blocks.select("_b", F.coalesce(F.sum("bp").over(later), F.lit(0)).alias("ap"), F.coalesce(F.sum("bn").over(later), F.lit(0)).alias("an"))
    total = rows.agg(F.sum(label).alias("positives"), F.count(F.lit(1)).alias("total"), F.avg(prob).alias("mean_prob"))
    inside = Window.partitionBy("_b").orderBy(F.desc("t"))
    c = b.join(blocks, "_b").crossJoin(F.broadcast(total))  # one-row side
    tp = F.sum("pos").over(inside) + F.col("ap")
    pp = F.sum("n").over(inside) + F.col("an")
    c = c.select("t", tp.alias("tp"), pp.alias("pp"), "positives", "total", "mean_prob")
    prec = F.col("tp") / F.greatest(F.col("pp"), F.lit(1))
    rec = F.col("tp") / F.greatest(F.col("positives"), F.lit(1))
    acc = (2 * F.col("tp") + F.col("total") - F.col("pp") - F.col("positives")) / F.greatest(F.col("total"), F.lit(1))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("pp") + F.col("positives"))).otherwise(0.0)
    return c.select(F.col("t").alias("threshold"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), acc.alias("accuracy"),
                    (F.col("positives") / F.col("total")).alias("positive_rate"), (F.col("pp") / F.col("total")).alias("predicted_rate"), "mean_prob")


def best_threshold(scan: DataFrame) -> DataFrame:
    """Best (F1, precision, recall); start is 0.5, so it wins full ties, then the smallest threshold."""
    key = F.struct(F.round("f1", 12), F.round("precision", 12), F.round("recall", 12),
                   (F.col("threshold") == 0.5).alias("start"), (-F.col("threshold")).alias("neg"))
    return scan.agg(F.max(F.struct(key.alias("k"), F.struct(*scan.columns).alias("v"))).alias("m")).select("m.v.*")


def gate_evaluation(rows: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """before/after blocks per group: CE, accuracy, top-k rate and mean probability of class k, the deltas,
    and rates on active and inactive rows.  rows: gold, ungated, gated, gate_pred."""
    g = F.col("gold")
    def block(p: str) -> list[Column]:
        c = F.col(p)
        return [
            F.avg(D.soft_cross_entropy(g, c)).alias(p + "_ce"),
            F.avg((D.top_index(c) == D.top_index(g)).cast("double")).alias(p + "_accuracy"),
            F.avg((D.top_index(c) == k).cast("double")).alias(p + "_top_rate"),
            F.avg(F.element_at(c, k + 1)).alias(p + "_mean_p"),
        ]
    gold_k = (D.top_index(g) == k).cast("double")
    on = F.col("gate_pred") == 1
    n = D.normalized
    ready = rows.withColumns({"gold": n(F.col("gold")), "ungated": n(F.col("ungated")), "gated": n(F.col("gated"))})
    agg = ready.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gold_k).alias("gold_rate"), *block("ungated"), *block("gated"),
        F.sum(on.cast("long")).alias("active_n"),
        F.coalesce(F.avg(F.when(on, gold_k)), F.lit(0.0)).alias("active_gold_rate"),
        F.coalesce(F.avg(F.when(~on, gold_k)), F.lit(0.0)).alias("inactive_gold_rate"),
    )
    deltas = [(F.col(f"gated_{m}") - F.col(f"ungated_{m}")).alias(f"d_{m}") for m in ("ce", "accuracy", "top_rate", "mean_p")]
    return agg.select("*", *deltas)


def hardened(p: Column, classes: int) -> Column:
    """C17: one-hot of the most likely class."""
    return D.one_hot(D.top_index(p), classes)


def forced(k: int, classes: int) -> Column:
    """C17: one-hot of a given class."""
    return D.one_hot(F.lit(k), classes)


def evaluation_rows(rows: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Metric block over soft predictions grouped by any keys (split, subset, group)."""
    return M.metric_block(M.row_metrics(rows), keys, classes)
