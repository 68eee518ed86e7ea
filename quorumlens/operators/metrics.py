"""Metrics of distributions and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import ranking

BINS = 10


def row_metrics(df: DataFrame, gold: str = "gold", pred: str = "pred", eps: float = D.EPS) -> DataFrame:
    """M1-M5: normalised vectors and the per-row measures, appended as columns."""
    n = df.withColumns({gold: D.normalized(F.col(gold), eps), pred: D.normalized(F.col(pred), eps)})
    g, p = F.col(gold), F.col(pred)
    out = n.withColumns({"y": D.top_index(g), "yhat": D.top_index(p), "conf": F.array_max(p)})
    return out.withColumns({
        "ce": D.soft_cross_entropy(g, p),
        "kl": D.kl_divergence(g, p),
        "jsd": D.jensen_shannon(g, p),
        "jsd_bits": D.jensen_shannon(g, p, base2=True),
        "brier": D.brier(g, p),
        "entropy": D.entropy(g),
        "top3": D.hit_at(p, F.col("y"), 3),
        "overlap": D.overlap(g, p),
        "same_top": D.shares_top(g, p),
    })


def _cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: means of the row measures and the list of (y, yhat, bin) cells.

    Rows are summed into at most C * C * 10 cells per group before anything is listed, so the list is bounded
    by the number of classes and everything below is arithmetic inside one row.
    """
    bin_ = F.least(F.floor(F.col("conf") * BINS), F.lit(BINS - 1))
    sums = ["ce", "kl", "jsd", "brier", "top3"]
    cell = rows.groupBy(*keys, "y", "yhat", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("conf").alias("conf"), *[F.sum(c).alias(c) for c in sums]
    )
    return cell.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[(F.sum(c) / F.sum("n")).alias(c) for c in sums],
        (F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"),
        F.collect_list(F.struct("y", "yhat", "bin", "n", "conf")).alias("cells"),
    )


def _count(cells: Column, cond) -> Column:
    return F.aggregate(F.filter(cells, cond), F.lit(0).cast("long"), lambda s, c: s + c["n"])


def class_scores(cells: Column, classes: int) -> Column:
    """M6: array of structs (tp, fp, fn, precision, recall, f1, support) per class."""

    def one(k: Column) -> Column:
        k = k.cast("long")
        tp = _count(cells, lambda c: (c["y"] == k) & (c["yhat"] == k))
        fp = _count(cells, lambda c: (c["y"] != k) & (c["yhat"] == k))
        fn = _count(cells, lambda c: (c["y"] == k) & (c["yhat"] != k))
        return F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    counts = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), one)

    def score(c: Column) -> Column:
        p = F.when(c["tp"] + c["fp"] > 0, c["tp"] / (c["tp"] + c["fp"])).otherwise(0.0)
        r = F.when(c["tp"] + c["fn"] > 0, c["tp"] / (c["tp"] + c["fn"])).otherwise(0.0)
        f = F.when(c["tp"] > 0, 2.0 * c["tp"] / (2 * c["tp"] + c["fp"] + c["fn"])).otherwise(0.0)
        return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"), (c["tp"] + c["fn"]).alias("support"),
                        (c["tp"] + c["fp"]).alias("predicted"))

    return F.transform(counts, score)


def macro_f1(scores: Column, present_only: bool) -> Column:
    """M6: mean F1 over classes that occur as truth or prediction, or over all classes."""
    used = F.filter(scores, lambda s: (s["support"] > 0) | (s["predicted"] > 0)) if present_only else scores
    return F.aggregate(used, F.lit(0.0), lambda a, s: a + s["f1"]) / F.greatest(F.size(used), F.lit(1))


def weighted_f1(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0).cast("long"), lambda a, s: a + s["support"])
    return F.when(total > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["f1"] * s["support"]) / total).otherwise(0.0)


def calibration_error(cells: Column, n: Column) -> Column:
    """M7: ten equal bins, the last one closed."""

    def gap(b: Column) -> Column:
        b = b.cast("long")
        right = _count(cells, lambda c: (c["bin"] == b) & (c["y"] == c["yhat"]))
        conf = F.aggregate(F.filter(cells, lambda c: c["bin"] == b), F.lit(0.0), lambda s, c: s + c["conf"])
        return F.abs(right - conf)

    return D.vsum(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), gap)) / n


def metric_block(rows: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """One row per group with CE, KL, JSD, Brier, accuracy, top-3, F1 forms, ECE and per-class F1.

    `rows` comes from `row_metrics`.  One scan and one shuffle of the data; the rest works on the cells.
    """
    c = _cells(rows, keys).withColumn("scores", class_scores(F.col("cells"), classes))
    return c.select(
        *keys, "n", "ce", "kl", "jsd", "brier", "top3", "accuracy",
        (F.col("brier") / classes).alias("brier_mean"),
        macro_f1(F.col("scores"), True).alias("macro_f1"),
        macro_f1(F.col("scores"), False).alias("macro_f1_all"),
        weighted_f1(F.col("scores")).alias("weighted_f1"),
        calibration_error(F.col("cells"), F.col("n")).alias("ece"),
        F.transform("scores", lambda s: s["f1"]).alias("class_f1"),
    )


def entropy_breakdown(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M8: rows at or below and above the median target entropy: n, means, CE, accuracy per group."""
    med = ranking.median_of(rows.select(*keys, "entropy"), keys, "entropy", 0.001, "_m")
    joined = rows.join(med, list(keys)) if keys else rows.crossJoin(F.broadcast(med))  # one row without keys
    stratum = F.when(F.col("entropy") <= F.col("_m"), "low_target_entropy").otherwise("high_target_entropy")
    return joined.groupBy(*keys, stratum.alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("entropy").alias("mean_entropy"),
        F.avg("conf").alias("mean_conf"),
        F.avg("ce").alias("ce"),
        F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("accuracy"),
    )


def _zeroed(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x.cast("double")))


def vector_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """M9: per-row cosine (denominator at least 1e-12) and squared error, NaN read as 0."""
    z = df.withColumns({"_g": _zeroed(F.col(gold)), "_p": _zeroed(F.col(pred))})
    scale = F.greatest(D.norm2(F.col("_g")) * D.norm2(F.col("_p")), F.lit(1e-12))
    return z.withColumns({
        "cosine": D.dot(F.col("_g"), F.col("_p")) / scale,
        "mse": D.mean_squared(F.col("_g"), F.col("_p")),
    }).drop("_g", "_p")


def leave_one_out(votes: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """M11 in label space: each annotator's label against the mean of the other annotators.

    With one label per annotator only the others' share s of that label matters: overlap is s, and the
    base-2 divergence is (1 - s + s * log2(2s / (1 + s)) + log2(2 / (1 + s))) / 2.  So two counts replace
    a self-join of annotators.
    """
    per = votes.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("c"))
    # One row per distinct label of an item.
    total = per.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    joined = votes.select(*keys, "annotator", label).join(total, [*keys, label]).filter("n > 1")
    s = (F.col("c") - 1) / (F.col("n") - 1)
    own = F.when(s > 0, s * F.log2(2 * s / (1 + s))).otherwise(0.0)
    return joined.select(*keys, "annotator", ((1 - s + own + F.log2(2 / (1 + s))) / 2).alias("loo_jsd"), s.alias("loo_overlap"))


def leave_one_out_regions(votes: DataFrame, membership_dense: DataFrame, keys: Sequence[str], regions: int, label: str = "label") -> DataFrame:
    """M11 in region space: the annotator's membership row against the mean of the others' rows.

    The others' mean is (sum - own) / (n - 1), so one aggregate per item is enough.
    `membership_dense` has (label, m array).
    """
    mapped = votes.select(*keys, "annotator", label).join(membership_dense, label)
    sums = mapped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.element_at("m", i + 1)) for i in range(regions)]).alias("s")
    )
    joined = mapped.join(sums, list(keys)).filter("n > 1")
    rest = F.transform(F.zip_with("s", "m", lambda a, b: F.greatest(a - b, F.lit(0.0))), lambda x: x / (F.col("n") - 1))
    other = joined.withColumn("_o", rest)
    m, o = F.col("m"), F.col("_o")
    return other.select(*keys, "annotator", D.jensen_shannon(m, o, base2=True).alias("loo_region_jsd"),
                        D.overlap(m, o).alias("loo_region_overlap"))


def average_ranks(values: DataFrame, value: str, width: float) -> DataFrame:
    """Tie-averaged 1-based rank of each distinct value; `values` has (value, n)."""
    b = values.withColumn("_b", F.floor(F.col(value) / F.lit(width)))
    blocks = b.groupBy("_b").agg(F.sum("n").alias("_bn"))
    # One row per block of values: the only unpartitioned window.
    before = blocks.withColumn("_start", F.sum("_bn").over(Window.orderBy("_b")) - F.col("_bn")).drop("_bn")
    local = F.sum("n").over(Window.partitionBy("_b").orderBy(value))
    return b.withColumn("_hi", local).join(before, "_b").select(
        value, (F.col("_start") + F.col("_hi") - F.col("n") + (F.col("n") + 1) / 2).alias("rank")
    )


def spearman(df: DataFrame, x: str, y: str, width_x: float, width_y: float) -> DataFrame:
    """Pearson correlation of tie-averaged ranks.  Equal (x, y) pairs are merged before ranking, so a value
    that holds a third of all rows is one row in the joins."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    rx = average_ranks(pairs.groupBy(x).agg(F.sum("n").alias("n")), x, width_x).withColumnRenamed("rank", "rx")
    ry = average_ranks(pairs.groupBy(y).agg(F.sum("n").alias("n")), y, width_y).withColumnRenamed("rank", "ry")
    j = pairs.join(rx, x).join(ry, y)
    n = F.col("n")
    s = j.agg(
        F.sum(n).alias("n"), F.sum(n * F.col("rx")).alias("sx"), F.sum(n * F.col("ry")).alias("sy"),
        F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(n * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(n * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    c = F.col
    cov = c("sxy") - c("sx") * c("sy") / c("n")
    vx, vy = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    return s.select("n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("spearman"))


def perplexity(losses: DataFrame, keys: Sequence[str], nll: str, tokens: str) -> DataFrame:
    """Token-weighted mean loss and its exponential, infinite from 50 on; both null for a group without tokens."""
    m = losses.groupBy(*keys).agg(F.try_divide(F.sum(nll), F.sum(tokens)).alias("loss"))
    return m.withColumn("perplexity", F.when(F.col("loss") < 50, F.exp("loss")).when(F.col("loss").isNotNull(), F.lit(float("inf"))))


def norm_summary(df: DataFrame, keys: Sequence[str], vec: str, width: float = 0.01) -> DataFrame:
    """Mean, population deviation and the 5/50/95 percentiles of vector norms."""
    norms = df.select(*keys, D.norm2(_zeroed(F.col(vec))).alias("norm"))
    base = norms.groupBy(*keys).agg(F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("std_norm"))
    q = ranking.order_statistics(norms, keys, "norm", [0.05, 0.5, 0.95], width)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("prob") == p, F.col("q"))).alias(n)
                                  for p, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])
    return base.join(wide, list(keys)) if keys else base.crossJoin(F.broadcast(wide))  # single rows
