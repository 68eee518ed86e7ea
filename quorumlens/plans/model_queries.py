"""Queries for metrics (M), regression (R), prediction and fusion (C) and text similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import moments as MO
from ..functions import text as X
from ..functions import vectors as V
from ..functions.lineage import checkpointed
from ..operators import membership as mem
from ..operators import metrics as M
from ..operators import predict as P
from ..operators import regression as R
from ..operators import similarity as sim
from ..operators import softlabel as sl
from ..operators import transition as tr
from .fixtures import CTES, ITEM, REGIONS, Tables, r6
from .registry import query
from .space_queries import conditioned, conds, local_table, uncertain

LN_C = f"ln({REGIONS}.0::double)"
JSD_TERM = "(CASE WHEN {a} > 0 THEN {a} * ln({a} / (({a} + {b}) / 2)) ELSE 0 END)"
CTES.update({
    "scored": ("preds", f"""
        SELECT item, any_value(split) AS split, any_value(role) AS role, any_value(mean_conf) AS mean_conf,
          arg_min(region, (-gold, region)) AS y, arg_min(region, (-pred, region)) AS yhat, max(pred) AS conf, max(gold) AS top_gold,
          -sum(gold * ln(pred)) AS ce, sum(CASE WHEN gold > 0 THEN gold * ln(gold / pred) ELSE 0 END) AS kl,
          sum({JSD_TERM.format(a="gold", b="pred")} + {JSD_TERM.format(a="pred", b="gold")}) / 2 AS jsd,
          sum((gold - pred) * (gold - pred)) AS brier, sum(least(gold, pred)) AS overlap,
          -sum(CASE WHEN gold > 0 THEN gold * ln(gold) ELSE 0 END) AS entropy,
          list(pred ORDER BY region) AS ps, list(gold ORDER BY region) AS gs FROM preds GROUP BY item"""),
    "class_cells": ("scored", f"""
        SELECT split, k, count(*) FILTER (WHERE y = k AND yhat = k) AS tp, count(*) FILTER (WHERE y = k) AS support,
          count(*) FILTER (WHERE yhat = k) AS predicted, count(*) AS n, avg(ce) FILTER (WHERE y = k) AS ce
        FROM scored CROSS JOIN (SELECT unnest(range(0, {REGIONS})) AS k) GROUP BY split, k"""),
    "instances": ("pairs preds regional conds dist", """
        SELECT pr.t_item AS item, pr.s_item, pr.split, p.region, p.gold, p.pred AS txt, g.prior AS graph, s.p AS src
        FROM pairs pr JOIN preds p ON p.item = pr.t_item JOIN dist s ON s.item = pr.s_item AND s.region = p.region
        JOIN (SELECT s_item, target, x / sum(x) OVER (PARTITION BY s_item) AS prior FROM (
          SELECT s_item, c.target, sum(r.p * c.cond) AS x FROM pairs JOIN dist r ON r.item = s_item
          JOIN conds c ON c.pair = 'A2B' AND c.source = r.region WHERE pairs.pair = 'A2B' GROUP BY ALL)) g
          ON g.s_item = pr.s_item AND g.target = p.region WHERE pr.pair = 'A2B'"""),
    "label_prior": ("instances", """
        SELECT region, sum(gold) / sum(sum(gold)) OVER () AS class_prior FROM instances WHERE split = 'train' GROUP BY region"""),
})


def scored(t: Tables) -> DataFrame:
    return M.row_metrics(t.preds)


@query("row_metrics_M1_M5", uses="scored", sql=f"""
    SELECT item, y, yhat, round(ce, 6) AS ce, round(kl, 6) + 0.0 AS kl, round(jsd, 6) + 0.0 AS jsd, round(jsd / ln(2.0::double), 6) + 0.0 AS jsd_bits,
      round(brier, 6) AS brier, round(overlap, 6) AS overlap,
      len(list_filter(ps, lambda x: x > ps[y + 1])) < 3 AS top3, list_bool_or(list_transform(range(1, {REGIONS} + 1),
        lambda i: abs(ps[i] - list_max(ps)) <= 1e-12 AND abs(gs[i] - list_max(gs)) <= 1e-12)) AS same_top FROM scored""")
def row_metrics(t: Tables) -> DataFrame:
    return scored(t).select("item", "y", "yhat", r6("ce"), r6("kl"), r6("jsd"), r6("jsd_bits"), r6("brier"), r6("overlap"),
                            (F.col("top3") > 0).alias("top3"), "same_top")


F1_SQL = "CASE WHEN tp > 0 THEN 2 * tp / (support + predicted) ELSE 0 END"


@query("metric_block_M6_M7_M14", uses="scored class_cells", sql=f"""
    SELECT split, round(any_value(a.ce), 6) AS ce, round(any_value(a.kl), 6) AS kl, round(any_value(a.jsd), 6) AS jsd, round(any_value(a.brier), 6) AS brier,
      round(any_value(a.accuracy), 6) AS accuracy, round(avg({F1_SQL}) FILTER (WHERE support + predicted > 0), 6) AS macro_f1,
      round(avg({F1_SQL}), 6) AS macro_f1_all, round(sum({F1_SQL} * support) / sum(support), 6) AS weighted_f1,
      round(any_value(e.ece), 6) AS ece, round(max({F1_SQL}) FILTER (WHERE k = 2), 6) AS f1_class_2
    FROM class_cells c
    JOIN (SELECT split, avg(ce) AS ce, avg(kl) AS kl, avg(jsd) AS jsd, avg(brier) AS brier, avg((y = yhat)::int) AS accuracy FROM scored GROUP BY split) a USING (split)
    JOIN (SELECT split, sum(abs(hits - confs)) / sum(n) AS ece FROM (SELECT split, least(floor(conf * 10), 9) AS b, count(*) AS n,
        sum((y = yhat)::int) AS hits, sum(conf) AS confs FROM scored GROUP BY ALL) GROUP BY split) e USING (split) GROUP BY split""")
def metric_block(t: Tables) -> DataFrame:
    b = M.metric_block(scored(t), ["split"], REGIONS)
    return b.select("split", *[r6(c) for c in ("ce", "kl", "jsd", "brier", "accuracy", "macro_f1", "macro_f1_all", "weighted_f1", "ece")],
                    r6(F.element_at("class_f1", 3), "f1_class_2"))


@query("entropy_breakdown_M8", uses="scored", sql="""
    SELECT split, CASE WHEN entropy <= m THEN 'low_target_entropy' ELSE 'high_target_entropy' END AS stratum, count(*) AS n,
      round(avg(entropy), 6) AS mean_entropy, round(avg(conf), 6) AS mean_conf, round(avg(ce), 6) AS ce, round(avg((y = yhat)::int), 6) AS accuracy
    FROM (SELECT * EXCLUDE (entropy), round(entropy, 9) AS entropy FROM scored) JOIN (SELECT split, median(round(entropy, 9)) AS m FROM scored GROUP BY split) USING (split) GROUP BY ALL""")
def entropy_breakdown(t: Tables) -> DataFrame:
    e = M.entropy_breakdown(scored(t).withColumn("entropy", F.round("entropy", 9)), ["split"])
    return e.select("split", "stratum", "n", r6("mean_entropy"), r6("mean_conf"), r6("ce"), r6("accuracy"))


@query("vector_metrics_M9", sql="""
    WITH p AS (SELECT label, list_transform(range(1, 65), lambda i: 0.0) AS z FROM embeddings LIMIT 0),
    x AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, unnest(embedding)::double AS v FROM embeddings),
    m AS (SELECT label, d, avg(v) AS m FROM x GROUP BY ALL)
    SELECT vec_id, round(sum(v * m) / greatest(sqrt(sum(v * v)) * sqrt(sum(m * m)), 1e-12), 6) + 0.0 AS cosine,
      round(avg((v - m) * (v - m)), 6) AS mse FROM x JOIN m USING (label, d) GROUP BY vec_id""")
def vector_metrics(t: Tables) -> DataFrame:
    e = embedding_rows(t)
    protos = R.prototypes(e, "q", "z", 10, 64).select(F.col("region").alias("label"), "prototype")
    joined = e.join(F.broadcast(protos), "label")  # ten region rows
    return M.vector_metrics(joined, "z", "prototype").select("vec_id", r6("cosine"), r6("mse"))


def embedding_rows(t: Tables) -> DataFrame:
    e = t.read("embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("z"),
                    D.one_hot(F.col("label"), 10).alias("q"))


@query("leave_one_out_M11", uses="votes membership", sql="""
    WITH o AS (SELECT a.item, a.annotator, a.label, l, count(*) FILTER (WHERE b.label = l) / 3 AS o, (a.label = l)::int AS p
      FROM votes a JOIN votes b ON a.item = b.item AND a.annotator <> b.annotator CROSS JOIN (SELECT unnest(range(0, 24)) AS l) GROUP BY ALL)
    SELECT item, annotator, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + o)) ELSE 0 END + CASE WHEN o > 0 THEN o * log2(2 * o / (p + o)) ELSE 0 END) / 2, 6) + 0.0 AS loo_jsd,
      round(sum(least(p, o)), 6) AS loo_overlap FROM o GROUP BY item, annotator""")
def leave_one_out(t: Tables) -> DataFrame:
    return M.leave_one_out(t.votes, ITEM).select("item", "annotator", r6("loo_jsd"), r6("loo_overlap"))


@query("leave_one_out_regions_M11", uses="votes membership", sql="""
    WITH g AS (SELECT l AS label, r AS region, coalesce(m, 0) AS m FROM range(0, 24) x(l) CROSS JOIN range(0, 6) y(r)
        LEFT JOIN membership ON membership.label = l AND membership.region = r),
    o AS (SELECT a.item, a.annotator, ga.region, any_value(ga.m) AS p, sum(gb.m) / 3 AS o FROM votes a
      JOIN votes b ON a.item = b.item AND a.annotator <> b.annotator JOIN g ga ON ga.label = a.label
      JOIN g gb ON gb.label = b.label AND gb.region = ga.region GROUP BY a.item, a.annotator, ga.region)
    SELECT item, annotator, round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + o)) ELSE 0 END + CASE WHEN o > 0 THEN o * log2(2 * o / (p + o)) ELSE 0 END) / 2, 6) + 0.0 AS loo_region_jsd,
      round(sum(least(p, o)), 6) AS loo_region_overlap FROM o GROUP BY item, annotator""")
def leave_one_out_regions(t: Tables) -> DataFrame:
    md = mem.dense_regions(t.membership.withColumnRenamed("m", "p"), ["label"], REGIONS, "m")
    l = M.leave_one_out_regions(t.votes, F.broadcast(md), ITEM, REGIONS)  # one row per label
    return l.select("item", "annotator", r6("loo_region_jsd"), r6("loo_region_overlap"))


@query("spearman_M12", sql="""
    SELECT n, round(corr, 6) AS spearman FROM (SELECT count(*) AS n, corr(rx, ry) AS corr FROM (
      SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx,
        rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem))""")
def spearman(t: Tables) -> DataFrame:
    s = M.spearman(t.read("lineitem"), "l_quantity", "l_extendedprice", 5.0, 1000.0)
    return s.select("n", r6("spearman"))


@query("perplexity_M13", uses="scored turns", sql="""
    SELECT split, round(sum(nll) / sum(tok), 6) AS loss, round(exp(sum(nll) / sum(tok)), 6) AS perplexity FROM (
      SELECT s.split, ce * len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS nll, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tok
      FROM scored s JOIN turns USING (item)) GROUP BY split""")
def perplexity(t: Tables) -> DataFrame:
    rows = scored(t).select("item", "split", "ce").join(t.turns.select("item", F.size(X.tokens(F.col("text"))).alias("tok")), "item")
    p = M.perplexity(rows.withColumn("nll", F.col("ce") * F.col("tok")), ["split"], "nll", "tok")
    return p.select("split", r6("loss"), r6("perplexity"))


@query("norm_summary_M15", sql="""
    SELECT label, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(quantile_cont(n, 0.05), 6) AS p05,
      round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95 FROM (
      SELECT label::bigint AS label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) AS n FROM embeddings) GROUP BY label""")
def norm_summary(t: Tables) -> DataFrame:
    s = M.norm_summary(embedding_rows(t), ["label"], "z")
    return s.select("label", r6("mean_norm"), r6("std_norm"), r6("p05"), r6("p50"), r6("p95"))


# ---- regression -------------------------------------------------------------------------------------------

def pair_samples(t: Tables) -> DataFrame:
    lists = R.conditioned_lists(conditioned(t))
    return R.sample_pairs(t.pairs.filter("lag = 1"), lists, uncertain(t).select("item", "reliability"))


def scalar_samples(t: Tables) -> DataFrame:
    """The same samples with one-component vectors, whose fits have a closed form in SQL."""
    cut = lambda c: F.transform(c, lambda e: F.struct(e["region"].alias("region"), e["p"].alias("p"), F.slice(e["vector"], 1, 1).alias("vector")))
    return pair_samples(t).withColumns({"s_vecs": cut("s_vecs"), "t_vecs": cut("t_vecs")})


CTES["pair_sums"] = ("pairs contrib local_vec uncertain", """
    SELECT pair, source, target, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx,
      sum(w * x * y) AS sxy, sum(w * y * y) AS syy, sum(x) AS ux, sum(y) AS uy, sum(x * x) AS uxx, sum(x * y) AS uxy, sum(y * y) AS uyy FROM (
      SELECT p.pair, a.region AS source, b.region AS target, a.v AS x, b.v AS y, a.r * b.r * sqrt(ua.reliability * ub.reliability) AS w
      FROM pairs p JOIN cv a ON a.item = p.s_item JOIN cv b ON b.item = p.t_item JOIN uncertain ua ON ua.item = p.s_item
      JOIN uncertain ub ON ub.item = p.t_item WHERE lag = 1) WHERE w > 0 GROUP BY ALL""")
CTES["cv"] = ("contrib local_vec", """
    SELECT item, c.region, any_value(r) AS r, sum(w * x) / (any_value(r) + 1e-12) AS v
    FROM contrib c JOIN local_vec l ON l.label = c.label AND l.region = c.region AND l.d = 0 GROUP BY item, c.region""")
CTES["pair_sums"] = (CTES["pair_sums"][0] + " cv", CTES["pair_sums"][1])
SLOPE = "(sxy - sx * sy / sw) / (sxx - sx * sx / sw + {lam})"


@query("ridge_operators_R1_R4", uses="pair_sums", sql=f"""
    WITH sh AS (SELECT pair, {SLOPE.format(lam="1.0")} AS sa, sx, sy, sw FROM (SELECT pair, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx,
        sum(sxy) AS sxy, sum(sw) AS sw FROM pair_sums GROUP BY pair)),
    f AS (SELECT p.*, CASE WHEN p.sw < 5 OR n < 2 THEN 'low_support' WHEN p.sw * p.sw / sw2 < 30 THEN 'learned_strong_ridge' ELSE 'learned' END AS status,
        CASE WHEN p.sw < 5 OR n < 2 THEN 1.0 WHEN p.sw * p.sw / sw2 < 30 THEN 10 * 30 / (p.sw * p.sw / sw2) ELSE 1.0 END AS ridge,
        sa, sh.sy / sh.sw - sa * sh.sx / sh.sw AS sb FROM pair_sums p JOIN sh USING (pair)),
    g AS (SELECT *, CASE WHEN status = 'low_support' THEN sa ELSE {SLOPE.format(lam="ridge")} END AS a FROM f),
    h AS (SELECT *, CASE WHEN status = 'low_support' THEN sb ELSE sy / sw - a * sx / sw END AS b FROM g)
    SELECT pair, source, target, status, n, round(sw, 6) AS soft_support, round(sw * sw / sw2, 6) AS effective_support, round(ridge, 6) AS ridge,
      round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round((syy + a * a * sxx + b * b * sw - 2 * a * sxy - 2 * b * sy + 2 * a * b * sx) / sw, 6) + 0.0 AS weighted_mse,
      round((uyy + a * a * uxx + b * b * n - 2 * a * uxy - 2 * b * uy + 2 * a * b * ux) / n, 6) + 0.0 AS mse FROM h""")
def ridge_operators(t: Tables) -> DataFrame:
    f = R.fit_operators(MO.pair_moments(scalar_samples(t), 1), 1)
    return f.select("pair", "source", "target", "status", "n", r6("soft_support"), r6("effective_support"), r6("ridge"),
                    r6(F.element_at("a", 1), "a"), r6(F.element_at("b", 1), "b"), r6("weighted_mse"), r6("mse"))


@query("shared_operators_R2", uses="pair_sums", sql=f"""
    SELECT pair, n, round(sw, 6) AS soft_support, round(a, 6) + 0.0 AS a, round(sy / sw - a * sx / sw, 6) + 0.0 AS b FROM (
      SELECT *, {SLOPE.format(lam="1.0")} AS a FROM (SELECT pair, sum(n)::bigint AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy,
        sum(sw) AS sw FROM pair_sums GROUP BY pair))""")
def shared_operators(t: Tables) -> DataFrame:
    s = R.shared_operators(MO.pair_moments(scalar_samples(t), 1), 1)
    return s.select("pair", "n", r6("soft_support"), r6(F.element_at("a", 1), "a"), r6(F.element_at("b", 1), "b"))


@query("target_centroids_R3", uses="pair_sums", sql="""
    SELECT pair, target, round(sum(sy) / sum(sw), 6) + 0.0 AS centroid FROM pair_sums GROUP BY pair, target""")
def target_centroids(t: Tables) -> DataFrame:
    c = R.target_centroids(MO.pair_moments(scalar_samples(t), 1), 1)
    return c.select("pair", "target", r6(F.element_at("centroid", 1), "centroid"))


def vector_fits(t: Tables) -> DataFrame:
    regions = lambda c: t.spark.range(REGIONS).withColumnRenamed("id", c)
    grid = t.pairs.filter("lag = 1").select("pair").distinct().crossJoin(regions("source")).crossJoin(regions("target"))  # four pair types and regions
    return R.fit_operators(MO.pair_moments(pair_samples(t), 4), 4, grid=grid)


# Whole vectors: samples z = (x, 1, y), the moments of a group as rows of a list, and Gauss-Jordan steps that solve (X'WX + ridge) C = X'WY.
CTES["vsamples"] = ("pairs contrib local_vec uncertain", """
    SELECT p.pair, a.region AS source, b.region AS target, list_concat(list_append(a.v, 1.0::double), b.v) AS z, a.r * b.r * sqrt(ua.reliability * ub.reliability) AS w
    FROM pairs p JOIN cvd a ON a.item = p.s_item JOIN cvd b ON b.item = p.t_item JOIN uncertain ua ON ua.item = p.s_item JOIN uncertain ub ON ub.item = p.t_item WHERE lag = 1""")
CTES["cvd"] = ("contrib local_vec", """
    SELECT item, region, any_value(r) AS r, list(v ORDER BY d) AS v FROM (
      SELECT item, c.region, d, any_value(r) AS r, sum(w * x) / (any_value(r) + 1e-12) AS v FROM contrib c JOIN local_vec l ON l.label = c.label AND l.region = c.region GROUP BY item, c.region, d)
    GROUP BY item, region""")
CTES["vsamples"] = (CTES["vsamples"][0] + " cvd", CTES["vsamples"][1])
CTES["vmoments"] = ("vsamples", """
    SELECT pair, source, target, list(row ORDER BY i) AS m FROM (
      SELECT pair, source, target, i, list(x ORDER BY j) AS row FROM (
        SELECT pair, source, target, i, j, sum(w * z[i] * z[j]) AS x FROM vsamples CROSS JOIN range(1, 6) a(i) CROSS JOIN range(1, 10) b(j) WHERE w > 0 GROUP BY ALL)
      GROUP BY pair, source, target, i) GROUP BY pair, source, target""")


def solved_sql(systems: str, keys: str) -> str:
    """CTE text `solved` (keys, coef): solutions of `systems` (keys, ridge, m), m five rows of nine columns."""
    return f"""
    steps AS (
      SELECT {keys}, 0 AS k, list_transform(m, lambda row, i: list_transform(row, lambda x, j: x + CASE WHEN i = j AND i < 5 THEN ridge ELSE 0 END)) AS m FROM {systems}
      UNION ALL
      SELECT {keys}, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
        ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM steps WHERE k < 5),
    solved AS (SELECT {keys}, list_transform(m, lambda row: row[6:9]) AS coef FROM steps WHERE k = 5)"""


SUMMED = "(SELECT {keys}, 1.0::double AS ridge, list(row ORDER BY i) AS m FROM (SELECT {keys}, i, list(x ORDER BY j) AS row FROM (SELECT {keys}, i, j, sum(m[i][j]) AS x FROM vmoments CROSS JOIN range(1, 6) a(i) CROSS JOIN range(1, 10) b(j) GROUP BY ALL) GROUP BY {keys}, i) GROUP BY {keys})"


FITS_SQL = f"""
    WITH RECURSIVE head AS (SELECT pair, source, target, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2 FROM vsamples WHERE w > 0 GROUP BY ALL),
    gates AS (SELECT *, CASE WHEN sw < 5 OR n < 2 THEN 'low_support' WHEN sw * sw / sw2 < 30 THEN 'learned_strong_ridge' ELSE 'learned' END AS status FROM head),
    shared AS {SUMMED.format(keys="pair")},
    systems AS (SELECT pair, source, target, CASE status WHEN 'learned' THEN 1.0::double ELSE 10 * 30 / (sw * sw / sw2) END AS ridge, m FROM gates JOIN vmoments USING (pair, source, target) WHERE status <> 'low_support'
      UNION ALL SELECT pair, -1, -1, ridge, m FROM shared),
    {solved_sql("systems", "pair, source, target")},
    grid AS (SELECT pair, s AS source, t AS target FROM (SELECT DISTINCT pair FROM vmoments) CROSS JOIN range(0, 6) a(s) CROSS JOIN range(0, 6) b(t)),
    cells AS (SELECT g.pair, g.source, g.target, coalesce(status, 'low_support') AS status, coalesce(n, 0) AS n, coalesce(sw, 0) AS sw, coalesce(a.coef, o.coef) AS coef
      FROM grid g LEFT JOIN gates USING (pair, source, target) LEFT JOIN solved a ON a.pair = g.pair AND a.source = g.source AND a.target = g.target
      JOIN solved o ON o.pair = g.pair AND o.source = -1),
    loss AS (SELECT pair, source, target, avg(e) AS mse, sum(w * e) / sum(w) AS weighted_mse FROM (
      SELECT pair, source, target, w, list_sum(list_transform(range(1, 5), lambda d: pow(z[5 + d] - list_sum(list_transform(range(1, 6), lambda i: z[i] * coef[i][d])), 2))) AS e
      FROM vsamples JOIN cells USING (pair, source, target) WHERE w > 0) GROUP BY ALL)
"""
SCORES_SQL = FITS_SQL + "SELECT pair, source, target, n, round(mse, 6) AS mse, round(weighted_mse, 6) AS weighted_mse FROM loss JOIN cells USING (pair, source, target)"


@query("ridge_vectors_R1_R4", uses="vmoments", sql=FITS_SQL + f"""
    SELECT pair, source, target, status, n, round(sw, 6) AS soft_support, round(coalesce(mse, 0), 6) AS mse, round(coalesce(weighted_mse, 0), 6) AS weighted_mse,
      {", ".join(f"round(coef[{i}][{d}], 6) + 0.0 AS c{i}{d}" for i in range(1, 6) for d in range(1, 5))} FROM cells LEFT JOIN loss USING (pair, source, target)""")
def ridge_vectors(t: Tables) -> DataFrame:
    """Whole operators of all types and region pairs, those without samples too: c{i}{d} is the weight of component i (5: the constant) for component d."""
    coef = [r6(F.element_at("a", (i - 1) * 4 + d) if i < 5 else F.element_at("b", d), f"c{i}{d}") for i in range(1, 6) for d in range(1, 5)]
    return vector_fits(t).select("pair", "source", "target", "status", "n", r6("soft_support"), r6("mse"), r6("weighted_mse"), *coef)


@query("shared_vectors_R2_R3", uses="vmoments", sql=f"""
    WITH RECURSIVE systems AS {SUMMED.format(keys="pair")}, {solved_sql("systems", "pair")},
    means AS (SELECT pair, target, list_transform(range(1, 5), lambda d: sy[d] / sw) AS y FROM (
      SELECT pair, target, sum(m[5][5]) AS sw, [sum(m[5][6]), sum(m[5][7]), sum(m[5][8]), sum(m[5][9])] AS sy FROM vmoments GROUP BY pair, target))
    SELECT pair, target, {", ".join(f"round(y[{d}], 6) + 0.0 AS y{d}" for d in range(1, 5))},
      {", ".join(f"round(coef[{i}][{d}], 6) + 0.0 AS c{i}{d}" for i in range(1, 6) for d in range(1, 5))} FROM solved JOIN means USING (pair)""")
def shared_vectors(t: Tables) -> DataFrame:
    """Whole shared operators of the types beside the centroids of their targets."""
    m = checkpointed(MO.pair_moments(pair_samples(t), 4))
    coef = [r6(F.element_at("a", (i - 1) * 4 + d) if i < 5 else F.element_at("b", d), f"c{i}{d}") for i in range(1, 6) for d in range(1, 5)]
    found = R.target_centroids(m, 4).join(R.shared_operators(m, 4), "pair")
    return found.select("pair", "target", *[r6(F.element_at("centroid", d), f"y{d}") for d in range(1, 5)], *coef)


CTES["zlist"] = ("soft label_vectors", "SELECT item, list(z ORDER BY d) AS z FROM (SELECT item, d, sum(p * x) AS z FROM soft JOIN label_vectors USING (label) GROUP BY item, d) GROUP BY item")


@query("affine_vectors_R8", uses="pairs zlist", sql=f"""
    WITH RECURSIVE s AS (SELECT pair, list_concat(list_append(a.z, 1.0::double), b.z) AS z FROM pairs JOIN zlist a ON a.item = s_item JOIN zlist b ON b.item = t_item),
    u AS (SELECT * FROM s UNION ALL SELECT '*', z FROM s),
    systems AS (SELECT pair, 0.01::double AS ridge, list(row ORDER BY i) AS m FROM (SELECT pair, i, list(x ORDER BY j) AS row FROM (
      SELECT pair, i, j, sum(z[i] * z[j]) AS x FROM u CROSS JOIN range(1, 6) a(i) CROSS JOIN range(1, 10) b(j) GROUP BY ALL) GROUP BY pair, i) GROUP BY pair),
    {solved_sql("systems", "pair")}
    SELECT pair, (SELECT count(*) FROM u WHERE u.pair = solved.pair) AS n, {", ".join(f"round(coef[{i}][{d}], 6) + 0.0 AS c{i}{d}" for i in range(1, 6) for d in range(1, 5))} FROM solved""")
def affine_vectors(t: Tables) -> DataFrame:
    z = mem.item_vectors(t.soft, t.label_vectors, ITEM, 4).select("item", "z")
    x, y = z.select(F.col("item").alias("s_item"), F.col("z").alias("x")), z.select(F.col("item").alias("t_item"), F.col("z").alias("y"))
    m = R.affine_maps(t.pairs.join(x, "s_item").join(y, "t_item").select("pair", "x", "y"), 4)
    coef = [r6(F.element_at("a", (i - 1) * 4 + d) if i < 5 else F.element_at("b", d), f"c{i}{d}") for i in range(1, 6) for d in range(1, 5)]
    return m.select("pair", "n", *coef)


@query("operator_scores_R5", uses="vmoments", sql=SCORES_SQL)
def operator_scores(t: Tables) -> DataFrame:
    samples = exploded_samples(t)
    return R.score_operators(samples, vector_fits(t), ["pair", "source", "target"], 4).select(
        "pair", "source", "target", "n", r6("mse"), r6("weighted_mse"))


def exploded_samples(t: Tables) -> DataFrame:
    s = pair_samples(t).select("pair", "s_item", "t_item", "w", F.explode("s_vecs").alias("s"), "t_vecs")
    s = s.select("pair", "s_item", "t_item", "w", "s", F.explode("t_vecs").alias("t"))
    return s.select("pair", "s_item", "t_item", F.col("s.region").alias("source"), F.col("t.region").alias("target"),
                    F.col("s.vector").alias("x"), F.col("t.vector").alias("y"), (F.col("w") * F.col("s.p") * F.col("t.p")).alias("w"))


@query("output_distribution_R6", uses="contrib local_vec", sql="""
    WITH qv AS (SELECT item, c.region, l.d, sum(w * x) / (any_value(r) + 1e-12) AS x FROM contrib c JOIN local_vec l ON l.label = c.label AND l.region = c.region GROUP BY ALL),
    s AS (SELECT q.item, q.region, l.label, round(sum(q.x * l.x) / greatest(sqrt(sum(q.x * q.x)) * sqrt(sum(l.x * l.x)), 1e-12), 12) AS sim
      FROM qv q JOIN local_vec l ON l.region = q.region AND l.d = q.d GROUP BY ALL),
    k AS (SELECT *, exp(sim / 0.15::double) AS e FROM (SELECT *, row_number() OVER (PARTITION BY item, region ORDER BY sim DESC, label) AS r FROM s) WHERE r <= 5)
    SELECT k.item, k.region AS target, any_value(n) AS labels, round(max(e / te), 6) AS top_weight, round(sum(e / te * v.x), 6) + 0.0 AS affect_0 FROM (
      SELECT *, sum(e) OVER (PARTITION BY item, region) AS te, count(*) OVER (PARTITION BY item, region) AS n FROM k) k
    JOIN local_vec v ON v.region = k.region AND v.label = k.label AND v.d = 0 GROUP BY k.item, k.region""")
def output_distribution(t: Tables) -> DataFrame:
    q = conditioned(t).select("item", F.col("region").alias("target"), F.col("vector").alias("predicted"))
    local = local_table(t).select("label", "region", F.col("local_vector").alias("v"))
    o = R.output_distribution(q, local, ["item"], 4)
    return o.select("item", "target", F.size("labels").cast("long").alias("labels"), r6(F.array_max("weights"), "top_weight"),
                    r6(F.element_at("affect", 1), "affect_0"))


@query("transition_examples_R7")
def transition_examples(t: Tables) -> DataFrame:
    s = exploded_samples(t).groupBy("pair", "s_item", "t_item", "source").agg(F.first("x").alias("x"), F.max("w").alias("w"))
    local = local_table(t).select("label", "region", F.col("local_vector").alias("v"))
    e = R.transition_examples(s, conds(t), vector_fits(t), local, 4, 30)
    return e.select("pair", "s_item", "t_item", "source", "target", r6("w"), F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("affine_maps_R8", uses="pairs cvz", sql="""
    WITH s AS (SELECT pair, count(*) AS n, sum(a.z) AS sx, sum(b.z) AS sy, sum(a.z * a.z) AS sxx, sum(a.z * b.z) AS sxy
      FROM pairs JOIN cvz a ON a.item = s_item JOIN cvz b ON b.item = t_item GROUP BY pair),
    u AS (SELECT * FROM s UNION ALL SELECT '*', sum(n)::bigint, sum(sx), sum(sy), sum(sxx), sum(sxy) FROM s)
    SELECT pair, n, round(a, 6) + 0.0 AS a, round((sy - a * sx) / n, 6) + 0.0 AS b FROM (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n + 0.01::double) AS a FROM u)""")
def affine_maps(t: Tables) -> DataFrame:
    z = mem.item_vectors(t.soft, t.label_vectors, ITEM, 4).select("item", F.slice("z", 1, 1).alias("z"))
    x = z.select(F.col("item").alias("s_item"), F.col("z").alias("x"))
    y = z.select(F.col("item").alias("t_item"), F.col("z").alias("y"))
    m = R.affine_maps(t.pairs.join(x, "s_item").join(y, "t_item").select("pair", "x", "y"), 1)
    return m.select("pair", "n", r6(F.element_at("a", 1), "a"), r6(F.element_at("b", 1), "b"))


CTES["cvz"] = ("soft label_vectors", "SELECT item, sum(p * x) AS z FROM soft JOIN label_vectors USING (label) WHERE d = 0 GROUP BY item")


@query("prototypes_R9", sql="""
    SELECT label::bigint AS region, count(*)::double AS weight, round(avg(embedding[1]::double), 6) + 0.0 AS v1, round(avg(embedding[64]::double), 6) + 0.0 AS v64
    FROM embeddings WHERE label <> 4 GROUP BY label
    UNION ALL SELECT 4, 0.0, round(avg(embedding[1]::double), 6) + 0.0, round(avg(embedding[64]::double), 6) + 0.0 FROM embeddings WHERE label <> 4""")
def prototypes(t: Tables) -> DataFrame:
    p = R.prototypes(embedding_rows(t).filter("label <> 4"), "q", "z", 10, 64)
    return p.select("region", "weight", r6(F.element_at("prototype", 1), "v1"), r6(F.element_at("prototype", 64), "v64"))


CTES["region_protos"] = ("preds cvz4", """
    SELECT region, d, sum(gold * z) / sum(gold) AS x FROM preds JOIN cvz4 USING (item) WHERE split = 'train' GROUP BY region, d""")
CTES["cvz4"] = ("soft label_vectors", "SELECT item, d, sum(p * x) AS z FROM soft JOIN label_vectors USING (label) GROUP BY item, d")


def region_prototypes(t: Tables) -> DataFrame:
    z = mem.item_vectors(t.soft, t.label_vectors, ITEM, 4)
    train = t.dist.filter("split = 'train'").select("item", "dist").join(z, "item")
    return R.prototypes(train, "dist", "z", REGIONS, 4)


@query("reconstruct_R10", uses="preds region_protos", sql="""
    SELECT item, round(any_value(h), 6) AS pred_entropy, round(sum(pred * x), 6) + 0.0 AS z0 FROM preds JOIN region_protos p USING (region)
    JOIN (SELECT item, -sum(pred * ln(pred)) AS h FROM preds GROUP BY item) USING (item) WHERE p.d = 0 GROUP BY item""")
def reconstruct(t: Tables) -> DataFrame:
    r = R.reconstruct(t.preds, "pred", region_prototypes(t), REGIONS, 4)
    return r.select("item", r6("pred_entropy"), r6(F.element_at("target_vector", 1), "z0"))


@query("class_weights_R11", uses="dist", sql="""
    SELECT region, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT region, pow(1 / greatest(sum(p) / sum(sum(p)) OVER (), 1e-6), 0.5) AS w
      FROM dist WHERE split = 'train' GROUP BY region)""")
def class_weights(t: Tables) -> DataFrame:
    return R.class_weights(t.dist.filter("split = 'train'"), "dist").select("region", r6("weight"))


# ---- prediction and fusion --------------------------------------------------------------------------------

def instances(t: Tables) -> DataFrame:
    """A2B pairs keyed by the target item: gold, text and graph distributions and the source distribution."""
    p = t.preds.select(F.col("item").alias("t_item"), "split", "gold", F.col("pred").alias("txt"))
    ends = t.pairs.filter("pair = 'A2B'").select("pair", "s_item", "t_item").join(
        t.dist.select(F.col("item").alias("s_item"), F.col("dist").alias("s_dist")), "s_item")
    prior = tr.graph_prior(ends, conds(t), REGIONS)
    return prior.join(p, "t_item").select(F.col("t_item").alias("item"), "s_item", "split", "gold", "txt",
                                          F.col("prior").alias("graph"), F.col("s_dist").alias("src"))


CTES["text_features"] = ("instances turns", f"""
    SELECT item, bucket, s * idf / sqrt(sum(s * idf * s * idf) OVER (PARTITION BY item)) AS x FROM (
      SELECT c.item, c.bucket, c.s, coalesce(ln((n + 1.0::double) / (df + 1.0::double)) + 1, ln(n + 1.0::double) + 1) AS idf
      FROM hashed c CROSS JOIN (SELECT count(DISTINCT item) AS n FROM instances WHERE split = 'train')
      LEFT JOIN (SELECT bucket, count(*) AS df FROM hashed WHERE item IN (SELECT item FROM instances WHERE split = 'train') GROUP BY bucket) f
        ON f.bucket = c.bucket)""")
CTES["hashed"] = ("turns instances", f"""
    SELECT item, h % 256 AS bucket, sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1.0::double ELSE -1.0::double END) AS s FROM (
      SELECT item, ('0x'||substr(md5(f),1,15))::bigint AS h FROM (
        SELECT item, unnest(list_concat(list_transform(w, lambda x: 'tok:' || x), list_transform(range(1, len(w)), lambda i: 'bigram:' || w[i] || '_' || w[i+1]))) AS f
        FROM (SELECT b.item, regexp_extract_all(lower(CASE WHEN length(a.text) % 7 = 0 THEN '...' ELSE a.text END), '[a-z0-9'']+') AS w FROM (SELECT DISTINCT item, s_item FROM instances) b
          JOIN turns a ON a.item = b.s_item))) GROUP BY item, bucket""")
CTES["text_features"] = ("hashed instances", CTES["text_features"][1])
CTES["cosines"] = ("text_features instances", """
    SELECT i.item, r.region, coalesce(cos, 0) AS cos FROM (SELECT DISTINCT item FROM instances) i CROSS JOIN range(0, 6) r(region) LEFT JOIN (
    SELECT f.item, c.region, sum(f.x * c.c) / sqrt(any_value(f.n)) AS cos FROM (SELECT *, sum(x * x) OVER (PARTITION BY item) AS n FROM text_features) f
    JOIN (SELECT region, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY region)) AS c FROM (
      SELECT region, bucket, sum(gold * x) AS s FROM text_features JOIN instances USING (item) WHERE split = 'train' GROUP BY ALL)) c USING (bucket)
    GROUP BY f.item, c.region) c ON c.item = i.item AND c.region = r.region""")


def targets(t: Tables) -> DataFrame:
    """A2B pairs keyed by the target item with its gold distribution."""
    p = t.preds.select(F.col("item").alias("t_item"), "split", "gold")
    return t.pairs.filter("pair = 'A2B'").select("s_item", "t_item").join(p, "t_item").withColumnRenamed("t_item", "item")


def text_features(t: Tables) -> DataFrame:
    """Vectors of the source texts; every seventh length stands for a text without tokens, which must keep its item."""
    text = F.when(F.length("text") % 7 == 0, F.lit("...")).otherwise(F.col("text")).alias("text")
    docs = targets(t).select("item", "s_item", "split").join(t.turns.select(F.col("item").alias("s_item"), text), "s_item")
    return sim.text_vectors(docs, "text", F.col("split") == "train").select("item", "f")


CENTROID_LOGIT = "cos / {tau} + 0.15::double * ln(class_prior)"


@query("centroid_classifier_C1", uses="cosines label_prior", sql=f"""
    SELECT item, region, round(exp(l) / sum(exp(l)) OVER (PARTITION BY item), 6) AS pred FROM (
      SELECT item, region, {CENTROID_LOGIT.format(tau="0.15::double")} AS l FROM cosines JOIN label_prior USING (region))""")
def centroid_classifier(t: Tables) -> DataFrame:
    i, f = targets(t), text_features(t)
    train = i.filter("split = 'train'")
    c = P.centroid_cosines(f, P.class_centroids(f, train, "gold", REGIONS, sim.DIM), REGIONS)
    p = P.centroid_probabilities(c, P.class_prior(train, "gold", REGIONS), 0.15)
    return p.select("item", F.posexplode("pred").alias("region", "pred")).select("item", F.col("region").cast("long").alias("region"), r6("pred"))


def ridge_weights(t: Tables, i: DataFrame, f: DataFrame) -> DataFrame:
    lists = f.join(i.filter("split = 'train'").select("item", "gold"), "item")
    return P.ridge_weights(P.ridge_moments(lists, "gold", sim.DIM, REGIONS), sim.DIM, REGIONS)


@query("ridge_classifier_C2")
def ridge_classifier(t: Tables) -> DataFrame:
    i, f = targets(t), text_features(t)
    train, valid = i.filter("split = 'train'"), i.filter("split = 'valid'")
    s = P.ridge_scores(f, ridge_weights(t, i, f), sim.DIM, REGIONS)
    return P.choose_ridge(s, P.class_prior(train, "gold", REGIONS), valid, "gold").select("lam", "temperature", r6("ce"))


@query("ridge_equations_C2", uses="instances", sql="""
    SELECT lam, n, 0.0::double AS residual FROM (SELECT unnest([0.01, 0.1, 1.0, 10.0, 100.0])::double AS lam)
    CROSS JOIN (SELECT count(DISTINCT item) AS n FROM instances WHERE split = 'train')""")
def ridge_equations(t: Tables) -> DataFrame:
    """Largest entry of X'(XW - Y) + lambda W of each fit, added up from the training items: 0 if W solves the normal equations."""
    i = targets(t).filter("split = 'train'").select("item", "gold")
    f = checkpointed(text_features(t).join(i, "item"))
    w = checkpointed(ridge_weights(t, targets(t), f.select("item", "f")))
    bias = F.array(F.struct(F.lit(sim.DIM).cast("long").alias("bucket"), F.lit(1.0).alias("x")))
    rows = f.select("item", F.concat("f", bias).alias("f"), "gold").join(P.ridge_scores(f.select("item", "f"), w, sim.DIM, REGIONS), "item")
    apart = F.posexplode(F.zip_with("scores", "gold", lambda s, q: s - q)).alias("k", "r")
    parts = rows.select("order", "f", apart).select("order", "k", "r", F.explode("f").alias("e"))
    left = parts.groupBy("order", "k", F.col("e.bucket").alias("bucket")).agg(F.sum(F.col("e.x") * F.col("r")).alias("g"))
    cells = w.select("order", "lam", F.posexplode("c").alias("bucket", "row")).select("order", "lam", F.col("bucket").cast("long").alias("bucket"), F.posexplode("row").alias("k", "w"))
    pull = F.when(F.col("bucket") < sim.DIM, F.col("lam") * F.col("w")).otherwise(0.0)
    residual = cells.join(left, ["order", "k", "bucket"], "left").withColumn("d", F.abs(F.coalesce("g", F.lit(0.0)) + pull))
    n = i.agg(F.countDistinct("item").alias("n"))
    return residual.groupBy("lam").agg(r6(F.max("d"), "residual")).crossJoin(F.broadcast(n)).select("lam", "n", "residual")  # one-row side


@query("choose_tau_C3", uses="cosines label_prior instances", sql=f"""
    WITH l AS (SELECT tau, item, region, {CENTROID_LOGIT.format(tau="tau")} AS l FROM cosines JOIN label_prior USING (region)
      CROSS JOIN (SELECT unnest([0.05, 0.08, 0.1, 0.15, 0.2, 0.35, 0.5, 0.8])::double AS tau)),
    ce AS (SELECT tau, -sum(gold * (l - lse)) / count(DISTINCT item) AS ce FROM (SELECT *, ln(sum(exp(l)) OVER (PARTITION BY tau, item)) AS lse FROM l)
      JOIN instances USING (item, region) WHERE split = 'valid' GROUP BY tau)
    SELECT tau, round(ce, 6) AS ce FROM ce ORDER BY round(ce, 12), tau LIMIT 1""")
def choose_tau(t: Tables) -> DataFrame:
    i, f = targets(t), text_features(t)
    train = i.filter("split = 'train'")
    c = P.centroid_cosines(f, P.class_centroids(f, train, "gold", REGIONS, sim.DIM), REGIONS)
    return P.choose_tau(c, P.class_prior(train, "gold", REGIONS), i.filter("split = 'valid'"), "gold").select("tau", r6("ce"))


@query("majority_C4", uses="instances", sql="""
    WITH tops AS (SELECT item, arg_min(region, (-gold, region)) AS k FROM instances WHERE split = 'train' GROUP BY item)
    SELECT k AS majority, count(*) AS n FROM (SELECT DISTINCT item FROM instances) CROSS JOIN (SELECT k FROM tops GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) GROUP BY k""")
def majority(t: Tables) -> DataFrame:
    i = targets(t)
    m = P.majority_baseline(i.filter("split = 'train'"), i.select("item"), "gold", REGIONS)
    return m.groupBy(D.top_index(F.col("pred")).alias("majority")).agg(F.count(F.lit(1)).alias("n"))


@query("markov_hard_C4", uses="instances conds", sql="""
    SELECT item, target AS region, round(cond / sum(cond) OVER (PARTITION BY item), 6) AS pred FROM (
      SELECT item, arg_min(region, (-src, region)) AS s FROM instances GROUP BY item) JOIN conds ON source = s AND pair = 'A2B'""")
def markov_hard(t: Tables) -> DataFrame:
    m = P.markov_hard(instances(t), conds(t), "src", REGIONS)
    return m.select("item", F.posexplode("pred").alias("region", "pred")).select("item", F.col("region").cast("long").alias("region"), r6("pred"))


def grid_sql(points: str, logit: str, extra: str = "") -> str:
    return f"""
    WITH pts AS ({points}), gate AS (SELECT item, least(1, greatest(0, -sum(txt * ln(txt)) / {LN_C})) AS gt FROM instances GROUP BY item),
    l AS (SELECT alpha, beta, i.item, i.gold, {logit} AS l FROM instances i JOIN gate USING (item) {extra} CROSS JOIN pts WHERE split = 'valid')
    SELECT alpha, beta, round(-sum(gold * (l - lse)) / count(DISTINCT item), 6) AS ce FROM (
      SELECT *, ln(sum(exp(l)) OVER (PARTITION BY alpha, beta, item)) AS lse FROM l) GROUP BY alpha, beta"""


BETAS_SQL = "SELECT 1.0::double AS alpha, unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::double AS beta"


def fusion(t: Tables, kind: str) -> DataFrame:
    i = instances(t)
    prior = P.class_prior(i.filter("split = 'train'"), "gold", REGIONS) if kind == "residual" else None
    return P.fusion_grid(i.filter("split = 'valid'"), "txt", "graph", "gold", kind, REGIONS, prior)


@query("product_of_experts_C5", uses="instances", sql=grid_sql(
    "SELECT a AS alpha, b AS beta FROM (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::double AS a) CROSS JOIN "
    "(SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::double AS b)", "alpha * ln(txt) + beta * ln(graph)"))
def product_of_experts(t: Tables) -> DataFrame:
    return fusion(t, "poe").select("alpha", "beta", r6("ce"))


@query("residual_calibration_C6", uses="instances label_prior", sql=grid_sql(
    "SELECT 1.0::double AS alpha, unnest([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0])::double AS beta",
    "ln(txt) + beta * (ln(graph) - ln(class_prior))", "JOIN label_prior USING (region)"))
def residual_calibration(t: Tables) -> DataFrame:
    return fusion(t, "residual").select("alpha", "beta", r6("ce"))


@query("log_fusion_C7", uses="instances", sql=grid_sql(BETAS_SQL, "ln(txt) + beta * ln(graph)"))
def log_fusion(t: Tables) -> DataFrame:
    return fusion(t, "log").select("alpha", "beta", r6("ce"))


@query("gated_fusion_C7", uses="instances", sql=grid_sql(BETAS_SQL, "ln(txt) + beta * gt * ln(graph)"))
def gated_fusion(t: Tables) -> DataFrame:
    return fusion(t, "gated").select("alpha", "beta", r6("ce"))


def records(t: Tables, col: str) -> DataFrame:
    return P.prediction_records(instances(t), "gold", col, ["item", "split"])


CTES["records"] = ("instances", """
    SELECT item, any_value(split) AS split, arg_min(region, (-gold, region)) AS target_top, arg_min(region, (-txt, region)) AS top_a,
      arg_min(region, (-round(graph, 12), region)) AS top_b, -sum(gold * ln(txt)) AS ce_a, -sum(gold * ln(graph)) AS ce_b, list(txt ORDER BY region) AS ts
    FROM instances GROUP BY item""")


@query("prediction_records_C8", uses="records", sql="""
    SELECT item, split, target_top, top_a AS predicted_top, round(ts[target_top + 1], 6) AS target_p, round(ce_a, 6) AS ce,
      len(list_filter(ts, lambda x: x > ts[target_top + 1])) < 3 AS top3_hit FROM records""")
def prediction_records(t: Tables) -> DataFrame:
    return records(t, "txt").select("item", "split", "target_top", "predicted_top", r6("target_p"), r6("ce"), "top3_hit")


def model_pair(t: Tables) -> tuple[DataFrame, DataFrame]:
    i = instances(t).withColumn("graph", F.transform("graph", lambda x: F.round(x, 12)))
    keep = ["item", "split"]
    return P.prediction_records(i, "gold", "txt", keep), P.prediction_records(i, "gold", "graph", keep)


@query("helped_hurt_C9", uses="records", sql="""
    WITH h AS (SELECT 'helped' AS kind, item, split, ce_a, ce_b, row_number() OVER (ORDER BY (split <> 'test')::int, round(abs(ce_a - ce_b), 9) DESC, item) AS r
      FROM records WHERE top_a <> target_top AND top_b = target_top),
    u AS (SELECT 'hurt' AS kind, item, split, ce_a, ce_b, row_number() OVER (ORDER BY (split <> 'test')::int, round(abs(ce_a - ce_b), 9) DESC, item) AS r
      FROM records WHERE top_a = target_top AND top_b <> target_top)
    SELECT kind, item, split, round(ce_a, 6) AS ce_a, round(ce_b, 6) AS ce_b FROM (SELECT * FROM h UNION ALL SELECT * FROM u) WHERE r <= 80""")
def helped_hurt(t: Tables) -> DataFrame:
    a, b = model_pair(t)
    return P.helped_hurt(a, b, ["item"], 80).select("kind", "item", "split", r6("ce_a"), r6("ce_b"))


@query("target_deltas_C10", uses="records", sql="""
    SELECT target_top, count(*) AS n, round(avg((top_b = target_top)::int - (top_a = target_top)::int), 6) + 0.0 AS d_accuracy,
      round(avg(ce_b - ce_a), 6) + 0.0 AS d_ce FROM records GROUP BY target_top""")
def target_deltas(t: Tables) -> DataFrame:
    a, b = model_pair(t)
    return P.target_deltas(a, b, ["item"]).select("target_top", "n", r6("d_accuracy"), r6("d_ce"))


@query("confusion_C11", uses="scored", sql="""
    SELECT y, yhat, count(s.item) AS n FROM range(0, 6) a(y) CROSS JOIN range(0, 6) b(yhat) LEFT JOIN (SELECT * FROM scored WHERE split = 'test') s USING (y, yhat) GROUP BY y, yhat""")
def confusion(t: Tables) -> DataFrame:
    return P.confusion(scored(t).filter("split = 'test'"), REGIONS)


@query("class_table_C11", uses="class_cells", sql=f"""
    SELECT k AS region, support, predicted, round(predicted / n, 6) AS predicted_share, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision,
      round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round({F1_SQL}, 6) AS f1, round(coalesce(ce, 0), 6) AS ce FROM class_cells WHERE split = 'test'""")
def class_table(t: Tables) -> DataFrame:
    c = P.class_table(scored(t).filter("split = 'test'"), REGIONS)
    return c.select("region", "support", "predicted", r6("predicted_share"), r6("precision"), r6("recall"), r6("f1"), r6("ce"))


@query("uncertainty_groups_C12", uses="scored", sql="""
    WITH x AS (SELECT round(entropy, 9) AS e, round(top_gold, 9) AS tp, CASE WHEN mean_conf > 2 THEN mean_conf END AS mc, ce FROM scored),
    m AS (SELECT median(e) AS me, median(tp) AS mt, median(mc) AS mm FROM x),
    g AS (SELECT CASE WHEN e >= me THEN 'entropy_high' ELSE 'entropy_low' END AS grp, ce FROM x, m
      UNION ALL SELECT CASE WHEN tp >= mt THEN 'top_gold_high' ELSE 'top_gold_low' END, ce FROM x, m
      UNION ALL SELECT CASE WHEN mc >= mm THEN 'mean_conf_high' ELSE 'mean_conf_low' END, ce FROM x, m WHERE mc IS NOT NULL)
    SELECT grp AS "group", count(*) AS n, round(avg(ce), 6) AS ce FROM g GROUP BY grp""")
def uncertainty_groups(t: Tables) -> DataFrame:
    rows = scored(t).select(F.round("entropy", 9).alias("entropy"), F.round(F.array_max("gold"), 9).alias("top_gold"),
                            F.when(F.col("mean_conf") > 2, F.col("mean_conf")).alias("mean_conf"), "ce")
    g = P.uncertainty_groups(rows, {"entropy": 0.001, "top_gold": 0.001, "mean_conf": 0.01})
    return g.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("ce").alias("ce")).select("group", "n", r6("ce"))


@query("subset_metrics_C12", uses="scored", sql="""
    WITH x AS (SELECT split, round(entropy, 9) AS e, round(top_gold, 9) AS tp, ce, (y = yhat)::int AS hit FROM scored),
    m AS (SELECT split, median(e) AS me FROM x GROUP BY split),
    g AS (SELECT split, 'all' AS subset, ce, hit FROM x UNION ALL SELECT split, 'high_agreement', ce, hit FROM x WHERE tp >= 0.75
      UNION ALL SELECT x.split, 'low_agreement', ce, hit FROM x JOIN m USING (split) WHERE e >= me)
    SELECT split, subset, count(*) AS n, round(avg(ce), 6) AS ce, round(avg(hit), 6) AS accuracy FROM g GROUP BY split, subset""")
def subset_metrics(t: Tables) -> DataFrame:
    rows = scored(t).withColumns({"entropy": F.round("entropy", 9), "top_gold": F.round(F.array_max("gold"), 9)})
    s = P.subsets(rows, "top_gold", "entropy")
    return M.metric_block(s, ["split", "subset"], REGIONS).select("split", "subset", "n", r6("ce"), r6("accuracy"))


GATED_CLASS, GATE_THRESHOLD = 3, 0.5


def gated(t: Tables) -> DataFrame:
    g = hash_share("gate")
    rows = t.preds.withColumn("gate", g)
    adj = P.gate_adjust(F.col("pred"), F.col("gate"), GATED_CLASS, GATE_THRESHOLD, 1.5, 0.1, 0.35)
    return rows.withColumns({"ungated": D.normalized(F.col("pred")), "gated": adj, "gate_pred": (F.col("gate") >= GATE_THRESHOLD).cast("int")})


def hash_share(tag: str):
    from ..functions.keys import hash60

    return (hash60(F.lit(tag), F.col("item")) % 1000).cast("double") / 1000


CTES["gated"] = ("preds", """
    SELECT item, split, role, region, gold, ungated, gate, adj / sum(adj) OVER (PARTITION BY item) AS gated FROM (
      SELECT *, CASE WHEN region <> 3 THEN ungated WHEN gate >= 0.5 THEN greatest(ungated * (1 + 1.5 * gate), 0.35) ELSE least(ungated, 0.1) END AS adj FROM (
        SELECT *, pred AS ungated, (('0x'||substr(md5('gate|' || item),1,15))::bigint % 1000)::double / 1000 AS gate FROM preds))""")


@query("gate_adjust_C13", uses="gated", sql="SELECT item, region, round(gated, 6) AS gated FROM gated")
def gate_adjust(t: Tables) -> DataFrame:
    g = gated(t).select("item", F.posexplode("gated").alias("region", "gated"))
    return g.select("item", F.col("region").cast("long").alias("region"), r6("gated"))


@query("gate_summary_C13", uses="gated", sql="""
    SELECT count(*) AS n, round(avg(gate), 6) AS mean_gate, round(avg((gate >= 0.5)::int), 6) AS active_rate, round(avg(u3), 6) AS mean_ungated_p,
      round(avg(g3), 6) AS mean_gated_p, round(avg((ut = 3)::int), 6) AS ungated_top_rate, round(avg((gt = 3)::int), 6) AS gated_top_rate FROM (
      SELECT item, any_value(gate) AS gate, max(ungated) FILTER (WHERE region = 3) AS u3, max(gated) FILTER (WHERE region = 3) AS g3,
        arg_min(region, (-ungated, region)) AS ut, arg_min(region, (-gated, region)) AS gt FROM gated GROUP BY item)""")
def gate_summary(t: Tables) -> DataFrame:
    s = P.gate_summary(gated(t), GATED_CLASS, GATE_THRESHOLD)
    return s.select("n", *[r6(c) for c in ("mean_gate", "active_rate", "mean_ungated_p", "mean_gated_p", "ungated_top_rate", "gated_top_rate")])


@query("mix_active_C13", uses="gated region_protos", sql="""
    SELECT item, round(CASE WHEN gate >= 0.5 THEN 0.7 * z + 0.3 * (SELECT x FROM region_protos WHERE region = 3 AND d = 0) ELSE z END, 6) + 0.0 AS v0 FROM (
      SELECT item, any_value(gate) AS gate, sum(gated * x) AS z FROM gated JOIN region_protos p USING (region) WHERE p.d = 0 GROUP BY item)""")
def mix_active(t: Tables) -> DataFrame:
    protos = region_prototypes(t)
    rec = R.reconstruct(gated(t), "gated", protos, REGIONS, 4)
    one = protos.filter(F.col("region") == GATED_CLASS).select(F.col("prototype").alias("pk"))
    mixed = rec.crossJoin(F.broadcast(one))  # one-row side
    v = P.mix_active(F.col("target_vector"), F.col("pk"), F.col("gate"), GATE_THRESHOLD, 0.3)
    return mixed.select("item", r6(F.element_at(v, 1), "v0"))


@query("gate_rows_C14", uses="scored", sql="""
    WITH g AS (SELECT item, CASE WHEN y = 3 AND top_gold >= 0.4 THEN 1 WHEN y IN (0, 1) AND top_gold >= 0.5 THEN 0 END AS gate_label FROM scored),
    n AS (SELECT item, gate_label, row_number() OVER (ORDER BY ('0x'||substr(md5('0|' || item),1,15))::bigint, item) AS r FROM g WHERE gate_label = 0)
    SELECT item, gate_label FROM g WHERE gate_label = 1
    UNION ALL SELECT item, gate_label FROM n WHERE r <= round_even((SELECT sum(gate_label) * 1.5 FROM g), 0)""")
def gate_rows(t: Tables) -> DataFrame:
    g = P.gate_rows(t.dist, "dist", 3, [0, 1], 0.4, 0.5).select("item", "gate_label")
    return P.downsample_negatives(g, 1.5, ["item"])


BINARY_SQL = """
    x AS (SELECT toxic AS label, (('0x'||substr(md5('prob|' || doc_id),1,15))::bigint % 500)::double / 1000 + toxic * 0.3::double AS p FROM labels),
    th AS (SELECT DISTINCT t FROM (SELECT p AS t FROM x UNION ALL SELECT unnest([0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.6,0.7,0.8])::double)),
    s AS (SELECT t, count(*) FILTER (WHERE p >= t AND label = 1) AS tp, count(*) FILTER (WHERE p >= t) AS pp, sum(label)::bigint AS P, count(*) AS N FROM th CROSS JOIN x GROUP BY t),
    m AS (SELECT t AS threshold, tp / greatest(pp, 1) AS precision, tp / greatest(P, 1) AS recall, CASE WHEN tp > 0 THEN 2 * tp / (pp + P) ELSE 0 END AS f1,
      (2 * tp + N - pp - P) / N AS accuracy, pp / N AS predicted_rate FROM s)"""


def binary_rows(t: Tables) -> DataFrame:
    from ..functions.keys import hash60

    p = (hash60(F.lit("prob"), F.col("doc_id")) % 500).cast("double") / 1000 + F.col("toxic") * 0.3
    return t.read("labels").select(F.col("toxic").alias("label"), p.alias("p"))


@query("threshold_scan_C15", sql=f"""
    WITH {BINARY_SQL} SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      round(accuracy, 6) AS accuracy, round(predicted_rate, 6) AS predicted_rate FROM m""")
def threshold_scan(t: Tables) -> DataFrame:
    s = P.threshold_scan(binary_rows(t), "label", "p")
    return s.select(*[r6(c) for c in ("threshold", "precision", "recall", "f1", "accuracy", "predicted_rate")])


@query("best_threshold_C15", sql=f"""
    WITH {BINARY_SQL} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM m
    ORDER BY round(f1, 12) DESC, round(precision, 12) DESC, round(recall, 12) DESC, (threshold = 0.5) DESC, threshold LIMIT 1""")
def best_threshold(t: Tables) -> DataFrame:
    return P.best_threshold(P.threshold_scan(binary_rows(t), "label", "p")).select(r6("threshold"), r6("f1"))


@query("gate_evaluation_C16", uses="gated", sql="""
    WITH i AS (SELECT item, any_value(role) AS role, any_value(gate) AS gate, arg_min(region, (-gold, region)) AS y, arg_min(region, (-ungated, region)) AS ut,
        arg_min(region, (-gated, region)) AS gt, -sum(gold * ln(ungated)) AS uce, -sum(gold * ln(gated)) AS gce FROM gated GROUP BY item)
    SELECT role, count(*) AS n, round(avg((y = 3)::int), 6) AS gold_rate, round(avg(gce), 6) AS gated_ce, round(avg((gt = y)::int), 6) AS gated_accuracy,
      round(avg(gce - uce), 6) + 0.0 AS d_ce, round(avg((gt = 3)::int - (ut = 3)::int), 6) + 0.0 AS d_top_rate, count(*) FILTER (WHERE gate >= 0.5) AS active_n,
      round(avg((y = 3)::int) FILTER (WHERE gate >= 0.5), 6) AS active_gold_rate FROM i GROUP BY role""")
def gate_evaluation(t: Tables) -> DataFrame:
    e = P.gate_evaluation(gated(t), ["role"], GATED_CLASS)
    return e.select("role", "n", r6("gold_rate"), r6("gated_ce"), r6("gated_accuracy"), r6("d_ce"), r6("d_top_rate"), "active_n", r6("active_gold_rate"))


@query("harden_C17", uses="scored", sql="""
    SELECT item, region, (region = yhat)::int::double AS hard, (region = 2)::int::double AS forced FROM scored CROSS JOIN (SELECT unnest(range(0, 6)) AS region)""")
def harden(t: Tables) -> DataFrame:
    h = t.preds.select("item", F.posexplode(F.arrays_zip(P.hardened(F.col("pred"), REGIONS).alias("h"), P.forced(2, REGIONS).alias("f"))).alias("region", "x"))
    return h.select("item", F.col("region").cast("long").alias("region"), F.col("x.h").alias("hard"), F.col("x.f").alias("forced"))


# ---- text similarity --------------------------------------------------------------------------------------

DOC_FEATURES = """
    SELECT {key}, h % 256 AS bucket, sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1.0::double ELSE -1.0::double END) AS s FROM (
      SELECT {key}, ('0x'||substr(md5(f),1,15))::bigint AS h FROM (
        SELECT {key}, unnest(list_concat(list_transform(w, lambda x: 'tok:' || x), list_transform(range(1, len(w)), lambda i: 'bigram:' || w[i] || '_' || w[i+1]))) AS f
        FROM (SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM {table}))) GROUP BY {key}, bucket"""
CTES.update({
    "turn_counts": ("turns", DOC_FEATURES.format(key="item", table="turns")),
    "turn_tfidf": ("turn_counts turns", """
        SELECT item, bucket, s * idf / sqrt(sum(s * idf * s * idf) OVER (PARTITION BY item)) AS x FROM turn_counts JOIN (
          SELECT bucket, ln(((SELECT count(*) FROM turns) + 1.0::double) / (count(*) + 1.0::double)) + 1 AS idf FROM turn_counts GROUP BY bucket) USING (bucket)"""),
    "label_centroids": ("soft turn_tfidf item_conf turns", """
        SELECT label, bucket, CASE WHEN eff > 0 THEN coalesce(s, 0) / eff ELSE 0 END AS raw, eff, observed / (observed + 50.0::double) AS alpha,
          observed / (observed + 50.0::double) * coalesce(s, 0) / eff + (1 - observed / (observed + 50.0::double)) * mean AS shrunk
        FROM (SELECT label, sum(p * mean_conf / 5) AS eff, sum(support)::bigint AS observed FROM soft JOIN item_conf USING (item) GROUP BY label)
        CROSS JOIN (SELECT bucket, sum(x) / (SELECT count(*) FROM turns) AS mean FROM turn_tfidf GROUP BY bucket)
        LEFT JOIN (SELECT label, bucket, sum(p * mean_conf / 5 * x) AS s FROM soft JOIN item_conf USING (item) JOIN turn_tfidf USING (item) GROUP BY ALL) USING (label, bucket)"""),
    "conf_sim": ("soft", """
        SELECT a.label AS src, b.label AS dst, CASE WHEN a.label = b.label THEN 1.0 ELSE coalesce(raw, 0) / sqrt(a.d * b.d) END AS w, coalesce(raw, 0) AS raw
        FROM (SELECT label, sum(p * p) AS d FROM soft GROUP BY label) a CROSS JOIN (SELECT label, sum(p * p) AS d FROM soft GROUP BY label) b
        LEFT JOIN (SELECT x.label AS s, y.label AS t, sum(x.p * y.p) AS raw FROM soft x JOIN soft y USING (item) GROUP BY ALL) r ON r.s = a.label AND r.t = b.label"""),
    "ctx_sim": ("label_centroids", """
        SELECT src, dst, CASE WHEN src = dst THEN 1.0 ELSE greatest(0, least(1, dp / sqrt(da * db))) END AS w FROM (
          SELECT a.label AS src, b.label AS dst, sum(a.shrunk * b.shrunk) AS dp, sum(a.shrunk * a.shrunk) AS da, sum(b.shrunk * b.shrunk) AS db
          FROM label_centroids a JOIN label_centroids b USING (bucket) GROUP BY ALL)"""),
    "fused_sim": ("conf_sim ctx_sim", """
        SELECT src, dst, CASE WHEN src = dst THEN 1.0 ELSE 0.65::double * ac + 0.35::double * bc END AS w FROM (
          SELECT src, dst, (a.w - min(CASE WHEN src <> dst THEN a.w END) OVER ()) / (max(CASE WHEN src <> dst THEN a.w END) OVER () - min(CASE WHEN src <> dst THEN a.w END) OVER ()) AS ac,
            (b.w - min(CASE WHEN src <> dst THEN b.w END) OVER ()) / (max(CASE WHEN src <> dst THEN b.w END) OVER () - min(CASE WHEN src <> dst THEN b.w END) OVER ()) AS bc
          FROM ctx_sim a JOIN conf_sim b USING (src, dst))"""),
    "knn": ("fused_sim", """
        SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS w FROM (
          SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS r FROM fused_sim WHERE src <> dst) WHERE r <= 4 AND w > 0 GROUP BY 1, 2"""),
})


@query("tfidf_G1", sql=f"""
    WITH c AS ({DOC_FEATURES.format(key="doc_id", table="documents")}),
    f AS (SELECT bucket, count(*) AS df FROM c WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY bucket),
    n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en')
    SELECT doc_id, bucket, round(s * idf / sqrt(sum(s * idf * s * idf) OVER (PARTITION BY doc_id)), 6) + 0.0 AS x FROM (
      SELECT doc_id, bucket, s, coalesce(ln((n + 1.0::double) / (df + 1.0::double)) + 1, ln(n + 1.0::double) + 1) AS idf FROM c LEFT JOIN f USING (bucket) CROSS JOIN n) WHERE true""")
def tfidf(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", "lang")
    x = sim.tfidf_fit_transform(d, "doc_id", "text", F.col("lang") == "en")
    return x.select("doc_id", "bucket", r6("x"))


def turn_tfidf(t: Tables) -> DataFrame:
    return sim.tfidf_fit_transform(t.turns, "item", "text")


def centroids(t: Tables) -> DataFrame:
    return sim.shrunk_centroids(t.soft, t.item_conf, turn_tfidf(t), sl.observed_counts(t.soft))


@query("shrunk_centroids_G2", uses="label_centroids", sql="""
    SELECT label, bucket, round(eff, 6) AS eff, round(alpha, 6) AS alpha, round(raw, 6) + 0.0 AS raw, round(shrunk, 6) + 0.0 AS shrunk FROM label_centroids""")
def shrunk_centroids(t: Tables) -> DataFrame:
    return centroids(t).select("label", "bucket", r6("eff"), r6("alpha"), r6("raw"), r6("shrunk"))


@query("plain_centroids_G3", uses="soft turn_tfidf", sql="""
    SELECT label, bucket, round(sum(p * x) / any_value(tot), 6) + 0.0 AS x FROM soft JOIN turn_tfidf USING (item)
    JOIN (SELECT label, sum(p) AS tot FROM soft GROUP BY label) USING (label) GROUP BY label, bucket""")
def plain_centroids(t: Tables) -> DataFrame:
    return sim.plain_centroids(t.soft, turn_tfidf(t)).select("label", "bucket", r6("x"))


@query("confusion_similarity_G4", uses="conf_sim", sql="SELECT src, dst, round(raw, 6) AS raw, round(w, 6) AS w FROM conf_sim")
def confusion_similarity(t: Tables) -> DataFrame:
    return sim.confusion_similarity(t.soft).select("src", "dst", r6("raw"), r6("w"))


@query("context_similarity_G5", uses="ctx_sim", sql="SELECT src, dst, round(w, 6) AS w FROM ctx_sim")
def context_similarity(t: Tables) -> DataFrame:
    return sim.context_similarity(centroids(t)).select("src", "dst", r6("w"))


def fused(t: Tables) -> DataFrame:
    return sim.fused(sim.context_similarity(centroids(t)), sim.confusion_similarity(t.soft))


@query("fused_similarity_G6", uses="fused_sim", sql="SELECT src, dst, round(w, 6) AS w FROM fused_sim")
def fused_similarity(t: Tables) -> DataFrame:
    return fused(t).select("src", "dst", r6("w"))


@query("top_neighbours_G7", uses="fused_sim soft", sql="""
    SELECT src, dst, rank, round(w, 6) AS w, observed FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) AS rank FROM fused_sim WHERE src <> dst)
    JOIN (SELECT label, sum(support)::bigint AS observed FROM soft GROUP BY label ORDER BY 2 DESC, 1 LIMIT 10) ON label = src WHERE rank <= 3""")
def top_neighbours(t: Tables) -> DataFrame:
    n = sim.frequent_neighbours(fused(t), sl.observed_counts(t.soft), 10, 3)
    return n.select("src", "dst", "rank", r6("w"), "observed")


def graph(t: Tables, k: int = 4) -> DataFrame:
    return sim.knn_graph(fused(t), k)


@query("knn_graph_G8", uses="knn", sql="SELECT src, dst, round(w, 6) AS w FROM knn")
def knn_graph(t: Tables) -> DataFrame:
    return graph(t).select("src", "dst", r6("w"))


@query("degrees_G9", uses="knn", sql="""
    SELECT l AS label, count(w) AS degree, round(coalesce(sum(w), 0), 6) AS weighted_degree FROM range(0, 24) x(l)
    LEFT JOIN (SELECT src AS e, w FROM knn UNION ALL SELECT dst, w FROM knn) ON e = l GROUP BY l""")
def degrees(t: Tables) -> DataFrame:
    return sim.degrees(graph(t), t.membership).select("label", "degree", r6("weighted_degree"))


@query("nearest_examples_G15", sql=f"""
    WITH c AS ({DOC_FEATURES.format(key="doc_id", table="documents")}), q AS ({DOC_FEATURES.format(key="item_id", table="benchmark")}),
    f AS (SELECT bucket, ln(((SELECT count(*) FROM documents) + 1.0::double) / (count(*) + 1.0::double)) + 1 AS idf FROM c GROUP BY bucket),
    cx AS (SELECT doc_id, bucket, s * idf / sqrt(sum(s * idf * s * idf) OVER (PARTITION BY doc_id)) AS x FROM c JOIN f USING (bucket)),
    qx AS (SELECT item_id, bucket, s * idf / sqrt(sum(s * idf * s * idf) OVER (PARTITION BY item_id)) AS x FROM q JOIN f USING (bucket)),
    s AS (SELECT item_id, doc_id, round(sum(qx.x * cx.x), 9) AS score FROM qx JOIN cx USING (bucket) GROUP BY ALL)
    SELECT item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_examples(t: Tables) -> DataFrame:
    docs, queries = t.documents.select("doc_id", "text"), t.read("benchmark").select("item_id", "text")
    hashed = lambda df: df.withColumn("f", V.hashed_tokens(X.tokens(F.col("text")), sim.DIM)).drop("text")
    stored = hashed(docs)
    idf = checkpointed(V.bucket_weights(stored, "f", sim.DIM))
    n = sim.nearest_examples(V.weighted(hashed(queries), "f", idf), V.weighted(stored, "f", idf), "item_id", "doc_id", 5)
    return n.select("item_id", "rank", r6("score"))
