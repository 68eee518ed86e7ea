"""Queries for the regions of the label graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed
from ..operators import graph as G
from ..operators import membership as mem
from ..operators import spectral as SP
from .fixtures import CTES, LABELS, Tables, r6
from .model_queries import fused, graph
from .registry import query

CTES["solutions"] = ("knn", """
    SELECT 'mod' || k AS solution, 1.0::double AS resolution, l AS label, l % k AS c FROM range(0, 24) x(l) CROSS JOIN range(3, 14) y(k)""")
CTES["qualities"] = ("solutions knn", """
    SELECT solution, sum(l / m - pow(d / (2 * m), 2)) AS modularity FROM (
      SELECT s.solution, s.c, (SELECT sum(w) FROM knn) AS m, coalesce(sum(w) FILTER (WHERE o.c = s.c), 0) / 2 AS l, sum(w) AS d
      FROM (SELECT src AS v, dst AS u, w FROM knn UNION ALL SELECT dst, src, w FROM knn) e JOIN solutions s ON s.label = e.v JOIN solutions o ON o.label = e.u AND o.solution = s.solution
      GROUP BY s.solution, s.c) GROUP BY solution""")
CTES["sol_summary"] = ("solutions qualities", """
    SELECT solution, count(*) AS regions, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest, min(n) AS smallest, any_value(modularity) AS modularity
    FROM (SELECT solution, c, count(*) AS n FROM solutions GROUP BY ALL) JOIN qualities USING (solution) GROUP BY solution""")


def solutions(t: Tables) -> DataFrame:
    labels = t.membership.select("label").distinct()
    ks = F.explode(F.sequence(F.lit(3), F.lit(13))).alias("k")
    return labels.select("label", ks).select(F.concat(F.lit("mod"), "k").alias("solution"), F.lit(1.0).alias("resolution"), "label", (F.col("label") % F.col("k")).alias("region"))


@query("modularity_G10", uses="qualities", sql="SELECT solution, round(modularity, 6) + 0.0 AS modularity FROM qualities")
def modularity(t: Tables) -> DataFrame:
    s = solutions(t).withColumnRenamed("region", "c")
    return G.modularity(graph(t), s, 1.0, ["solution"]).select("solution", r6("modularity"))


@query("communities_G11")
def communities(t: Tables) -> DataFrame:
    return G.community_scan(graph(t), t.membership).select("solution", "label", "region")


# Cells of the recomputed modularity need the assignment, which SQL can't find; what SQL states is what must hold of any.
@query("community_checks_G11", uses="knn membership", sql="""
    SELECT 'resolution=' || r AS solution, (SELECT count(DISTINCT label) FROM membership) AS labels, 0 AS doubled, 0 AS gaining, true AS beats_alone
    FROM (VALUES ('0.4'), ('0.6'), ('0.8'), ('1.0'), ('1.2'), ('1.4'), ('1.6')) x(r)""")
def community_checks(t: Tables) -> DataFrame:
    """Labels placed, labels placed twice, labels that gain by a move to any community or to one of their own, and whether the modularity beats that of single labels."""
    e = checkpointed(graph(t))
    placed = checkpointed(G.communities(e, t.membership.select("label"), G.RESOLUTIONS))
    gains = G.move_gains(e, placed)
    alone = placed.select("resolution", "label", F.col("label").alias("c"))
    q = lambda a, n: G.modularity(e, a, F.col("resolution"), ["resolution"]).withColumnRenamed("modularity", n)
    counts = placed.groupBy("resolution").agg(F.countDistinct("label").alias("labels"), (F.count(F.lit(1)) - F.countDistinct("label")).cast("int").alias("doubled"))
    wins = gains.groupBy("resolution").agg(F.sum((F.col("gain") > 1e-9).cast("int")).cast("int").alias("gaining"))
    return counts.join(wins, "resolution").join(q(placed, "q"), "resolution").join(q(alone, "one"), "resolution").select(
        F.concat(F.lit("resolution="), F.col("resolution").cast("string")).alias("solution"), "labels", "doubled", "gaining", (F.col("q") > F.col("one")).alias("beats_alone"))


@query("spectral_G12")
def spectral(t: Tables) -> DataFrame:
    return G.spectral_scan(fused(t)).select("solution", "label", "region")


@query("spectral_residuals_G12", sql="SELECT i AS component, 0.0::double AS residual, 1.0::double AS norm FROM range(1, 17) x(i)")
def spectral_residuals(t: Tables) -> DataFrame:
    """Largest |N x - value x| over the labels, and the length, of each of the 16 leading eigenvectors."""
    rows, values = SP.eigenvectors(fused(t), max(G.SPECTRAL_SIZES))
    x = checkpointed(rows.select("label", F.posexplode("x").alias("i", "x")))
    image = SP.normalised(fused(t)).join(x.select(F.col("label").alias("dst"), "i", "x"), "dst").groupBy(F.col("src").alias("label"), "i").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    own = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("i") + 1)
    both = x.join(image, ["label", "i"], "left").withColumn("e", F.abs(F.coalesce("y", F.lit(0.0)) - own * F.col("x")))
    return both.groupBy((F.col("i") + 1).cast("long").alias("component")).agg(r6(F.max("e"), "residual"), r6(F.sqrt(F.sum(F.col("x") * F.col("x"))), "norm"))


@query("spectral_moments_G12", uses="fused_sim", sql="""
    WITH a AS (SELECT src, dst, w FROM fused_sim WHERE src <> dst AND w > 0), d AS (SELECT src, sum(w) AS d FROM a GROUP BY src),
    n AS (SELECT a.src, a.dst, w / sqrt(p.d * q.d) AS w FROM a JOIN d p ON p.src = a.src JOIN d q ON q.src = a.dst),
    nn AS (SELECT x.src, y.dst, sum(x.w * y.w) AS w FROM n x JOIN n y ON x.dst = y.src GROUP BY ALL)
    SELECT power, round(trace, 6) + 0.0 AS trace FROM (SELECT 1 AS power, 0.0::double AS trace UNION ALL SELECT 2, sum(w * w) FROM n
      UNION ALL SELECT 3, sum(x.w * y.w) FROM nn x JOIN n y ON x.src = y.src AND x.dst = y.dst UNION ALL SELECT 4, sum(w * w) FROM nn)""")
def spectral_moments(t: Tables) -> DataFrame:
    """Sums of the first four powers of all eigenvalues: the traces of the powers of N, if none is missing."""
    _, values = SP.eigenvectors(fused(t), LABELS)
    return t.spark.createDataFrame([(p, float(sum(values**p))) for p in range(1, 5)], "power int, trace double").select("power", r6("trace"))


@query("spectral_centres_G12", uses="fused_sim", sql="""
    SELECT 'K=' || k AS solution, label, 0.0::double AS excess FROM range(6, 17) y(k) CROSS JOIN (SELECT DISTINCT src AS label FROM fused_sim)""")
def spectral_centres(t: Tables) -> DataFrame:
    """How much farther than the nearest centre each label's own centre is, centres being the means of the regions."""
    rows = checkpointed(SP.spectral_regions(fused(t), G.SPECTRAL_SIZES))
    cell = rows.select("k", "c", F.posexplode("x").alias("d", "x")).groupBy("k", "c", "d").agg(F.avg("x").alias("m"))
    centres = cell.groupBy("k", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    apart = F.aggregate(F.zip_with("x", "m", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    met = rows.withColumnRenamed("c", "own").join(centres, "k").withColumn("a", apart)  # regions of a size: at most 16
    gap = F.sum(F.when(F.col("own") == F.col("c"), F.col("a"))) - F.min("a")
    return met.groupBy(F.concat(F.lit("K="), F.col("k").cast("string")).alias("solution"), "label").agg(r6(gap, "excess"))


@query("solution_summary_G13", uses="sol_summary", sql="SELECT solution, regions, singletons, largest, smallest, round(modularity, 6) + 0.0 AS modularity FROM sol_summary")
def solution_summary(t: Tables) -> DataFrame:
    s = G.solution_summary(graph(t), solutions(t))
    return s.select("solution", "regions", "singletons", "largest", "smallest", r6("modularity"))


@query("choose_solutions_G13", uses="sol_summary", sql="""
    SELECT solution, round(score, 6) + 0.0 AS score FROM (SELECT *, 0.5 * modularity - 2.0 * singletons / 24 - abs(regions - 6) / 6 - greatest(0, 5 - regions) * 0.25
      - greatest(0, largest / 24 - 0.35) * 2 AS score FROM sol_summary) ORDER BY round(score, 12) DESC, singletons, regions, solution LIMIT 3""")
def choose_solutions(t: Tables) -> DataFrame:
    return G.choose_solutions(G.solution_summary(graph(t), solutions(t)), 24).select("solution", r6("score"))


@query("solution_pool_G13", uses="sol_summary", sql="""
    SELECT solution, round(score, 6) + 0.0 AS score FROM (SELECT *, 0.5 * modularity - 2.0 * singletons / 24 - abs(regions - 6) / 6 - greatest(0, 5 - regions) * 0.25
      - greatest(0, largest / 24 - 0.35) * 2 AS score FROM sol_summary WHERE regions % 2 = 1) ORDER BY round(score, 12) DESC, singletons, regions, solution LIMIT 3""")
def solution_pool(t: Tables) -> DataFrame:
    """The pool rule: solutions with an odd number of regions stand for communities, so only they are chosen from."""
    method = F.when(F.col("regions") % 2 == 1, "community").otherwise("spectral")
    return G.choose_solutions(G.solution_summary(graph(t), solutions(t)).withColumn("method", method), 24).select("solution", r6("score"))


@query("spanning_trees_G14", uses="fused_sim membership", sql="""
    WITH RECURSIVE own AS (SELECT label, arg_min(region, (-m, region)) AS region FROM membership GROUP BY label),
    e AS (SELECT row_number() OVER (ORDER BY round(w, 9) DESC, src, dst) AS id, a.region, src, dst, w FROM fused_sim JOIN own a ON a.label = src JOIN own b ON b.label = dst WHERE src < dst AND a.region = b.region),
    reach(id, node) AS (SELECT id, src FROM e UNION SELECT r.id, CASE WHEN x.src = r.node THEN x.dst ELSE x.src END FROM reach r JOIN e x ON x.id < r.id AND (x.src = r.node OR x.dst = r.node))
    SELECT region, src, dst, round(w, 6) AS w FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.id = e.id AND r.node = e.dst)""")
def spanning_trees(t: Tables) -> DataFrame:
    affinity = fused(t).withColumn("w", F.round("w", 9))
    return G.spanning_trees(affinity, mem.top_region(t.membership)).select("region", "src", "dst", r6("w"))
