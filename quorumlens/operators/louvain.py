"""Communities of the label graph by multilevel moves (G11), all resolutions together.

A graph of one resolution is `resolution, v, u, w` in both directions (v = u holds the weight inside a contracted vertex, counted twice), with
vertices in blocks by a hash; how many blocks there are follows from the number of vertices.  In a round a block gets
its edges, with the community of every neighbour and the size of that community, and moves its vertices one after the other until
none gains; other blocks stand still in its view.  With one block that is exact.  With several a round may lose, since
they move at once: it counts for a resolution only if its modularity rises, else fewer blocks move at a time, in the end one, whose
gain is exact.  When no block gains, communities become the vertices of a smaller graph, and the same is done there.  The
result of the last level is tried once more on the labels, until no label gains by a move.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written

# Vertices of a block.
VERTICES = 4096
EPS = 1e-12


def _sweep(key: tuple, table: pa.Table) -> pa.Table:
    """Moves the vertices of one block, in the order of their ids, until a whole pass moves none."""
    resolution = key[0].as_py()
    v, u, w, c, d, k, m = (table.column(n).to_numpy() for n in ("v", "u", "w", "c", "d", "k", "m"))
    order = np.lexsort((u, v))
    v, u, w, c, d, k = (x[order] for x in (v, u, w, c, d, k))
    scale = resolution / (2.0 * float(m[0]))
    ids, firsts = np.unique(v, return_index=True)
    ends = np.append(firsts[1:], len(v))
    own, size, degree = {}, {}, dict(zip(ids.tolist(), k[firsts].tolist(), strict=True))
    for uu, cc, dd in zip(u.tolist(), c.tolist(), d.tolist(), strict=True):
        own[uu] = cc
        size.setdefault(cc, dd)
    neighbours = {i: list(zip(u[a:b].tolist(), w[a:b].tolist(), strict=True)) for i, a, b in zip(ids.tolist(), firsts.tolist(), ends.tolist(), strict=True)}
    moved = True
    while moved:
        moved = False
        for i in ids.tolist():
            here, degree_i = own[i], degree[i]
            links: dict = {}
            for j, weight in neighbours[i]:
                if j != i:
                    links[own[j]] = links.get(own[j], 0.0) + weight
            size[here] -= degree_i
            stay = links.get(here, 0.0) - scale * degree_i * size[here]
            best, gain = here, round(stay, 12)
            for other in sorted(links):
                value = round(links[other] - scale * degree_i * size[other], 12)
                if value > gain + EPS:
                    best, gain = other, value
            if 0.0 > gain + EPS:
                best = -1 - i  # a community of its own
            size[best] = size.get(best, 0.0) + degree_i
            if best != here:
                own[i], moved = best, True
    return pa.table({"resolution": pa.array([resolution] * len(ids)), "v": pa.array(ids), "c": pa.array([own[i] for i in ids.tolist()], pa.int64())})


def _degrees(graph: DataFrame) -> DataFrame:
    return graph.groupBy("resolution", "v").agg(F.sum("w").alias("k"))


def _named(placed: DataFrame) -> DataFrame:
    """resolution, v, c with the least vertex of each community as its name."""
    least = placed.groupBy("resolution", "c").agg(F.min("v").alias("_name"))
    return placed.join(least, ["resolution", "c"]).select("resolution", "v", F.col("_name").alias("c"))


def _scores(graph: DataFrame, placed: DataFrame, degrees: DataFrame, m: float) -> dict[float, float]:
    """Modularity of each resolution."""
    at = lambda n: placed.select("resolution", F.col("v").alias(n), F.col("c").alias(f"_{n}"))
    inside = graph.join(at("v"), ["resolution", "v"]).join(at("u"), ["resolution", "u"]).filter("_v = _u").groupBy("resolution").agg(F.sum("w").alias("x"))
    size = placed.join(degrees, ["resolution", "v"]).groupBy("resolution", "c").agg(F.sum("k").alias("d"))
    spread = size.groupBy("resolution").agg(F.sum(F.col("d") * F.col("d")).alias("y"))
    rows = spread.join(inside, "resolution", "left").collect()  # a row for each resolution
    return {r["resolution"]: (r["x"] or 0.0) / (2 * m) - r["resolution"] * r["y"] / (4 * m * m) for r in rows}


def _moves(graph: DataFrame, degrees: DataFrame, placed: DataFrame, m: float) -> tuple[DataFrame, set[float]]:
    """Communities (resolution, v, c) after moves that no single block can better, and the resolutions that changed."""
    counts = {r["resolution"]: r["n"] for r in degrees.groupBy("resolution").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {r: -(-n // VERTICES) for r, n in counts.items()}
    block_count = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    score = _scores(graph, placed, degrees, m)
    open_to, changed, colours = set(score), set(), dict.fromkeys(score, 1)
    turn, idle = 0, dict.fromkeys(score, 0)
    while open_to:
        active = graph.filter(F.col("resolution").isin(sorted(open_to)))
        size = placed.join(degrees, ["resolution", "v"]).groupBy("resolution", "c").agg(F.sum("k").alias("d"))
        at = placed.join(size, ["resolution", "c"]).select("resolution", F.col("v").alias("u"), "c", "d")
        block = F.pmod(F.xxhash64("v"), block_count[F.col("resolution")])
        colour = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])[F.col("resolution")]
        mine = active.withColumn("_block", block).filter(F.pmod(F.col("_block") + F.lit(turn), colour) == 0)
        seen = mine.join(at, ["resolution", "u"]).join(degrees, ["resolution", "v"]).select("resolution", "_block", "v", "u", "w", "c", "d", "k", F.lit(m).alias("m"))
        new = seen.groupBy("resolution", "_block").applyInArrow(_sweep, "resolution double, v long, c long")
        after = placed.join(new.withColumnRenamed("c", "_to"), ["resolution", "v"], "left").select("resolution", "v", F.coalesce("_to", "c").alias("c"))
        after = written(_named(after))
        now = _scores(graph, after, degrees, m)
        risen = {r for r in open_to if now[r] > score[r] + EPS}
        keep = F.col("resolution").isin(sorted(risen)) if risen else F.lit(False)
        if risen == open_to and risen == set(score):
            placed = after
        elif risen:
            placed = written(after.filter(keep).unionByName(placed.filter(~keep)))
        turn += 1
        for r in sorted(open_to):
            if r in risen:
                score[r], idle[r] = now[r], 0
                changed.add(r)
            else:
                idle[r] += 1
                if idle[r] >= colours[r]:  # each colour had its turn
                    if colours[r] >= blocks[r]:
                        open_to.discard(r)
                    colours[r], idle[r] = min(2 * colours[r], blocks[r]), 0
    return placed, changed


def _contracted(graph: DataFrame, placed: DataFrame) -> DataFrame:
    at = lambda n: placed.select("resolution", F.col("v").alias(n), F.col("c").alias(f"_{n}"))
    met = graph.join(at("v"), ["resolution", "v"]).join(at("u"), ["resolution", "u"])
    return met.groupBy("resolution", F.col("_v").alias("v"), F.col("_u").alias("u")).agg(F.sum("w").alias("w"))


def louvain(edges: DataFrame, vertices: DataFrame, resolutions: Sequence[float]) -> DataFrame:
    """(resolution, v, c): communities of each resolution; edges (src < dst, w) over dense ids, vertices (v).

    Vertices without edges stay alone.  No single vertex gains by moving to a neighbour's community or to one of its own.
    """
    levels = F.explode(F.array(*[F.lit(float(r)) for r in resolutions])).alias("resolution")
    both = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u")))).alias("e")
    every = written(edges.filter("src <> dst AND w > 0").select(both, F.col("w").cast("double").alias("w")).select("e.v", "e.u", "w").select(levels, "v", "u", "w"))
    everyone = written(vertices.select("v").distinct().select(levels, "v", F.col("v").alias("c")))
    m = (every.agg(F.sum("w")).first()[0] or 0.0) / 2 / max(len(resolutions), 1)
    if m <= 0:
        return everyone
    # A vertex sees itself, so that a block knows its community; the weight of that edge is what lies inside it.
    loops = everyone.select("resolution", "v", F.col("v").alias("u"), F.lit(0.0).alias("w"))
    base = written(every.unionByName(loops))
    degrees = written(_degrees(base))
    current, first = everyone, True
    while True:
        current, changed = _moves(base, degrees, current, m)
        if not changed and not first:
            return current
        first = False
        graph, placed = base, current
        while True:
            graph = written(_contracted(graph, placed))
            small = written(_degrees(graph))
            alone = small.select("resolution", "v", F.col("v").alias("c"))
            placed, changed = _moves(graph, small, alone, m)
            if not changed:
                break
            up = placed.select("resolution", F.col("v").alias("c"), F.col("c").alias("_up"))
            current = written(current.join(up, ["resolution", "c"]).select("resolution", "v", F.col("_up").alias("c")))
