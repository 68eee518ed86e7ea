"""Sums of outer products over many rows: one pass, a few numbers per task.

`XtX`-like matrices are accumulated by Arrow batch inside each task and added up in two steps.  The size of
what is shuffled depends on the vector dimension and on the number of tasks, not on the number of rows.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _adder(keys: Sequence[str], cols: Sequence[str], salted: bool):
    keys, cols = list(keys), list(cols)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {k: pdf[k].iloc[0] for k in keys}
        sums = {c: np.sum(np.stack(pdf[c].to_numpy()), axis=0).tolist() for c in cols}
        if salted:
            head["_salt"] = pdf["_salt"].iloc[0]
        return pd.DataFrame([{**head, **sums}])

    return add


def add_arrays(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fan_in: int = 64) -> DataFrame:
    """Element-wise sum of array columns per key, in two steps so no group holds more than a share of the tasks."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in {*keys, *cols})
    order = [f.name for f in df.schema.fields if f.name in {*keys, *cols}]
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    first = salted.groupBy(*keys, "_salt").applyInPandas(_adder(keys, cols, True), types + ", _salt int")
    return first.groupBy(*keys).applyInPandas(_adder(keys, cols, False), types).select(*order)


def scatterer():
    """Function that turns sparse rows (index arrays, value arrays) into a dense matrix; shipped by value."""

    def scatter(index, values, width: int):
        index, values = list(index), list(values)
        out = np.zeros((len(index), width))
        if index:
            rows = np.repeat(np.arange(len(index)), [len(i) for i in index])
            out[rows, np.concatenate(index).astype(int)] = np.concatenate(values)
        return out

    return scatter


# Edge of a tile of a moment matrix, and bytes of moments a task holds before it passes them on.
TILE, FLUSH_BYTES = 64, 64 << 20

TILES = "i int, j int, head array<double>, mw binary, mu binary"


def tile_spans(size: int) -> list[tuple[int, int]]:
    return [(at, min(at + TILE, size)) for at in range(0, size, TILE)]


def _tile_adder(keys: Sequence[str], salted: bool):
    keys = list(keys)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: np.sum([np.frombuffer(x, "<f8") for x in pdf[c]], axis=0).astype("<f8").tobytes()
        head = {k: pdf[k].iloc[0] for k in [*keys, *(["_salt"] if salted else []), "i", "j"]}
        return pd.DataFrame([{**head, "head": np.sum(np.stack(pdf["head"].to_numpy()), axis=0).tolist(), "mw": total("mw"), "mu": total("mu")}])

    return add


def add_tiles(tiles: DataFrame, keys: Sequence[str], fan_in: int = 64) -> DataFrame:
    """Tiles (keys, i, j, head, mw, mu) added up by key and place, in two steps; a group holds at most a tile from each task."""
    keys = list(keys)
    typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields if f.name in keys)
    salted = tiles.select(*keys, "i", "j", "head", "mw", "mu").withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    first = salted.groupBy(*keys, "_salt", "i", "j").applyInPandas(_tile_adder(keys, True), f"{typed}, _salt int, {TILES}")
    return first.drop("_salt").groupBy(*keys, "i", "j").applyInPandas(_tile_adder(keys, False), f"{typed}, {TILES}")


def assembler(size: int):
    """Function that puts the tiles of one group together: (head, weighted moments, plain moments); shipped by value."""
    spans = tile_spans(size)

    def assembled(pdf: pd.DataFrame):
        head, both = np.zeros(3), [np.zeros((size, size)), np.zeros((size, size))]
        for i, j, h, *parts in zip(pdf["i"], pdf["j"], pdf["head"], pdf["mw"], pdf["mu"], strict=True):
            head += np.asarray(h)
            (a, b), (c, d) = spans[i], spans[j]
            for m, data in zip(both, parts, strict=True):
                block = np.frombuffer(data, "<f8").reshape(b - a, d - c)
                m[a:b, c:d] += block
                if i != j:
                    m[c:d, a:b] += block.T
        return head, both[0], both[1]

    return assembled


def pair_moments(pairs: DataFrame, dim: int) -> DataFrame:
    """Moments of z = (x, 1, y) per (pair, source, target), weighted and unweighted, as tiles of the upper triangle.

    `pairs` has pair, w and the arrays s_vecs, t_vecs of structs (region, p, vector).  A sample is one
    combination of a source and a target region with weight w * p_s * p_t.  Combinations are formed as matrix
    products inside the batch and never become rows.  A task passes its sums on whenever they exceed FLUSH_BYTES, so its
    memory is bounded at any dimension and number of regions.
    Returns pair, source, target, i, j, head (n, sw, sw2; in tile 0, 0 only), mw and mu (tile i, j of the moments).
    """
    size = 2 * dim + 1
    spans = tile_spans(size)
    budget = FLUSH_BYTES

    def regions_of(index, shares, vectors):
        """region -> (rows, shares, vectors) of a batch."""
        counts = [len(i) for i in index]
        rows, region = np.repeat(np.arange(len(counts)), counts), np.concatenate(list(index))
        share, vector = np.concatenate(list(shares)), np.concatenate(list(vectors)).reshape(-1, dim)
        return {r: (rows[region == r], share[region == r], vector[region == r]) for r in np.unique(region)}

    def emptied(acc: dict) -> pd.DataFrame:
        rows = [
            (kind, int(s), int(t), i, j, (head if i == j == 0 else 0 * head).tolist(), mw[a:b, c:d].astype("<f8").tobytes(), mu[a:b, c:d].astype("<f8").tobytes())
            for (kind, s, t), (head, mw, mu) in acc.items() for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i <= j
        ]
        acc.clear()
        return pd.DataFrame(rows, columns=["pair", "source", "target", "i", "j", "head", "mw", "mu"])

    def partial(batches):
        acc: dict = {}
        for pdf in batches:
            for kind, part in pdf.groupby("pair", sort=False):
                left, right = regions_of(part["sr"], part["sp"], part["sv"]), regions_of(part["tr"], part["tp"], part["tv"])
                w = part["w"].to_numpy(dtype=float)
                for i, (rows_i, ps, xs) in left.items():
                    for j, (rows_j, pt, ys) in right.items():
                        both, ai, bj = np.intersect1d(rows_i, rows_j, assume_unique=True, return_indices=True)
                        weight = w[both] * ps[ai] * pt[bj]
                        keep = weight > 0
                        if not keep.any():
                            continue
                        weight = weight[keep]
                        z = np.hstack([xs[ai][keep], np.ones((len(weight), 1)), ys[bj][keep]])
                        cell = acc.setdefault((kind, i, j), [np.zeros(3), np.zeros((size, size)), np.zeros((size, size))])
                        cell[0] += [len(weight), weight.sum(), (weight * weight).sum()]
                        cell[1] += (z * weight[:, None]).T @ z
                        cell[2] += z.T @ z
                        if len(acc) * 16 * size * size > budget:
                            yield emptied(acc)
        if acc:
            yield emptied(acc)

    flat = pairs.filter((F.size("s_vecs") > 0) & (F.size("t_vecs") > 0)).select("pair", "w", *[
        c for side in "st" for c in (
            F.col(f"{side}_vecs.region").alias(f"{side}r"), F.col(f"{side}_vecs.p").alias(f"{side}p"), F.flatten(F.col(f"{side}_vecs.vector")).alias(f"{side}v"))
    ])
    return add_tiles(flat.mapInPandas(partial, f"pair string, source long, target long, {TILES}"), ["pair", "source", "target"])
