"""Text vectors, label centroids, label similarities and the kNN graph."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions.dictionary import decoded, dictionary
from ..functions.lineage import checkpointed, written

DIM = 256
TAU = 50.0
LAMBDA_CONTEXT, LAMBDA_CONFUSION = 0.65, 0.35


def text_vectors(docs: DataFrame, text: str, fit: Column | None = None, dim: int = DIM, out: str = "f") -> DataFrame:
    """G1: `docs` with a unit vector of (bucket, x) in each row: signed counts of hashed tokens and pairs, times idf.

    Idf is fitted on the rows that `fit` selects (a split), all rows are transformed.  A text without tokens keeps its row, with an empty vector.
    """
    vectors = docs.withColumn(out, V.hashed_tokens(X.tokens(F.col(text)), dim))
    fit_rows = vectors if fit is None else vectors.filter(fit)
    return V.weighted(vectors, out, checkpointed(V.bucket_weights(fit_rows, out, dim)))


def tfidf_fit_transform(docs: DataFrame, key: str, text: str, fit: Column | None = None, dim: int = DIM) -> DataFrame:
    """G1 in long form: (key, bucket, x); texts without tokens have no rows here."""
    return text_vectors(docs, text, fit, dim, "_f").select(key, F.explode("_f").alias("e")).select(key, "e.bucket", "e.x")


def shrunk_centroids(soft: DataFrame, conf: DataFrame | None, features: DataFrame, observed: DataFrame, tau: float = TAU, label: str = "label") -> DataFrame:
    """Per (label, bucket) the raw and the shrunk centroid of item vectors weighted by q * conf / 5.

    alpha = n / (n + tau) with n the observed count of the label; the rest is the global mean vector.
    Result rows: labels x buckets, both bounded, so the dense grid below is small.
    """
    w = soft.select("item", label, "p")
    if conf is not None:
        w = w.join(conf.select("item", "mean_conf"), "item", "left").withColumn(
            "p", F.col("p") * F.coalesce(F.col("mean_conf") / 5.0, F.lit(1.0)))
    eff = w.groupBy(label).agg(F.sum("p").alias("eff"))
    sums = w.join(features, "item").groupBy(label, "bucket").agg(F.sum(F.col("p") * F.col("x")).alias("s"))
    n_items = soft.agg(F.countDistinct("item").alias("_n"))
    inside = features.join(soft.select("item").distinct(), "item", "left_semi")
    mean = inside.groupBy("bucket").agg(F.sum("x").alias("_sx")).crossJoin(F.broadcast(n_items)).select(
        "bucket", (F.col("_sx") / F.col("_n")).alias("mean"))
    grid = eff.join(F.broadcast(observed.select(label, "observed")), label).crossJoin(F.broadcast(mean))
    full = grid.join(sums, [label, "bucket"], "left").fillna(0.0, ["s"])
    raw = F.when(F.col("eff") > 0, F.col("s") / F.col("eff")).otherwise(0.0)
    alpha = F.col("observed") / (F.col("observed") + F.lit(float(tau)))
    return full.select(label, "bucket", "eff", alpha.alias("alpha"), raw.alias("raw"),
                       (alpha * raw + (1 - alpha) * F.col("mean")).alias("shrunk"))


def plain_centroids(soft: DataFrame, features: DataFrame, label: str = "label") -> DataFrame:
    """sum(p * x) / sum(p) per (label, bucket)."""
    total = soft.groupBy(label).agg(F.sum("p").alias("_t"))
    s = soft.select("item", label, "p").join(features, "item").groupBy(label, "bucket").agg(F.sum(F.col("p") * F.col("x")).alias("s"))
    return s.join(F.broadcast(total), label).select(label, "bucket", (F.col("s") / F.col("_t")).alias("x"))  # one row per label


# Labels of the edge of a tile, and bytes of tiles a task holds before it passes them on.
GRAM_TILE, GRAM_BYTES = 512, 64 << 20


def gram(entries: DataFrame, row: str, label: str, value: str) -> DataFrame:
    """Q'Q of a sparse row x label matrix as (src, dst, raw, w), w the cosine of two columns, diagonal 1.

    Labels are of any type.  A dictionary numbers them; a row with all its labels is one array, whose products are added to square tiles
    of labels inside the tasks, so pairs of labels never become rows before the sum, and no task or group holds more than some tiles.
    """
    known = written(entries.select(F.col(row).alias("_r"), F.col(label).alias("label"), F.col(value).alias("x")).filter("x IS NOT NULL AND label IS NOT NULL"))  # read three times
    ids = dictionary((known, "label"))
    coded = known.join(ids, "label")
    lists = coded.groupBy("_r").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("q")).select(F.col("q.id").alias("l"), F.col("q.x").alias("x"))
    n, edge, budget = ids.count(), GRAM_TILE, GRAM_BYTES

    def partial(batches):
        acc: dict = {}

        def emptied():
            rows = [(i, j, m.astype("<f8").tobytes()) for (i, j), m in acc.items()]
            acc.clear()
            return pd.DataFrame(rows, columns=["i", "j", "m"])

        for pdf in batches:
            rows = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf["l"]])
            labels, values = np.concatenate([*pdf["l"], np.zeros(0)]).astype(int), np.concatenate([*pdf["x"], np.zeros(0)])
            tile = labels // edge
            parts = {}
            for t in np.unique(tile):
                dense = np.zeros((len(pdf), min(edge, n - t * edge)))
                np.add.at(dense, (rows[tile == t], labels[tile == t] % edge), values[tile == t])
                parts[int(t)] = dense
            for i, left in parts.items():
                for j, right in parts.items():
                    acc[i, j] = acc.get((i, j), 0.0) + left.T @ right
                    if len(acc) * 8 * edge * edge > budget:
                        yield emptied()
        if acc:
            yield emptied()

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, np.sum([np.frombuffer(m, "<f8") for m in pdf["m"]], axis=0).astype("<f8").tobytes())], columns=["i", "j", "m"])

    def cells(batches):
        for pdf in batches:
            for i, j, m in zip(pdf["i"], pdf["j"], pdf["m"], strict=True):
                m = np.frombuffer(m, "<f8").reshape(-1, min(edge, n - j * edge))
                yield pd.DataFrame({"src": np.repeat(i * edge + np.arange(len(m)), m.shape[1]), "dst": np.tile(j * edge + np.arange(m.shape[1]), len(m)), "raw": m.ravel()})

    tiles = lists.mapInPandas(partial, "i long, j long, m binary").groupBy("i", "j").applyInPandas(add, "i long, j long, m binary")
    found = tiles.mapInPandas(cells, "src long, dst long, raw double")
    own = checkpointed(coded.groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("d")).filter("d > 0"))  # an entry is one row and label
    # Labels that never meet have no tile cell; they count with 0.
    every = own.select(F.col("id").alias("src"), F.col("d").alias("_a")).crossJoin(own.select(F.col("id").alias("dst"), F.col("d").alias("_b")))  # the result is labels x labels
    w = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.coalesce("raw", F.lit(0.0)) / F.sqrt(F.col("_a") * F.col("_b")))
    whole = every.join(found, ["src", "dst"], "left").select("src", "dst", F.coalesce("raw", F.lit(0.0)).alias("raw"), w.alias("w"))
    return decoded(whole, ids, ["src", "dst"])


def confusion_similarity(soft: DataFrame, label: str = "label") -> DataFrame:
    """Cosine of the columns of the item x label matrix."""
    return gram(soft, "item", label, "p")


def context_similarity(centroids: DataFrame, value: str = "shrunk", label: str = "label", clip: bool = True) -> DataFrame:
    """Cosine between label centroids (label, bucket, value), clipped to [0, 1]."""
    g = gram(centroids, "bucket", label, value)
    return g.withColumn("w", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w")))) if clip else g


def scaled(sim: DataFrame) -> DataFrame:
    """Off-diagonal values to [0, 1] by min and max (constant becomes 0), diagonal 1."""
    off = F.when(F.col("src") != F.col("dst"), F.col("w"))
    mm = sim.agg(F.min(off).alias("_lo"), F.max(off).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    v = F.when(F.col("src") == F.col("dst"), 1.0).when(F.coalesce(span, F.lit(0.0)) < 1e-12, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("w") - F.col("_lo")) / span)))
    return sim.crossJoin(F.broadcast(mm)).select("src", "dst", v.alias("w"))  # one-row side


def fused(context: DataFrame, confusion: DataFrame, w_context: float = LAMBDA_CONTEXT, w_confusion: float = LAMBDA_CONFUSION) -> DataFrame:
    """Weighted mean of the two scaled similarities."""
    total = w_context + w_confusion
    a, b = scaled(context).withColumnRenamed("w", "a"), scaled(confusion).withColumnRenamed("w", "b")
    mix = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(w_context / total * F.col("a") + w_confusion / total * F.col("b"))
    return a.join(b, ["src", "dst"]).select("src", "dst", "a", "b", mix.alias("w"))


def top_neighbours(sim: DataFrame, k: int) -> DataFrame:
    """The k most similar other labels of each label, ties by label.  A label has at most V rows."""
    w = Window.partitionBy("src").orderBy(F.desc(F.round("w", 9)), "dst")
    return sim.filter("src <> dst").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def frequent_neighbours(sim: DataFrame, observed: DataFrame, labels: int, k: int, label: str = "label") -> DataFrame:
    """Neighbours of the most frequent labels only."""
    top = observed.orderBy(F.desc("observed"), label).limit(labels).select(F.col(label).alias("src"), "observed")
    return top_neighbours(sim, k).join(F.broadcast(top), "src")  # at most `labels` rows


def knn_graph(sim: DataFrame, k: int) -> DataFrame:
    """Union of each label's k nearest as undirected edges (src < dst), positive weights, larger value kept."""
    near = top_neighbours(sim, k).filter("w > 0")
    return near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w"))


def degrees(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Degree and weighted degree, labels without edges included."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias(label), "w")
    d = ends.groupBy(label).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted_degree"))
    return labels.select(label).distinct().join(d, label, "left").fillna(0, ["degree"]).fillna(0.0, ["weighted_degree"])


def nearest_examples(queries: DataFrame, stored: DataFrame, q_key: str, s_key: str, k: int, f: str = "f", dim: int = DIM, block: int = 2048) -> DataFrame:
    """The k stored examples with the largest cosine per query, ties by stored key: (q_key, s_key, score, rank).

    Both tables hold unit vectors of (bucket, x) in a column `f`.  Queries and examples are packed in blocks of `block` rows; a task meets one
    block of each, as one matrix product, and passes on k candidates per query, so pairs never are rows; the best k of all blocks are one
    aggregate.  The number of query blocks is the only figure on the driver.  A vector without tokens has cosine 0 to all.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, q_key), (stored, s_key))}

    def packed(df: DataFrame, key: str, name: str, blocks: int) -> DataFrame:
        rows = df.select(F.col(key).alias("key"), F.col(f).alias("f")).withColumn(name, F.pmod(F.xxhash64("key"), F.lit(blocks)))
        return rows.groupBy(name).agg(F.collect_list(F.struct("key", "f")).alias(f"{name}_rows"))  # `block` rows or so

    size = lambda df: max(1, -(-df.count() // block))
    q_blocks = size(queries)
    q, s = packed(queries, q_key, "q", q_blocks), packed(stored, s_key, "s", size(stored))
    met = s.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).join(q, "q")
    cells = met.select(*[c for n in "qs" for c in (
        F.col(f"{n}_rows.key").alias(f"{n}k"), F.transform(f"{n}_rows", lambda r: F.size(r["f"])).alias(f"{n}n"),
        F.flatten(F.transform(f"{n}_rows", lambda r: r["f"]["bucket"])).alias(f"{n}b"), F.flatten(F.transform(f"{n}_rows", lambda r: r["f"]["x"])).alias(f"{n}x"))])

    def dense(sizes, buckets, values):
        out = np.zeros((len(sizes), dim))
        out[np.repeat(np.arange(len(sizes)), sizes), np.asarray(buckets, dtype=int)] = values
        return out

    def meet(batches):
        for pdf in batches:
            for qk, qn, qb, qx, sk, sn, sb, sx in pdf[["qk", "qn", "qb", "qx", "sk", "sn", "sb", "sx"]].itertuples(index=False):
                order = np.argsort(sk, kind="stable")
                left, right = dense(qn, qb, qx), dense(sn, sb, sx)[order].T
                for at in range(0, len(left), 128):  # products of some queries at a time
                    scores = np.round(left[at:at + 128] @ right, 9)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({"q": np.repeat(qk[at:at + 128], best.shape[1]), "s": sk[order][best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

    found = cells.mapInPandas(meet, f"q {kinds[q_key]}, s {kinds[s_key]}, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "s")  # k rows from each block of examples
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(q_key), F.col("s").alias(s_key), "score", "rank")
