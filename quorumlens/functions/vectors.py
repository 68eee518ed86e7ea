"""Sparse text vectors that stay in their row: one array of (bucket, value), sorted by bucket, for each text.

A text is hashed inside its task and never leaves its row, so no feature is shuffled; only the document frequencies of the buckets
are, one number a bucket.  A text without tokens has an empty array and keeps its row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that a task hashes at a time.
SLICE_TOKENS = 200_000

VECTOR = T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("x", T.DoubleType())]))


def hashed_tokens(tokens: Column, dim: int) -> Column:
    """Signed counts of the tokens and of adjacent pairs per hash bucket; buckets whose counts cancel stay, with 0.

    Some texts of a batch at a time, so that the arrays stay small however many long texts a batch has; they hash each different token
    and pair once, and the counts are numpy sums over them.
    """
    most = SLICE_TOKENS

    def counted(batch: pa.Array) -> pa.Array:
        n = len(batch)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(batch).dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), sizes)
        number = lambda features, size: np.fromiter((int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for x in features), np.int64, size)
        inner = row[1:] == row[:-1]
        pairs, of = np.unique(code[:-1][inner] * len(words) + code[1:][inner], return_inverse=True)
        first, second = np.divmod(pairs, max(len(words), 1))
        bigrams = (f"bigram:{words[a]}_{words[b]}" for a, b in zip(first.tolist(), second.tolist(), strict=True))
        h = np.concatenate([number((f"tok:{w}" for w in words), len(words))[code], number(bigrams, len(pairs))[of]])
        cells, at = np.unique(np.concatenate([row, row[1:][inner]]) * dim + h % dim, return_inverse=True)
        sums = np.bincount(at, np.where((h >> 32) % 2 == 0, 1.0, -1.0), len(cells))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(cells // dim, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(cells % dim, pa.int64()), pa.array(sums, pa.float64())], names=["bucket", "x"]))

    @F.arrow_udf(VECTOR)
    def hashed(batch: pa.Array) -> pa.Array:
        load = np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(load // most)) + 1).tolist(), len(batch)]
        return pa.concat_arrays([counted(batch.slice(a, b - a)) for a, b in zip(edges, edges[1:])])

    return hashed(tokens)


def bucket_weights(vectors: DataFrame, f: str, dim: int) -> DataFrame:
    """One row: ln((N + 1) / (df + 1)) + 1 for each bucket from 0, as an array; a bucket no text has gets df 0.

    `dim` is a parameter of the encoder, so the row has a fixed size.
    """
    n = vectors.agg(F.count(F.lit(1)).alias("_n"))
    df = vectors.select(F.explode(F.transform(f, lambda e: e["bucket"])).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    table = df.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "df"))).alias("_df"))
    total = F.greatest(F.col("_n"), F.lit(1)) + 1.0
    every = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return n.crossJoin(table).select(F.transform(every, lambda b: F.ln(total / (F.coalesce(F.try_element_at("_df", b), F.lit(0)) + 1.0)) + 1.0).alias("_idf"))  # one row each


def weighted(vectors: DataFrame, f: str, weights: DataFrame) -> DataFrame:
    """The vectors times the weights of their buckets, scaled to length 1; zero vectors stay zero."""
    joined = vectors.crossJoin(F.broadcast(weights))  # one row of fixed size
    scaled = F.transform(f, lambda e: F.struct(e["bucket"].alias("bucket"), (e["x"] * F.get("_idf", e["bucket"].cast("int"))).alias("x")))
    joined = joined.withColumn(f, scaled).drop("_idf")
    # The length is bound to a variable of its own: inside the inner lambda it would be computed for every entry.
    whole = F.array(F.struct(F.sqrt(square(F.col(f))).alias("n"), F.col(f).alias("f")))
    unit = F.transform(whole, lambda p: F.transform(p["f"], lambda e: F.struct(e["bucket"].alias("bucket"), F.when(p["n"] > 0, e["x"] / p["n"]).otherwise(0.0).alias("x"))))
    return joined.withColumn(f, F.get(unit, F.lit(0)))


def against(f: Column, table: Column, width: int) -> Column:
    """Products of a sparse vector with the `width` columns of `table`, an array over buckets of arrays."""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.aggregate(f, zero, lambda s, e: F.zip_with(s, F.coalesce(F.get(table, e["bucket"].cast("int")), zero), lambda a, c: a + e["x"] * c))


def square(f: Column) -> Column:
    return F.aggregate(f, F.lit(0.0), lambda s, e: s + e["x"] * e["x"])

