"""Segments of documents that exchange packed hashes with buckets.

A corpus-wide question about hashes (how often does this window occur, does it occur earlier) is answered in three
steps.  Each segment, some thousand documents, sends its distinct hashes, cut by their top bits into buckets; one row
holds all hashes that one segment has for one bucket.  Each bucket answers every segment.  Each segment reads its answers
beside its own documents.  A hash that every document holds is one entry for each segment, so no key gathers its rows.
The two reads of the segments share one shuffle of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import pack_sorted

SEGMENT_ROWS = 1000
# Segments whose hashes one bucket holds: what a bucket reads is about this many segments' worth of hashes.
SEGMENTS_PER_BUCKET = 4

MESSAGE = "bucket int, segment int, hashes binary, extra binary"
ANSWER = "segment int, hashes binary, extra binary"


def segment_count(docs: DataFrame, rows: int = SEGMENT_ROWS) -> int:
    return max(1, -(-docs.count() // rows))


def bucket_count(segments: int) -> int:
    return max(1, -(-segments // SEGMENTS_PER_BUCKET))


def hashed(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def ranged(docs: DataFrame, key: str, segments: int, out: str = "segment") -> DataFrame:
    """Segments that follow the order of an integer key: a smaller key is never in a later segment; nulls are in the first."""
    borders: list[float] = []
    if segments > 1:
        shares = [i / segments for i in range(1, segments)]
        found = docs.select(F.percentile_approx(key, shares, 20 * segments).alias("q")).first()["q"] or []
        borders = sorted({float(x) for x in found})
    number = F.coalesce(F.col(key).cast("double"), F.lit(-1.7e308))
    if not borders:
        return docs.withColumn(out, F.lit(0))
    cut = Bucketizer(splits=[-float("inf"), *borders, float("inf")], inputCol="_number", outputCol="_cut")
    return cut.transform(docs.withColumn("_number", number)).withColumn(out, F.col("_cut").cast("int")).drop("_number", "_cut")


def cut(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """buckets + 1 places that cut sorted hashes by their top 32 bits."""
    edges = (np.arange(1, buckets, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(32)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]]).astype(np.int64)


def messages(segment: int, hashes: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that has some of these sorted distinct hashes; `extra` has a value for each hash."""
    at = cut(hashes, buckets)
    full = np.flatnonzero(np.diff(at))
    return pa.table({
        "bucket": pa.array(full, pa.int32()),
        "segment": pa.array(np.full(len(full), segment), pa.int32()),
        "hashes": pa.array([pack_sorted(hashes[at[b]:at[b + 1]]) for b in full], pa.binary()),
        "extra": pa.array([b"" if extra is None else extra[at[b]:at[b + 1]].tobytes() for b in full], pa.binary()),
    })


def answers(segments: np.ndarray, hashes: list[np.ndarray], extra: list[bytes] | None = None) -> pa.Table:
    return pa.table({
        "segment": pa.array(segments, pa.int32()),
        "hashes": pa.array([pack_sorted(h) for h in hashes], pa.binary()),
        "extra": pa.array(extra if extra is not None else [b""] * len(hashes), pa.binary()),
    })


def rows_of(table: pa.Table, *names: str) -> Iterator[tuple]:
    yield from zip(*(table.column(n).to_pylist() for n in names))
