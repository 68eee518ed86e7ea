"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and one end id.  Documents longer than a sequence are cut into whole sequences; what is left
over is the first piece.  Pieces are packed in groups of about `group_rows` documents, each group in one task and in
order of falling length, by bounded-space best fit: at most `open_bins` bins are open, a bitset has a bit for each amount
of free space that some open bin has, so the tightest bin that takes a piece is the lowest bit from its length up.  If no
bin takes a piece and all places are in use, the fullest bin closes first.  Only ids, lengths and checksums are shuffled.

Null and empty texts are the end id alone.  Rows that share a doc_id are packed each on their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .words import chunks

SEQUENCE_TOKENS = 2048
END_ID = 0
OPEN_BINS = 4096
GROUP_ROWS = 4000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def cut_points(length: int, size: int) -> list[int]:
    """Starts of the pieces of a document: the short one first, then whole sequences."""
    return [0] if length <= size else [*([0] if length % size else []), *range(length % size, length, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                ids = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    own = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    starts = cut_points(len(own), size)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)])):
                        for name, value in zip(rows, (doc_id, k, a, b - a, zlib.crc32(own[a:b].tobytes()))):
                            rows[name].append(value)
                        if with_ids:
                            ids.append(own[a:b].astype(np.int32))
                kinds = {"piece": pa.int32()}
                columns = {n: pa.array(v, kinds.get(n, pa.int64())) for n, v in rows.items()}
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class BestFit:
    """Open bins by free space.  `put` gives the bin and the offset of an item."""

    def __init__(self, size: int, open_bins: int) -> None:
        self.size, self.most = size, open_bins
        self.bits, self.n_open, self.bins = 0, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, space: int) -> int:
        found = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.bins, self.size
            self.bins += 1
        left = space - length
        if left:
            self.free[left].append(number)
            self.bits |= 1 << left
            self.n_open += 1
        return number, self.size - space


def _packer(size: int, open_bins: int):
    def pack(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins = BestFit(size, open_bins)
        placed = np.array([bins.put(n) for n in table.column("length").to_pylist()], np.int64).reshape(-1, 2)
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array((key[0].as_py() << 40) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))

    return pack


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pieces of all documents, each with its sequence_id and its offset there."""
    groups = max(1, -(-docs.count() // group_rows))
    cut = pieces(docs, tokenizer, size)
    # Pieces of one document go to different groups: a very long document is no hot key.
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(_packer(size, open_bins), PACKED)
