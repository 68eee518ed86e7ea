"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted over the corpus.

Segments are ranges of document ids.  Each sends the hashes of its windows; a bucket tells every segment which of its
windows also start in an earlier segment.  Inside a segment a window is a repeat from its second place on.  Overlapping
and adjoining repeated windows merge into maximal intervals, which are removed.

Nulls and texts of fewer words than a window have no windows and lose nothing.  The first document in id order keeps a
passage (a null id comes first); rows that share an id are ordered by their text, so that equal rows all lose but the
first.  Other columns are left out of the result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .words import SPACED, Words, chunks, unpack_sorted, windows

WINDOW_WORDS = 20
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string"


def _ordered(table: pa.Table) -> pa.Table:
    """By id, then text: the order in which the first place of a passage is looked for."""
    ids = table.column("doc_id").to_pylist()
    if len(set(ids)) == len(ids):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    else:
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    return table.take(pa.array(order, pa.int64())).combine_chunks()


def _all_windows(table: pa.Table, width: int) -> np.ndarray:
    found = []
    for part in chunks(table, "text"):
        words = Words(part.column("text"), SPACED)
        found.append(windows(words.hashes(), words.bounds, width)[0])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sender(width: int, buckets: int):
    def send(key, table):
        return ex.messages(key[0].as_py(), np.unique(_all_windows(table, width)), buckets)

    return send


def _earlier(table):
    """For each segment, those of its hashes that a segment before it has too."""
    rows = sorted(ex.rows_of(table, "segment", "hashes"))
    segments = np.array([r[0] for r in rows])
    parts = [unpack_sorted(r[1]) for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    later = order[1:][ranked[1:] == ranked[:-1]]
    later.sort()  # back in the order of segments, and of hashes inside a segment
    at = np.searchsorted(owner[later], np.arange(len(rows) + 1))
    full = np.flatnonzero(np.diff(at))
    return ex.answers(segments[full], [hashes[later[at[k]:at[k + 1]]] for k in full])


def _remover(width: int):
    def remove(key, docs, told):
        docs = _ordered(docs)
        hashes = _all_windows(docs, width)
        order = np.argsort(hashes, kind="stable")
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
        before = [unpack_sorted(h) for (h,) in ex.rows_of(told, "hashes")]
        if before:
            known = np.sort(np.concatenate(before))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            again |= known[at] == hashes
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "spans", "kept_text")}
        used = 0
        for part in chunks(docs, "text"):
            for doc_id, text in ex.rows_of(pa.Table.from_batches([part]), "doc_id", "text"):
                words = (text or "").encode().split()
                n = max(0, len(words) - width + 1)
                starts = np.flatnonzero(again[used:used + n])
                used += n
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + width, -1)
                gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
                out["doc_id"].append(doc_id)
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                out["kept_text"].append(b" ".join(compress(words, ~gone) if len(starts) else words).decode())
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()),
            "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(out["kept_text"], pa.string()),
        })

    return remove


def drop_repeats(docs: DataFrame, width: int = WINDOW_WORDS, segment_rows: int = ex.SEGMENT_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, the removed word `spans` and `kept_text`, one row for each row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    segments = ex.segment_count(texts, segment_rows)
    parts = ex.ranged(texts, "doc_id", segments)
    sent = parts.groupBy("segment").applyInArrow(_sender(width, ex.bucket_count(segments)), ex.MESSAGE)
    told = sent.groupBy("bucket").applyInArrow(_earlier, ex.ANSWER)
    return parts.groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(_remover(width), RESULT)
