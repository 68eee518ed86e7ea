"""Benchmark decontamination with a distributed positional inverted index.

The index is a table with one row for each segment (some MB of neighbouring documents): ids and word counts of its
documents, and for every test term the sorted places (word numbers in the segment) at which it stands.  Terms that no
test item has can't be part of an occurrence and are not stored.  A search takes the windows of the test items (each 13
consecutive words; a shorter item is one window), orders the terms of a window by their corpus frequency, and intersects
the lists, each shifted by the term's place in the window, from the rarest term on:

* exact: all terms of the window stand at their places, inside one document;
* proximity: at least `near_terms` terms stand within `slop` words of their places, counted from one of its rarest terms.

Test items go to the tasks in blocks of at most `block_bytes` of text, one pass over the index for each block, so what is
broadcast is bounded by a parameter.  Nothing is shuffled but term counts and, for more than one block, the spans found.

A document or item without text or words has no occurrences.  Repeated rows get the same result each; an item id that
stands in several rows counts once; a null id is the empty string among the ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import PLAIN, Words, chunks

WINDOW_WORDS = 13
NEAR_TERMS, SLOP = 10, 2
BLOCK_BYTES = 16 << 20
SEGMENT_BYTES = 4 << 20

INDEX = "doc_ids binary, counts binary, terms binary, sizes binary, places binary"
FOUND = ("doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, "
         "near array<struct<item_id: string, start: long, terms: long>>")


def _item_words(items: DataFrame) -> DataFrame:
    """The word hashes of each test item."""

    def words(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column("text"), PLAIN, lower=True)
                h = w.hashes()
                yield pa.RecordBatch.from_pydict({
                    "item_id": part.column("item_id"),
                    "words": pa.array([h[a:b].tobytes() for a, b in zip(w.bounds, w.bounds[1:])], pa.binary())})

    plain = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(words, "item_id string, words binary").filter(F.length("words") > 0)


def _collected(block: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    rows = block.distinct().orderBy("item_id", "words").collect()  # a block is at most block_bytes
    return [r.item_id for r in rows], [np.frombuffer(r.words, "<u8") for r in rows]


def build_index(docs: DataFrame, vocabulary: np.ndarray, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row for each segment, with the postings of the terms in the sorted `vocabulary` of hashes."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def postings(batches):
        terms = sent.value
        for batch in batches:
            for part in chunks(batch, "text", segment_bytes):
                hashes, counts = [], []
                for piece in chunks(part, "text"):
                    w = Words(piece.column("text"), PLAIN, lower=True)
                    hashes.append(w.hashes())
                    counts.append(w.counts)
                h = np.concatenate(hashes)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                places = np.flatnonzero(terms[at] == h)
                at = at[places]
                order = np.argsort(at, kind="stable")
                own, sizes = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "doc_ids": pa.array([_ids(part.column("doc_id"))], pa.binary()),
                    "counts": pa.array([np.concatenate(counts).astype("<i8").tobytes()], pa.binary()),
                    "terms": pa.array([terms[own].astype("<u8").tobytes()], pa.binary()),
                    "sizes": pa.array([sizes.astype("<i8").tobytes()], pa.binary()),
                    "places": pa.array([places[order].astype("<u4").tobytes()], pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(postings, INDEX)


_NO_ID = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> bytes:
    return np.array([_NO_ID if x is None else x for x in column.to_pylist()], "<i8").tobytes()


def term_counts(index: DataFrame) -> DataFrame:
    """Corpus frequency of each indexed term: summed inside a task before the shuffle."""

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for terms, sizes in zip(batch.column("terms").to_pylist(), batch.column("sizes").to_pylist()):
                for t, n in zip(np.frombuffer(terms, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist()):
                    total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    return index.select("terms", "sizes").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Plan:
    """Windows of a block of items, each with its terms from the rarest to the most frequent."""

    def __init__(self, ids: list[str], items: list[np.ndarray], frequency: dict[int, int], width: int) -> None:
        self.ids = ids
        windows: dict[bytes, int] = {}
        rows, self.pairs = [], []
        for k, words in enumerate(items):
            n = min(width, len(words))
            for s in range(len(words) - n + 1):
                key = words[s:s + n].tobytes()
                if key not in windows:
                    windows[key] = len(rows)
                    rows.append(words[s:s + n])
                self.pairs.append((windows[key], k))
        self.length = np.array([len(r) for r in rows], np.int64)
        self.terms = np.zeros((len(rows), width), np.uint64)
        self.shift = np.full((len(rows), width), -1, np.int64)
        for i, r in enumerate(rows):
            n = np.array([frequency.get(int(t), 0) for t in r.view(np.int64)])
            order = np.argsort(n, kind="stable")
            self.terms[i, :len(r)] = r[order]
            self.shift[i, :len(r)] = order
        of = np.array(self.pairs, np.int64).reshape(-1, 2)
        of = np.unique(of, axis=0)
        self.items_of, self.bounds = of[:, 1], np.searchsorted(of[:, 0], np.arange(len(rows) + 1))


class Postings:
    """The lists of one segment, as one sorted array of (term number, place)."""

    def __init__(self, terms: bytes, sizes: bytes, places: bytes) -> None:
        self.terms, self.sizes = np.frombuffer(terms, "<u8"), np.frombuffer(sizes, "<i8")
        self.places = np.frombuffer(places, "<u4").astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.keys = (np.repeat(np.arange(len(self.terms)), self.sizes) << 32) | self.places

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the dictionary of the segment, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of each term, end to end, and for each place whose it is."""
        sizes = np.where(numbers < 0, 0, self.sizes[numbers])
        owner = np.repeat(np.arange(len(numbers)), sizes)
        start = np.where(numbers < 0, 0, self.firsts[numbers])
        return self.places[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[owner]], owner

    def has(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """If the list of the term has a place from low to high."""
        at = np.searchsorted(self.keys, (numbers << 32) | np.maximum(low, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (numbers >= 0) & (high >= 0) & (at < len(self.keys)) & (found <= ((numbers << 32) | high))


def exact(plan: Plan, postings: Postings, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the first places of their occurrences.  `ends` are the ends of the documents in the segment."""
    numbers = postings.number(plan.terms)
    alive = np.flatnonzero(~((numbers < 0) & (plan.shift >= 0)).any(axis=1))
    places, owner = postings.lists(numbers[alive, 0]) if len(postings.terms) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    window = alive[owner]
    start = places - plan.shift[window, 0]
    keep = start >= 0
    window, start = window[keep], start[keep]
    for k in range(1, plan.terms.shape[1]):
        used = plan.shift[window, k] >= 0
        at = start + plan.shift[window, k]
        keep = ~used | postings.has(numbers[window, k], at, at)
        window, start = window[keep], start[keep]
    doc = np.searchsorted(ends, start, "right")
    keep = start + plan.length[window] <= ends[doc]
    return window[keep], start[keep]


def near(plan: Plan, postings: Postings, ends: np.ndarray, least: int, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of full width, first places and number of terms of their proximity matches."""
    width = plan.terms.shape[1]
    numbers = postings.number(plan.terms)
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    full = np.flatnonzero((plan.length == width) & ((numbers >= 0).sum(axis=1) >= least))
    for anchor in range(width - least + 1):  # of `least` terms, one is among the rarest width - least + 1
        places, owner = postings.lists(numbers[full, anchor]) if len(full) else (none, none)
        window = full[owner]
        start = places - plan.shift[window, anchor]
        terms = np.ones(len(window), np.int64)
        tried = 1
        for k in [*range(anchor), *range(anchor + 1, width)]:
            at = start + plan.shift[window, k]
            terms += postings.has(numbers[window, k], at - slop, at + slop)
            tried += 1
            keep = terms + width - tried >= least
            window, start, terms = window[keep], start[keep], terms[keep]
        found.append((window, start, terms))
    window, start, terms = (np.concatenate(x) for x in zip(*found))
    doc = np.minimum(np.searchsorted(ends, np.maximum(start, 0), "right"), max(len(ends) - 1, 0))
    keep = (start >= (np.concatenate([[0], ends[:-1]])[doc] if len(ends) else 0)) & (start + width <= (ends[doc] if len(ends) else 0))
    return window[keep], start[keep], terms[keep]


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _search(index: DataFrame, plan: Plan, least: int, slop: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(plan)

    def search(batches):
        p = sent.value
        for batch in batches:
            for ids, counts, terms, sizes, places in zip(*(batch.column(n).to_pylist() for n in ("doc_ids", "counts", "terms", "sizes", "places"))):
                doc_ids, n = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i8")
                ends = np.cumsum(n)
                lists = Postings(terms, sizes, places)
                window, start = exact(p, lists, ends)
                close, near_start, near_terms = near(p, lists, ends, least, slop)
                doc, near_doc = np.searchsorted(ends, start, "right"), np.searchsorted(ends, near_start, "right")
                spans: list[list] = [[] for _ in n]
                items: list[list] = [[] for _ in n]
                other: list[list] = [[] for _ in n]
                for d in np.unique(doc):
                    mine = doc == d
                    base = ends[d] - n[d]
                    merged = _merged(start[mine] - base, start[mine] - base + p.length[window[mine]])
                    spans[d] = [{"start": a, "end": b} for a, b in merged]
                    hit = {int(k) for w in np.unique(window[mine]) for k in p.items_of[p.bounds[w]:p.bounds[w + 1]]}
                    items[d] = sorted({p.ids[k] for k in hit})
                for d in np.unique(near_doc):
                    mine = near_doc == d
                    base = ends[d] - n[d]
                    other[d] = [{"item_id": p.ids[k], "start": int(s - base), "terms": int(t)} for w, s, t in sorted({
                        *zip(close[mine].tolist(), near_start[mine].tolist(), near_terms[mine].tolist())})
                        for k in p.items_of[p.bounds[w]:p.bounds[w + 1]]]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if x == _NO_ID else int(x) for x in doc_ids], pa.int64()),
                    "n_words": pa.array(n, pa.int64()),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "near": pa.array(other, pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("terms", pa.int64())])))})

    return index.mapInArrow(search, FOUND)


def _union(spans: Column) -> Column:
    """Overlapping and adjoining spans made one."""
    kind = "array<struct<start: bigint, end: bigint>>"
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(done, F.array(s))))


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW_WORDS, near_terms: int = NEAR_TERMS, slop: int = SLOP,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (words hit by exact matches), items, near (proximity matches), n_hit, for each row of docs."""
    words = _item_words(items)
    size = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    numbered = words.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    results = []
    # Results of several blocks are merged by document, named by its id and text, and handed back to every row.
    named = F.xxhash64("doc_id", F.col("text").cast("string"))
    texts = docs if blocks == 1 else docs.select(named.alias("doc_id"), "text")
    for b in range(blocks):
        ids, lists = _collected(numbered.filter(F.col("block") == b).drop("block"))
        vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(1, np.uint64)
        index = stored(build_index(texts, vocabulary))
        frequency = {r.term: r.n for r in term_counts(index).collect()}  # at most the vocabulary of the block
        results.append(_search(index, Plan(ids, lists, frequency, width), near_terms, slop))
    if blocks == 1:
        found = results[0]
    else:
        all_found = results[0]
        for r in results[1:]:
            all_found = all_found.unionByName(r)
        found = all_found.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"), _union(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), named.alias("_named"))
        found = rows.join(found.withColumnRenamed("doc_id", "_named"), "_named").select("doc_id", "n_words", "spans", "items", "near")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit)


def is_contaminated() -> Column:
    """The rule on n_hit and n_words: at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
