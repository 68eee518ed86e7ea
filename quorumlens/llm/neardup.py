"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is a vector: a weight tf * idf for each shingle of five words (lower-cased A-Z; a text of one to four words is
one shingle), idf = 1 + ln((1 + N) / (1 + df)) / (2 ln(1 + N)), with df counted over all N texts.  Two documents are
linked if the sum of the smaller weights is at least `threshold` times the sum of the larger ones.  Documents with the
same words are one text; counts N and df count each text once; classes are the connected components of texts.

1. Segments send their shingle hashes to buckets, which answer with document frequencies (see `exchange`).
2. A shingle that no other text has can't be shared, so a text with more than 1 - threshold of its weight in such
   shingles has no partner.  The others get signatures: `bands` keys of `rows` samples each.
   Texts of similarity s share a key with chance 1 - (1 - s**rows)**bands; at 0.8 all but 7 pairs in a million.
3. A bucket of equal keys isn't expanded into rows of pairs: all members are compared with one pivot, which then leaves.  A
   bucket whose members are all in one component by then is done.  In the others blocks of members are compared inside a
   task, through the shingles they share, and only links that join components come out.  So every two candidates have
   been compared or are in one component.

Nulls and texts without words are in no class but their own.  Rows that share a doc_id and a text are one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from .components import components
from .store import stored
from .words import PLAIN, Words, chunks, mix, span_sums, unpack_sorted, windows

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
# Texts compared with one pivot in one task, and texts of a block.
GROUP_ROWS = 500
# Shingle hashes of a block.
BLOCK_BYTES = 8 << 20
# Blocks that a text is sent to, on average, before more pivots are asked.
MANY_BLOCKS = 8
# Shared shingles that are added up at once.
MEETINGS = 1 << 20
SLACK = 1e-9

VECTOR = "digest long, hashes binary, weights binary, keys array<long>, whole double, shared double"
TEXT_BASE = np.uint64(0xA0761D6478BD642F)

QUANTILES = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of 65,536 equal shares, by Newton steps on 1 - (1 + x) exp(-x)."""
    p = (np.arange(QUANTILES) + 0.5) / QUANTILES
    x = np.sqrt(2 * p) + 1.0
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), 1e-6)
    return x


class Sampler:
    """Consistent weighted samples: argmin over shingles of ln c - r (floor(ln w / r + beta) - beta + 1)."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows = bands, rows
        self.r = _gamma_quantiles()
        self.log_c = np.log(self.r)
        self.seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def keys(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of `bands` keys for each vector; vector v is hashes[starts[v]:starts[v + 1]], none is empty."""
        log_w = np.log(weights.astype(np.float64))
        sizes = np.diff(np.append(starts, len(hashes)))
        out = np.zeros((len(starts), self.bands), np.uint64)
        low = np.uint64(QUANTILES - 1)
        with np.errstate(over="ignore"):
            for s, seed in enumerate(self.seeds):
                z = mix(hashes ^ seed)
                r = self.r[(z & low).astype(np.int64)]
                beta = (z >> np.uint64(32)) * 2.0**-32
                t = np.floor(log_w / r + beta)
                a = self.log_c[((z >> np.uint64(16)) & low).astype(np.int64)] - r * (t - beta + 1)
                least = np.minimum.reduceat(a, starts)
                hits = np.flatnonzero(a == np.repeat(least, sizes))
                at = hits[np.searchsorted(hits, starts)]
                sample = mix(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
                band = s // self.rows
                out[:, band] = mix(out[:, band] * np.uint64(3) + sample + np.uint64(band))
        return out


def shingle_counts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and count of each distinct shingle of each document, sorted by hash."""
    hashes, starts = windows(words.hashes(), words.bounds, width)
    owner = np.searchsorted(words.bounds, starts, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = mix(span_sums(words.hashes(), words.bounds[short], words.bounds[short + 1], TEXT_BASE))
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
        back = np.argsort(owner, kind="stable")
        hashes, owner = hashes[back], owner[back]
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def digests(words: Words) -> np.ndarray:
    """A hash of all words of each document."""
    return mix(span_sums(words.hashes(), words.bounds[:-1], words.bounds[1:], TEXT_BASE) + words.counts.astype(np.uint64))


def inverse_frequency(df: np.ndarray, total: int) -> np.ndarray:
    return 1.0 + np.log((1.0 + total) / (1.0 + df)) / (2.0 * np.log(1.0 + total))


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the words of each document, null if it has none."""

    def digest(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"), PLAIN, lower=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "digest": pa.array(
                    digests(words).view(np.int64), pa.int64(), mask=words.counts == 0)})

    return docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(digest, "doc_id long, text_key long, digest long")


class Texts:
    """The rows of a segment that stand for their texts: all but those whose id and text are in `copies`, and the first of repeated rows."""

    def __init__(self, copies: pa.Table) -> None:
        self.copies = {(i["doc_id"], i["digest"]) for ids in copies.column("ids").to_pylist() if ids is not None for i in ids}
        self.seen: set[int] = set()

    def fresh(self, part: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray]:
        digest = digests(words)
        out = np.zeros(part.num_rows, bool)
        for d, doc_id in enumerate(part.column("doc_id").to_pylist()):
            if words.counts[d] and (doc_id, int(digest[d].astype(np.int64))) not in self.copies:
                out[d] = int(digest[d]) not in self.seen
                self.seen.add(int(digest[d]))
        return out, digest


def _sender(width: int, buckets: int):
    def send(key, table, copies):
        texts, found = Texts(copies), []
        for part in chunks(table, "text"):
            words = Words(part.column("text"), PLAIN, lower=True)
            fresh, _ = texts.fresh(part, words)
            hashes, owner, _ = shingle_counts(words, width)
            found.append(hashes[fresh[owner]])
        hashes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        return ex.messages(table.column("segment")[0].as_py() if table.num_rows else 0, hashes, buckets, n.astype("<u4"))

    return send


def _count(table):
    """For each segment, those of its hashes that two or more texts have, and how many."""
    rows = sorted(ex.rows_of(table, "segment", "hashes", "extra"))
    parts = [unpack_sorted(r[1]) for r in rows]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in parts])
    hashes, n = np.concatenate(parts), np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    opens = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sums = np.add.reduceat(n[order].astype(np.int64), opens)
    sizes = np.diff(np.append(opens, len(ranked)))
    df = np.empty(len(hashes), np.uint64)
    df[order] = np.repeat(sums, sizes)
    keep = df > 1
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    full, told, extra = [], [], []
    for k in range(len(rows)):
        own = slice(at[k], at[k + 1])
        if keep[own].any():
            full.append(rows[k][0])
            told.append(hashes[own][keep[own]])
            extra.append(df[own][keep[own]].astype("<u8").tobytes())
    return ex.answers(np.array(full, np.int32), told, extra)


def _vectorizer(width: int, total: int, threshold: float, bands: int, rows: int):
    def vectors(key, docs, told):
        sampler = Sampler(bands, rows)
        heard = [r for r in ex.rows_of(told, "hashes", "extra") if r[0] is not None]
        known = np.concatenate([unpack_sorted(h) for h, _ in heard] or [np.zeros(0, np.uint64)])
        extra = np.concatenate([np.frombuffer(e, "<u8") for _, e in heard] or [np.zeros(0, "<u8")])
        order = np.argsort(known)
        known, extra = np.append(known[order], np.uint64(2**64 - 1)), np.append(extra[order], np.uint64(0))
        texts, tables = Texts(told), []
        for part in chunks(docs, "text"):
            words = Words(part.column("text"), PLAIN, lower=True)
            fresh, digest = texts.fresh(part, words)
            hashes, owner, n = shingle_counts(words, width)
            at = np.searchsorted(known, hashes)
            df = np.where(known[at] == hashes, extra[at], np.uint64(1)).astype(np.int64)
            weights = (n * inverse_frequency(df, total)).astype("<f4")
            whole = np.bincount(owner, weights, part.num_rows)
            alone = np.bincount(owner, weights * (df == 1), part.num_rows)
            picked = fresh & (alone <= (1 - threshold) * whole * (1 + 1e-6))
            mine = np.flatnonzero(picked[owner])
            mine = mine[np.argsort(owner[mine], kind="stable")]
            h, w, o = hashes[mine], weights[mine], owner[mine]
            docs_in, starts = np.unique(o, return_index=True)
            ends = np.append(starts[1:], len(o))
            keys = sampler.keys(h, w, starts) if len(docs_in) else np.zeros((0, bands), np.uint64)
            tables.append(pa.table({
                "digest": pa.array(digest[docs_in].view(np.int64), pa.int64()),
                "hashes": pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                "weights": pa.array([w[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                "keys": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                "whole": pa.array(whole[docs_in], pa.float64()), "shared": pa.array((whole - alone)[docs_in], pa.float64()),
            }))
        none = pa.table({"digest": pa.array([], pa.int64()), "hashes": pa.array([], pa.binary()), "weights": pa.array([], pa.binary()),
                         "keys": pa.array([], pa.list_(pa.int64())), "whole": pa.array([], pa.float64()), "shared": pa.array([], pa.float64())})
        return pa.concat_tables(tables) if tables else none

    return vectors


def vectors(docs: DataFrame, base: DataFrame, threshold: float = THRESHOLD, segment_rows: int = ex.SEGMENT_ROWS,
            bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Vector and band keys of each text that may have a partner; `base` has the digests of all documents."""
    worded = base.filter("digest IS NOT NULL")
    first = worded.groupBy("digest").agg(F.min("doc_id").alias("first"))
    total = max(2, first.count())
    segments = ex.segment_count(docs, segment_rows)
    segment = ex.hashed(F.col("doc_id"), segments).alias("segment")
    copies = worded.join(first, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(segment, "doc_id", "digest").distinct()
    copies = stored(copies.groupBy("segment").agg(F.collect_list(F.struct("doc_id", "digest")).alias("ids")))
    parts = docs.select("doc_id", "text", segment)
    sent = parts.groupBy("segment").cogroup(copies.groupBy("segment")).applyInArrow(_sender(SHINGLE_WORDS, ex.bucket_count(segments)), ex.MESSAGE)
    told = sent.groupBy("bucket").applyInArrow(_count, ex.ANSWER).withColumn("ids", F.lit(None).cast("array<struct<doc_id: bigint, digest: bigint>>"))
    told = told.unionByName(copies.select("segment", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("extra"), "ids"))
    make = _vectorizer(SHINGLE_WORDS, total, threshold, bands, rows)
    return parts.groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(make, VECTOR)


def _similarities(key, members, pivots):
    """Weighted Jaccard similarity of each member with the pivot of its group."""
    hp = np.frombuffer(pivots.column("p_hashes")[0].as_py(), "<u8")
    wp = np.frombuffer(pivots.column("p_weights")[0].as_py(), "<f4").astype(np.float64)
    out = []
    for hashes, weights in ex.rows_of(members, "hashes", "weights"):
        h, w = np.frombuffer(hashes, "<u8"), np.frombuffer(weights, "<f4").astype(np.float64)
        at = np.minimum(np.searchsorted(hp, h), len(hp) - 1)
        same = hp[at] == h
        both = np.minimum(wp[at[same]], w[same]).sum()
        out.append(both / (wp.sum() + w.sum() - both))
    n = members.num_rows
    return pa.table({"member": members.column("member"), "pivot": pa.array([key[0].as_py()] * n, pa.int64()),
                     "similarity": pa.array(out, pa.float64())})


def verify(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """member, pivot, similarity of pairs of digests.  A pivot with many members is spread over groups of GROUP_ROWS."""
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
    salted = pairs.join(salts, "pivot").select(
        "member", "pivot", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"))
    left = salted.join(vecs.withColumnRenamed("digest", "member"), "member")
    right = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(
        vecs.withColumnRenamed("digest", "pivot"), "pivot")
    right = right.select(*[F.col(c).alias(f"p_{c}") for c in right.columns])  # own column ids beside those of `left`
    return left.groupBy("pivot", "salt").cogroup(right.groupBy("p_pivot", "p_salt")).applyInArrow(
        lambda key, members, pivots: _similarities(key, members, pivots), "member long, pivot long, similarity double")


def _joined(threshold: float):
    """Components (a, b) of a bucket that a link joins: the texts of block i are compared with those of block j, none with its own component."""
    def joined(key, table):
        block = table.column("block").to_numpy()
        left, right = np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py())
        component = table.column("component").to_numpy()
        hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        weights = [np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("weights").to_pylist()]
        whole = np.array([w.sum() for w in weights])
        gathered = lambda parts, rows: np.concatenate([parts[r] for r in rows] or [parts[0][:0]])
        owner = lambda rows: np.repeat(np.arange(len(rows)), [len(hashes[r]) for r in rows])
        known = gathered(hashes, right)
        order = np.argsort(known, kind="stable")
        known, holder, held = known[order], owner(right)[order], gathered(weights, right)[order]
        asked = gathered(hashes, left)
        low, high = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
        of, weight = owner(left), gathered(weights, left)
        before = np.concatenate([[0], np.cumsum(np.bincount(of, high - low, len(left)))]).astype(np.int64)
        a, b, at = [], [], 0
        while at < len(left):  # some rows at a time, whose shingles meet at most MEETINGS others, or one row
            to = max(at + 1, int(np.searchsorted(before, before[at] + MEETINGS, "right")) - 1)
            own = slice(*np.searchsorted(of, [at, to]))
            n = high[own] - low[own]
            met = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low[own], n)
            both = np.bincount(np.repeat((of[own] - at) * len(right), n) + holder[met], np.minimum(np.repeat(weight[own], n), held[met]), (to - at) * len(right))
            both = both.reshape(to - at, len(right))
            other = component[left[at:to], None] != component[right]
            x, y = np.nonzero(other & (both >= (threshold - SLACK) * (whole[left[at:to], None] + whole[right] - both)))
            a.append(component[left[at:to]][x])
            b.append(component[right][y])
            at = to
        pairs = np.unique(np.stack([np.concatenate([*a, component[:0]]), np.concatenate([*b, component[:0]])], axis=1), axis=0)
        # Of the links only those are kept that join what the ones before them left apart.
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        kept = []
        for c, d in pairs.tolist():
            if (e := top(c)) != (f := top(d)):
                root[e] = f
                kept.append((c, d))
        return pa.table({"a": pa.array([c for c, _ in kept], pa.int64()), "b": pa.array([d for _, d in kept], pa.int64())})

    return joined


def block_links(live: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components of each bucket, all pairs compared but those of the bucket's main component.

    Texts outside the main component are dealt to blocks 0 to asking - 1, those of the main one to the blocks after.  A task
    gets two blocks i <= j of which the first asks, so a text is sent once for each block it meets, not once for each text.
    """
    blocks = lambda asks: F.greatest(F.ceil(F.count_if(asks) / GROUP_ROWS), F.ceil(F.sum(F.when(asks, F.col("bytes"))) / BLOCK_BYTES), F.lit(0)).cast("int")
    asks = F.col("component") != F.col("main")
    sizes = live.groupBy("band", "key").agg(blocks(asks).alias("asking"), blocks(~asks).alias("others"))
    dealt = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    last = F.col("asking") + F.col("others") - 1
    parts = live.join(sizes, ["band", "key"]).withColumn("block", F.when(asks, dealt(F.col("asking"))).otherwise(F.col("asking") + dealt(F.col("others"))))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    earlier = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("asking") - 1)), lambda i: pair(i, F.col("block")))
    later = F.when(asks & (F.col("block") < last), F.transform(F.sequence(F.col("block") + 1, F.greatest(last, F.col("block") + 1)), lambda j: pair(F.col("block"), j)))
    parts = parts.select("digest", "component", "band", "key", "block", F.explode(F.concat(earlier, F.coalesce(later, F.array().cast("array<struct<i:int,j:int>>")))).alias("meets"))
    parts = parts.select("digest", "component", "band", "key", "block", "meets.i", "meets.j").join(content, "digest")
    return parts.groupBy("band", "key", "i", "j").applyInArrow(_joined(threshold), "a long, b long")


def star_links(joined: DataFrame, content: DataFrame, threshold: float) -> DataFrame:
    """Links between the pivots of the buckets and members of other components."""
    # Neither can share more than what it has in common with any document at all.
    most = F.least("shared", "p.shared")
    possible = most >= (threshold - SLACK) * (F.col("whole") + F.col("p.whole") - most) - 1e-6 * F.col("whole")
    asked = joined.filter((F.col("component") != F.col("p.component")) & possible).select(F.col("digest").alias("member"), F.col("p.digest").alias("pivot")).distinct()
    return verify(stored(asked), content).filter(F.col("similarity") >= threshold - SLACK).select(F.col("member").alias("a"), F.col("pivot").alias("b"))


def linked_texts(vecs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest, component of every text that is linked to another."""
    content = vecs.select("digest", "hashes", "weights")
    keys = vecs.select("digest", "whole", "shared", F.octet_length("hashes").alias("bytes"), F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    live = keys.join(shared, ["band", "key"]).withColumn("component", F.col("digest"))
    linked, sent = None, None
    while True:
        # The first pivot is that of the least digest, so that buckets of the same members ask the same pairs; later ones differ.
        order = F.col("digest") if linked is None else F.xxhash64("digest", "band")
        pivots = live.groupBy("band", "key").agg(F.min(F.struct(order.alias("order"), "digest", "component", "whole", "shared")).alias("p"))
        joined = stored(live.join(pivots, ["band", "key"]))
        if linked is None and joined.isEmpty():
            return vecs.select("digest", F.col("digest").alias("component")).limit(0)
        new = stored(star_links(joined, content, threshold))
        linked = new if linked is None else linked.unionByName(new)
        names = components(linked)
        sizes = names.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        names = stored(names.join(sizes, "component").withColumnRenamed("node", "digest"))
        # Each pivot has met all the others and leaves; buckets with one component are done.
        left = joined.filter(F.col("digest") != F.col("p.digest")).select("digest", "band", "key", "whole", "shared", "bytes").join(names, "digest", "left").withColumn(
            "component", F.coalesce("component", "digest")).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
        mixed = left.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"),
                                                F.max(F.struct("size", "component")).getField("component").alias("main")).filter("low <> high")
        live = stored(left.join(mixed.select("band", "key", "n", "main"), ["band", "key"]))
        # As long as a text would be sent to many blocks, and pivots halve that, more pivots are asked.
        was, sent = sent, live.agg(F.sum(F.ceil(F.col("n") / GROUP_ROWS))).first()[0] or 0
        if sent <= MANY_BLOCKS * live.count() or (was is not None and 2 * sent > was):
            break
    names = names.select("digest", "component")
    if not sent:
        return names
    wider = components(stored(block_links(live, content, threshold)))
    both = wider.withColumnRenamed("component", "to").withColumnRenamed("node", "from")
    # A component of the first stage, or a text that had no link, takes the name of the wider one.
    alone = both.join(names, F.col("from") == F.col("digest"), "left_anti").select(F.col("from").alias("digest"), F.col("from").alias("component"))
    return names.unionByName(alone).join(both, F.col("component") == F.col("from"), "left").select("digest", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, segment_rows: int = ex.SEGMENT_ROWS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (the least doc_id of its class), class_size, n_texts (different texts in the class), class_key.

    One row for each row of `docs`; rows that share a doc_id but not the text belong each to the class of its own text, so
    two classes may have one class_id; class_key tells them apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = stored(text_digests(rows))
    vecs = stored(vectors(rows, base, threshold, segment_rows))
    joined = linked_texts(vecs, threshold)
    texts = base.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    labelled = texts.join(joined, "digest", "left").withColumn("root", F.coalesce("component", "digest"))
    classes = labelled.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    of_text = labelled.join(classes, "root").select("digest", F.col("root").alias("class_key"), "class_id", "class_size", "n_texts")
    found = base.filter("digest IS NOT NULL").select("doc_id", "text_key", "digest").join(of_text, "digest").drop("digest")
    empty = base.filter("digest IS NULL").select("doc_id", "text_key", F.col("text_key").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                                F.lit(1).cast("long").alias("n_texts"))
    return found.unionByName(empty)
