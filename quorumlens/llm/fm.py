"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document, none of which is a label, a language, a source or an id:
* words: runs of letters and digits (A-Z lower-cased), and runs of other visible characters, hashed into `BUCKETS` columns; a column's value is the
  logarithm of one plus its count, and all of a document's columns together have length one;
* structure: shares of upper-case letters, digits, marks, marks that follow marks, white space and non-ASCII bytes; means of word and line length;
  shares of words that repeat the word before, of different words, of different lines, and of words without a letter; and the logarithm of the
  number of words, each cut into `STEPS` intervals by quantiles of the sample, one column an interval;
* metadata: the size n_chars states, by powers of two, with a column for its absence.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): every pair of columns interacts through vectors of
`RANK` numbers, and the identity makes that linear in the columns of a document.  Fitted by mini-batches in numpy (AdaGrad on the columns
of a batch only) to the log loss, so the score is a probability.

The classifier is fitted on at most `MOST_ROWS` labelled rows, the first in the order of a hash of doc_id, of those that aren't held out (a documented
bound; the rest of the operator sees every row).  Columns are counted in the tasks; only those of the sample come to the driver.

Null and empty texts have no words and get the score that their structure gives; a null doc_id is scored, never learned.  Labels of an unknown doc_id or
without a value are ignored; rows of a labelled id all count.  Without labels, or with one class only, the score is the share of ones (0.5 if there are none).  Equal texts with equal n_chars get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import BYTE_BASE, BYTE_VALUE, LOWER, byte_table, chunks, mix, span_sums, text_bytes

MOST_ROWS = 6000
BUCKETS = 1 << 15
RANK = 8
STEPS = 8
SIZES = 32
# Passes over the sample, at least so many steps, documents of a step.
EPOCHS, LEAST_UPDATES, BATCH, RATE, SHRINK = 8, 1200, 64, 0.15, 1e-5
THRESHOLD = 0.3
STATISTICS = ("upper", "digit", "mark", "mark_after_mark", "blank", "wide", "word_length", "line_length", "repeats", "different_words", "different_lines", "bare", "n_words")

FEATURES = "doc_id long, size int, stats array<double>, columns array<int>, values array<float>"

# Classes of bytes: 0 white space and control, 1 letters, digits and bytes of other characters, 2 marks.
KIND = np.full(256, 2, np.uint8)
KIND[:0x21] = 0
KIND[byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))] = 1
UPPER, DIGIT, LETTER, WIDE = (np.zeros(256, bool) for _ in range(4))
UPPER[ord("A"):ord("Z") + 1] = True
DIGIT[ord("0"):ord("9") + 1] = True
WIDE[128:] = True
LETTER[:] = (KIND == 1) & ~DIGIT
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _spans(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one kind other than 0 inside a document: starts, ends, documents."""
    n = len(kind)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    kept = kind[starts] != 0
    starts, ends = starts[kept], ends[kept]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _cells(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true bytes inside a document."""
    return _spans(inside.astype(np.uint8), offsets)


def _different(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` for each text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    share = lambda a, b: a / np.maximum(b, 1)
    mark = KIND[data] == 2
    again = mark.copy()
    again[1:] &= mark[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    letters = sums(LETTER[data])
    starts, ends, owner = _cells(~SPACE[data], offsets)
    words = np.bincount(owner, minlength=n)
    hashes = mix(span_sums(BYTE_VALUE[LOWER[data]], starts, ends, BYTE_BASE))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    has_letter = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int64)])
    bare = has_letter[ends] == has_letter[starts]
    l_starts, l_ends, l_owner = _cells(data != 0x0A, offsets)
    lines = np.bincount(l_owner, minlength=n)
    l_hashes = mix(span_sums(BYTE_VALUE[data], l_starts, l_ends, BYTE_BASE))
    return np.column_stack([
        share(sums(UPPER[data]), letters), share(sums(DIGIT[data]), size), share(sums(mark), size), share(sums(again), size), share(sums(SPACE[data]), size),
        share(sums(WIDE[data]), size), share(size - sums(SPACE[data]), words), share(size, lines), share(np.bincount(owner[same], minlength=n), words),
        share(_different(owner, hashes, n), words), share(_different(l_owner, l_hashes, n), lines), share(np.bincount(owner[bare], minlength=n), words), np.log1p(words)])


def hashed_words(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """offsets, columns and values of the words of each text, columns ascending."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    starts, ends, owner = _spans(KIND[data], offsets)
    hashes = mix(span_sums(BYTE_VALUE[LOWER[data]], starts, ends, BYTE_BASE))
    cells, counts = np.unique(owner.astype(np.int64) * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    of = cells // buckets
    values = np.log1p(counts)
    length = np.sqrt(np.bincount(of, values**2, minlength=n))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
    return bounds, (cells % buckets).astype(np.int32), (values / length[of]).astype(np.float32)


def size_column(n_chars: Column) -> Column:
    """The power of two of the stated size, from 1; 0 if there is none."""
    n = n_chars.cast("double")
    return F.coalesce(F.when(n >= 0, F.least(F.floor(F.log2(n + 1)) + 1, F.lit(SIZES - 1))), F.lit(0)).cast("int")


@dataclass
class Sparse:
    """Rows of features; columns of row r are bounds[r]:bounds[r + 1]."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def rows(self, picked: np.ndarray) -> Sparse:
        n = np.diff(self.bounds)[picked]
        bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[picked] - bounds[:-1], n)
        return Sparse(bounds, self.columns[at], self.values[at])


@dataclass
class Machine:
    borders: np.ndarray  # statistics x (STEPS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # columns x RANK

    @staticmethod
    def width(buckets: int = BUCKETS) -> int:
        return buckets + len(STATISTICS) * STEPS + SIZES

    def assemble(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, stats: np.ndarray, sizes: np.ndarray) -> Sparse:
        """Word columns with those of structure and metadata behind them."""
        n, extra = len(sizes), len(STATISTICS) + 1
        buckets = len(self.linear) - self.width(0)
        step = np.stack([np.searchsorted(self.borders[k], stats[:, k], "right") for k in range(len(STATISTICS))], axis=1)
        more = np.concatenate([buckets + np.arange(len(STATISTICS)) * STEPS + step, buckets + len(STATISTICS) * STEPS + sizes[:, None]], axis=1).astype(np.int32)
        words = np.diff(bounds)
        new = np.concatenate([[0], np.cumsum(words + extra)])
        own = np.arange(len(columns)) + np.repeat(np.arange(n) * extra, words)
        rest = (new[1:, None] - extra + np.arange(extra)).ravel()
        out_columns, out_values = np.empty(new[-1], np.int32), np.empty(new[-1], np.float32)
        out_columns[own], out_values[own] = columns, values
        out_columns[rest], out_values[rest] = more.ravel(), 0.5
        return Sparse(new, out_columns, out_values)

    def margins(self, x: Sparse) -> np.ndarray:
        return self.parts(x)[0]

    def parts(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score before the sigmoid, the factor sums of each row, and the scaled factors of each cell."""
        scaled = self.factors[x.columns] * x.values[:, None]
        starts = x.bounds[:-1]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat(scaled * scaled, starts, axis=0)
        first = np.add.reduceat(self.linear[x.columns] * x.values, starts)
        return self.bias + first + 0.5 * (sums * sums - squares).sum(axis=1), sums, scaled

    def scores(self, x: Sparse) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x).astype(np.float64), -30, 30)))


def fit(words: Sparse, stats: np.ndarray, sizes: np.ndarray, labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, seed: int = 11) -> Machine:
    """Fitted to labels 0 and 1; both must occur."""
    draw = np.random.default_rng(seed)
    borders = np.quantile(stats, np.arange(1, STEPS) / STEPS, axis=0).T
    mean = labels.mean()
    width = Machine.width(buckets)
    m = Machine(borders, float(np.log(mean / (1 - mean))), np.zeros(width, np.float32), (draw.normal(size=(width, rank)) * 0.02).astype(np.float32))
    x = m.assemble(words.bounds, words.columns, words.values, stats, sizes)
    seen_linear, seen_factors, seen_bias = np.full(width, 1e-2, np.float32), np.full((width, rank), 1e-2, np.float32), 1e-2
    for _ in range(max(epochs, -(-LEAST_UPDATES * BATCH // len(labels)))):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            picked = order[at:at + BATCH]
            batch = x.rows(picked)
            margin, sums, scaled = m.parts(batch)
            error = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]).astype(np.float32) / len(picked)
            each = np.repeat(error, np.diff(batch.bounds))
            by_sum = np.repeat(sums, np.diff(batch.bounds), axis=0)
            g_linear = each * batch.values
            g_factors = (each * batch.values)[:, None] * (by_sum - scaled)
            # Cells of one column are added up; only columns of the batch move.
            turn = np.argsort(batch.columns, kind="stable")
            columns, firsts = np.unique(batch.columns[turn], return_index=True)
            d_linear = np.add.reduceat(g_linear[turn], firsts) + SHRINK * m.linear[columns]
            d_factors = np.add.reduceat(g_factors[turn], firsts, axis=0) + SHRINK * m.factors[columns]
            seen_linear[columns] += d_linear**2
            seen_factors[columns] += d_factors**2
            m.linear[columns] -= RATE * d_linear / np.sqrt(seen_linear[columns])
            m.factors[columns] -= 0.3 * RATE * d_factors / np.sqrt(seen_factors[columns])
            total = float(error.sum())
            seen_bias += total**2
            m.bias -= RATE * total / seen_bias**0.5
    return m


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), size_column(F.col("n_chars")).alias("size"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            bounds, columns, values = hashed_words(part.column("text"))
            stats = statistics(part.column("text"))
            lists = lambda b, v: pa.ListArray.from_arrays(pa.array(b, pa.int32()), v)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "size": part.column("size"), "stats": lists(np.arange(len(stats) + 1) * len(STATISTICS), pa.array(stats.ravel())),
                "columns": lists(bounds, pa.array(columns)), "values": lists(bounds, pa.array(values)), "label": part.column("label")})


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> pa.Table:
    """Features and labels of at most `most_rows` training rows, the first by a hash of doc_id, which a threshold lets pass.

    The labels are cut down before they meet the documents, so the join's small side has a bounded size.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(in_training(F.col("doc_id")))
    draw = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 40))
    n = known.count()
    share = min(1.0, (1.2 * most_rows + 100) / max(n, 1))
    drawn = known.withColumn("draw", draw).filter(F.col("draw") <= int(share * (1 << 40))).orderBy("draw", "label").limit(most_rows).select("doc_id", "label")
    rows = _plain(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "size", "label")  # at most most_rows ids
    found = rows.mapInArrow(_features, FEATURES + ", label int").withColumn("draw", draw).orderBy("draw", F.hash("columns"), "label").limit(most_rows)
    return found.toArrow()


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Machine | float:
    """The fitted machine, or a constant score if the sample has no two classes."""
    rows = sample(docs, labels, label, most_rows)
    y = rows.column("label").to_numpy().astype(np.float64)
    if len(np.unique(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    flat = lambda name: rows.column(name).combine_chunks()
    columns, values = flat("columns"), flat("values")
    bounds = np.concatenate([[0], np.cumsum(columns.value_lengths().to_numpy())])
    words = Sparse(bounds, columns.flatten().to_numpy(), values.flatten().to_numpy())
    return fit(words, flat("stats").flatten().to_numpy().reshape(-1, len(STATISTICS)), rows.column("size").to_numpy(), y)


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """doc_id and score of every row."""
    plain = _plain(docs)
    if isinstance(model, float):
        return plain.select("doc_id", F.lit(model).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by BUCKETS and RANK

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                text = part.column("text")
                x = m.assemble(*hashed_words(text), statistics(text), part.column("size").to_numpy())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "score": pa.array(m.scores(x))})

    return plain.mapInArrow(scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (score at least `threshold`) of every row, learned from the rows that aren't held out."""
    found = score(docs, train(docs, labels, label, most_rows))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
