"""Language identification with a string kernel.

Two texts are compared by their blended spectrum: the kernel counts the byte n-grams, n from 1 to `longest`, that are
present in both (A-Z lower-cased; every ASCII byte that isn't a letter is one symbol), divided by the geometric mean of the
counts of the two.  Only n-grams of the landmarks are counted.  Nystroem: `landmarks` texts of each language stand for the kernel's feature space;
one-versus-rest kernel ridge regression is solved in it.  A batch of documents is a presence matrix; its product with the
weights of the n-grams, summed over landmarks beforehand, gives the scores of all classes.

The classifier is fitted on at most `per_language` labelled documents of each language (at most `MOST_ROWS` in all), the
first in the order of a hash of doc_id.  The score is the predicted class's share after a softmax of the scores.

Null texts and texts without a letter are `und` with score 0.  Rows with a null label teach nothing but are predicted.
Equal texts get equal results.  With no labelled row at all, every document is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks, text_bytes

PER_LANGUAGE, LANDMARKS, MOST_ROWS = 200, 40, 4000
LONGEST = 3
RIDGE = 1e-2
SHARPNESS = 8.0
UNKNOWN = "und"
PREDICTED = "doc_id long, text_key long, lang_pred string, score double"
# Documents of one presence matrix.
BATCH_DOCS = 64

# Symbols: 0 for ASCII bytes that aren't letters, then a-z, then the 128 bytes of other characters.
SYMBOL = np.zeros(256, np.int32)
SYMBOL[ord("a"):ord("z") + 1] = np.arange(1, 27)
SYMBOL[ord("A"):ord("Z") + 1] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
SYMBOLS = 155


def _codes(data: np.ndarray, offsets: np.ndarray, longest: int):
    """For n = 1, 2, ...: the n-gram codes and the document of each."""
    symbols = SYMBOL[data]
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = symbols
    for n in range(1, longest + 1):
        if n > 1:
            code = code[:-1] * SYMBOLS + symbols[n - 1:]
        inside = owner[:len(code)] == owner[n - 1:]
        yield n, code[inside], owner[:len(code)][inside]


@lru_cache(maxsize=2)
def _lookup(grams: bytes, longest: int) -> list[np.ndarray]:
    """For each n, the column of every possible code, or -1."""
    known = np.frombuffer(grams, "<i8")
    tables = []
    for n in range(1, longest + 1):
        table = np.full(SYMBOLS**n, -1, np.int32)
        own = np.flatnonzero(known // SYMBOLS**longest == n)
        table[known[own] % SYMBOLS**longest] = own
        tables.append(table)
    return tables


def presence(column: pa.Array, grams: np.ndarray, longest: int) -> np.ndarray:
    """True where a document has an n-gram; grams are n * SYMBOLS**longest + code."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(grams) + 1), bool)
    tables = _lookup(grams.astype("<i8").tobytes(), longest)
    for n, codes, owner in _codes(data, offsets, longest):
        out[owner, tables[n - 1][codes]] = True  # unknown n-grams mark the last column
    return out[:, :-1]


@dataclass
class Model:
    grams: np.ndarray
    weights: np.ndarray  # n-grams x languages
    bias: np.ndarray
    languages: list[str]
    longest: int = LONGEST

    def scores(self, column: pa.Array) -> np.ndarray:
        seen = presence(column, self.grams, self.longest).astype(np.float32)
        return seen @ self.weights / np.sqrt(np.maximum(seen.sum(axis=1, keepdims=True), 1)) + self.bias


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, longest: int = LONGEST, ridge: float = RIDGE) -> Model:
    """Fitted from a list of labelled texts; the first `landmarks` of each language are the landmarks."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    marks = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(languages))])
    codes = [np.zeros(0, np.int64)]
    for i in marks:
        for n, code, _ in _codes(*text_bytes(pa.array([texts[i]])), longest):
            codes.append(np.unique(code).astype(np.int64) + n * SYMBOLS**longest)
    grams = np.unique(np.concatenate(codes))
    seen = np.concatenate([presence(pa.array(texts[i:i + BATCH_DOCS]), grams, longest).astype(np.float32) for i in range(0, len(texts), BATCH_DOCS)])
    norm = np.sqrt(np.maximum(seen.sum(axis=1), 1))
    of_marks = seen[marks] / norm[marks, None]
    kernel = (seen / norm[:, None]) @ of_marks.T
    inner = kernel[marks].astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > 1e-6 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel.astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language counts the same, however many of its rows are there.
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    weight /= weight.mean()
    mean_x, mean_y = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    x = features - mean_x
    solved = np.linalg.solve((x * weight[:, None]).T @ x + ridge * len(texts) * np.eye(x.shape[1]), (x * weight[:, None]).T @ (target - mean_y))
    return Model(grams, (of_marks.T.astype(np.float64) @ (root @ solved)).astype(np.float32), mean_y - mean_x @ solved, languages, longest)


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(True))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> tuple[list[str], list[str]]:
    """Texts and labels of at most `per_language` training rows of each language.

    Rows pass a hash threshold that lets about twice as many through as are wanted, so no language is sorted whole.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(most_rows).collect()}
    if not counts:
        return [], []
    each = max(1, min(per_language, most_rows // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * each + 20) / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(draw < share[F.col("lang")]).filter(has_letter(F.col("text"))).select("lang", "text", draw.alias("draw"), "doc_id").collect()
    texts, labels = [], []
    for lang in sorted(counts):
        own = sorted((r for r in drawn if r["lang"] == lang), key=lambda r: (r["draw"], r["doc_id"] or 0))[:each]
        texts += [r["text"] for r in own]
        labels += [lang] * len(own)
    return texts, labels


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), lang_pred, score of each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    letter = has_letter(F.col("text"))
    if model is None:
        return plain.select("doc_id", "text_key", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = sent.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            for part in chunks(batch, "text"):
                for at in range(0, part.num_rows, BATCH_DOCS):
                    some = part.slice(at, BATCH_DOCS)
                    f = m.scores(some.column("text"))
                    share = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)))
                    share /= share.sum(axis=1, keepdims=True)
                    yes = some.column("letter").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": some.column("doc_id"), "text_key": some.column("text_key"), "lang_pred": pa.array(np.where(yes, names[f.argmax(axis=1)], UNKNOWN), pa.string()),
                        "score": pa.array(np.where(yes, share.max(axis=1), 0.0).astype(np.float64), pa.float64())})

    return plain.withColumn("letter", letter).mapInArrow(score, PREDICTED)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, text_key: fitted on the labelled rows of `docs` that aren't held out."""
    texts, labels = sample(docs)
    found = predict(docs, fit(texts, labels) if texts else None)
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "text_key")
