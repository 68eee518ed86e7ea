"""Language-model scores: a causal self-attention model in numpy over subword ids, beside a word-count baseline.

A text is its words between white space, A-Z lower-cased, and one end.  Both models give a probability to that sequence.

* Baseline: (c + 1) / (N + V + 1) for each token, with counts c over all training documents.  Segments send the hashes of
  their distinct words to buckets, which answer with the counts (see `exchange`).
* Attention model: each word, with a space before it, is its subword ids.  Windows of `CONTEXT` ids overlap by `OVERLAP`;
  a window scores only what the one before it didn't, so each id is scored once, with at least `OVERLAP` ids of context.
  One layer of masked attention gives the class of the next id; an id's share of its class is counted over all training
  documents.  Classes group ids that follow similar ids.
* The model's probability of a word is COUNTED_SHARE times that of the baseline, which counts whole words but knows no
  context and has one value for all unseen words, and the rest times that of the attention model.

Classes, and the ids with rows of their own, come from counts over all training documents: of ids, and of ids by the common
id before them.  The weights start from at most `SAMPLE_DOCS` training documents and are then trained on all of them, in every
task on its own documents, segment by segment, and averaged by the windows seen.  The texts are encoded once and kept as ids in the shared folder.

Documents with crc32(doc_id) mod 7 = 2 are held out; a null id is crc32 of the empty text.  Null texts are empty: one end.
Equal texts get equal scores.  Without training documents the counts are zero and the weights stay as drawn.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as ex
from .store import stored
from .tokens import VOCABULARY, encoder
from .words import SPACED, Words, chunks, pack_sorted, unpack_sorted

CONTEXT, OVERLAP = 32, 8
WIDTH, CLASSES, OWN_IDS = 16, 64, 4096
SAMPLE_DOCS = 400
BATCH_WINDOWS = 256
# Windows of a training batch whose gradients are made at once, so that arrays stay small; the sums differ in rounding only.
SLICE_WINDOWS = 64
# Windows scored at once.
SCORED_WINDOWS = 64
# Words whose ids a task keeps from segment to segment, about; it starts afresh beyond that.
KNOWN_WORDS = 1 << 19
# Text of one segment.
SEGMENT_BYTES = 8 << 20
# Documents that Spark sends to a worker at once; both hold the texts of a few such batches, Spark outside the heap.
SENT_ROWS = 2048
# Text whose words are hashed at once, places whose pairs are counted at once, and counts of pairs that a task holds.
HASHED_BYTES, PAIR_PLACES, PAIRS_HELD = 1 << 19, 1 << 18, 1 << 19
# Row groups of the stored segments: so many bytes, looked at after each row and not the usual 100, as Spark writes and reads a group at once.
GROUPS = {"parquet.block.size": 8 << 20} | {f"parquet.{x}.size.row.check.{y}": 1 for x in ("page", "block") for y in ("min", "max")}
# Segments whose id counts are added up in one task.
ID_SEGMENTS = 64
EPOCHS, RATE, SMOOTHING = 4, 1e-2, 0.1
# Groups in which the weights of the tasks are added up.
TREE = 16
# The baseline's part of a word's probability.
COUNTED_SHARE = 0.4

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_TYPES = dict(zip([c.split()[0] for c in SCORED.split(", ")], [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2], strict=True))
PARTS = ("embed", "place", "q", "k", "v", "o", "out", "bias")


def give_back() -> None:
    """Freed memory goes back to the system where that can be asked for; a worker would keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


@dataclass
class Subwords:
    """The distinct words of a segment: hashes, ids end to end, and for every word of every document its number."""

    hashes: np.ndarray
    number: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray
    firsts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _spaced(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The words that begin at `starts`, each with a space before it, end to end."""
    after = np.cumsum(sizes + 1)
    out = np.full(int(after[-1]) if len(after) else 0, ord(" "), np.uint8)
    from_ = np.repeat(starts - (after - sizes), sizes + 1) + np.arange(len(out))
    is_word = np.ones(len(out), bool)
    is_word[after - sizes - 1] = False
    out[is_word] = data[from_[is_word]]
    return out.tobytes()


def _encoded(text: bytes, sizes: np.ndarray, encode, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of `_spaced`, end to end, and where each word's begin."""
    ids = encode(text.decode()).astype(np.int32) if text else np.zeros(0, np.int32)
    firsts = np.flatnonzero(opens[ids])
    if len(firsts) != len(sizes):  # other white space in a word has met the space before the next
        after = np.cumsum(sizes + 1).tolist()
        each = [encode(text[a:b].decode()).astype(np.int32) for a, b in zip([0, *after], after)]
        return np.concatenate(each), np.append(np.cumsum([0] + [len(x) for x in each[:-1]]), sum(map(len, each)))
    return ids, np.append(firsts, len(ids))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, where each is first, and for every hash its number among them; only the distinct ones are sorted."""
    found = pa.array(hashes).dictionary_encode()
    seen, code = found.dictionary.to_numpy(), found.indices.to_numpy()
    first = np.empty(len(seen), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    order = np.argsort(seen)
    rank = np.empty(len(seen), np.int64)
    rank[order] = np.arange(len(seen))
    return seen[order], first[order], rank[code]


@dataclass
class Known:
    """Ids of words that were met before: spans of `ids` by sorted hashes."""

    hashes: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls) -> Known:
        return cls(np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3)))

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        return np.append(self.hashes, np.uint64(0))[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool)

    def add(self, hashes: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> None:
        order = np.argsort(both := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = both[order]
        self.begins = np.concatenate([self.begins, firsts[:-1].astype(np.int32) + np.int32(len(self.ids))])[order]
        self.sizes = np.concatenate([self.sizes, np.diff(firsts).astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, end to end, and where each word's begin."""
        at = np.searchsorted(self.hashes, hashes)
        sizes = self.sizes[at]
        return _joined(self.ids, self.begins[at], sizes), np.concatenate([[0], np.cumsum(sizes)])


def subwords(table: pa.Table, vocabulary: str, known: Known | None = None) -> Subwords:
    """The words of the documents as ids; only words that are not known are encoded, and become known."""
    known = known or Known.none()
    hashes, texts, starts, sizes, counts, before = [], [], [], [], [np.zeros(1, np.int64)], 0
    for part in chunks(table, "text", HASHED_BYTES):
        w = Words(part.column("text"), SPACED, lower=True)
        hashes.append(w.hashes())
        texts.append(w.data)
        starts.append(w.starts + before)
        sizes.append(w.ends - w.starts)
        counts.append(w.counts)
        before += len(w.data)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    distinct, first, number = _distinct(joined(hashes, np.uint64))
    new = known.missing(distinct)
    lengths = joined(sizes, np.int64)[first[new]]
    text = _spaced(joined(texts, np.uint8), joined(starts, np.int64)[first[new]], lengths)
    known.add(distinct[new], *_encoded(text, lengths, encoder(vocabulary), _opens(vocabulary)))
    return Subwords(distinct, number, np.cumsum(np.concatenate(counts)), *known.of(distinct))


def _pressed(data: bytes) -> bytes:
    """Compressed before Spark has them: a row of a segment, of which Spark holds several copies and batches, is a third as long."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpressed(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.slice(8), int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8)


# One row a segment: its documents, and `Subwords` as compressed bytes.
ENCODED = ("segment int, doc_id array<bigint>, held_out array<boolean>, hashes binary, number binary, bounds binary, ids binary, sizes binary")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Inside, what runs in this session sends at most SENT_ROWS rows at once to a worker; afterwards the setting is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, now = spark.conf.getAll.get(name), int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, SENT_ROWS) if now > 0 else SENT_ROWS))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def encode_segments(rows: DataFrame, vocabulary: str, segment_rows: int) -> DataFrame:
    """The documents (doc_id, text, held_out) as ids, so that the passes over them encode nothing again.

    A segment is what a task reads one after the other, at most `segment_rows` documents and SEGMENT_BYTES of text (or one document);
    no text is shuffled.
    """
    opens = _opens(vocabulary)

    def encoded(segment: int, table: pa.Table, known: Known) -> pa.RecordBatch:
        sub = subwords(table, vocabulary, known)
        # Byte planes one after the other, so that the high ones compress.
        planes = lambda a: a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        one = lambda data: pa.array([_pressed(data)], pa.binary())
        listed = lambda name, kind: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(name).combine_chunks().cast(kind))
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([segment], pa.int32()), "doc_id": listed("doc_id", pa.int64()), "held_out": listed("held_out", pa.bool_()),
            "hashes": one(pack_sorted(sub.hashes)), "number": one(planes(sub.number)), "bounds": one(sub.bounds.astype("<i8").tobytes()),
            "ids": one(planes(sub.ids)), "sizes": one(planes(np.diff(sub.firsts)))})

    def encode(batches):
        _opens(vocabulary, opens)
        segment, held, n, size, known = TaskContext.get().partitionId() << 12, [], 0, 0, Known.none()
        for batch in batches:
            for part in chunks(batch, "text"):
                for at in range(0, part.num_rows, segment_rows):
                    piece = part.slice(at, segment_rows)
                    more = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                    if held and (n + piece.num_rows > segment_rows or size + more > SEGMENT_BYTES):
                        yield encoded(segment, pa.Table.from_batches(held), known)
                        if segment % 8 == 7:
                            give_back()
                        known = known if len(known.hashes) <= KNOWN_WORDS else Known.none()
                        segment, held, n, size = segment + 1, [], 0, 0
                    held, n, size = [*held, piece], n + piece.num_rows, size + more
        if held:
            yield encoded(segment, pa.Table.from_batches(held), known)
        del held, known
        give_back()

    return rows.select("doc_id", "text", "held_out").mapInArrow(encode, ENCODED)


def decoded(batch: pa.RecordBatch | pa.Table, at: int) -> tuple[Subwords, np.ndarray]:
    """The subwords of the documents of one row, and which of them are held out; without the hashes if they were not read."""
    raw = lambda n: _unpressed(batch.column(n)[at].as_buffer())
    hashes = unpack_sorted(raw("hashes")) if "hashes" in batch.schema.names else np.zeros(0, np.uint64)
    whole = lambda n: np.ascontiguousarray(raw(n).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    sub = Subwords(hashes, whole("number"), raw("bounds").view("<i8"), whole("ids"), np.concatenate([[0], np.cumsum(whole("sizes"))]))
    return sub, np.array(batch.column("held_out")[at].as_py(), bool)


def training_streams(batch: pa.RecordBatch, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """`streams` of the training documents of one row."""
    sub, out = decoded(batch, at)
    words = np.repeat(~out, sub.counts)
    return streams(Subwords(sub.hashes, sub.number[words], np.concatenate([[0], np.cumsum(sub.counts[~out])]), sub.ids, sub.firsts), end)


_OPENS: dict[str, np.ndarray] = {}


def _opens(vocabulary: str, made: np.ndarray | None = None) -> np.ndarray:
    """True for the ids whose text begins with a space; `made` elsewhere, so that a worker needn't load the vocabulary for it."""
    if made is not None:
        _OPENS[vocabulary] = made
    if vocabulary not in _OPENS:
        from tokenizers import Tokenizer

        from .tokens import vocabulary_path

        known = Tokenizer.from_file(vocabulary_path(vocabulary)).get_vocab()
        table = np.zeros(max(known.values()) + 2, bool)
        table[[i for t, i in known.items() if t.startswith("Ġ")]] = True
        _OPENS[vocabulary] = table
    return _OPENS[vocabulary]


def end_id(vocabulary: str) -> int:
    """One more than the last id of a text stands for the end, and for the start as context."""
    return len(_opens(vocabulary)) - 1


def streams(sub: Subwords, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For all documents end to end: end, ids, end; and the bounds of each document in it."""
    sizes = np.diff(sub.firsts)[sub.number] if len(sub.number) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    lengths = before[sub.bounds[1:]] - before[sub.bounds[:-1]]
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.full(starts[-1], end, np.int64)
    inner = np.ones(len(out), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[inner] = _joined(sub.ids, sub.firsts[:-1][sub.number], sizes)
    return out, starts


def _joined(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Spans of the values end to end."""
    after = np.cumsum(sizes)
    at = np.repeat(begins - (after - sizes), sizes)
    at += np.arange(len(at))
    return values.take(at)


def window_starts(starts: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and document of every window.  A document of n predictions begins at its start; later windows overlap."""
    predictions = np.diff(starts) - 1
    step = CONTEXT - overlap
    n = 1 + np.maximum(0, -(-(predictions - CONTEXT) // step))
    doc = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return starts[doc] + turn * step, (starts[:-1] + predictions)[doc], doc


@dataclass
class Model:
    embed: np.ndarray
    place: np.ndarray
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    o: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    class_of: np.ndarray
    row_of: np.ndarray
    emission: np.ndarray | None = None  # log of an id's share of its class
    projected: tuple | None = None  # products of the embeddings and places with `folded`, once weights are final

    def folded(self) -> np.ndarray:
        """q k' and v o side by side: x times the first meets the inputs themselves as keys, x times the second is what an input adds where it is attended to."""
        return np.hstack([self.q @ self.k.T * np.float32(WIDTH**-0.5), self.v @ self.o])

    def settled(self) -> Model:
        """The model with its projections made once; its weights no longer change."""
        wide = np.hstack([np.eye(WIDTH, dtype=np.float32), self.folded()])
        return replace(self, projected=(self.embed @ wide, self.place @ wide))

    def hidden(self, inputs: np.ndarray, skip: int = 0, folded: np.ndarray | None = None) -> tuple:
        """What the classes after positions skip, skip + 1, ... of windows of ids come from.  Weights keep the scores small enough for exp.

        There is one product a window, so that a window's values don't depend on its place among the others.
        """
        n, rows = inputs.shape[1], self.row_of.take(inputs)
        if self.projected is None:
            folded = self.folded() if folded is None else folded
            x = self.embed.take(rows, axis=0)
            x += self.place[:n]
            both = x @ folded
        else:  # x and its products side by side, for every row and every place
            both = self.projected[0].take(rows, axis=0)
            both += self.projected[1][:n]
            x, both = both[..., :WIDTH], both[..., WIDTH:]
        query, value = both[:, skip:, :WIDTH], both[..., WIDTH:]
        turned = np.ascontiguousarray(x.transpose(0, 2, 1))
        s = query @ turned
        np.exp(s, out=s)
        s *= MASK[skip:n, :n]
        whole = s @ np.ones((n, WIDTH), np.float32)  # each sum as often as it divides
        mixed = s @ value
        mixed /= whole
        return x[:, skip:] + mixed, (x, turned, query, s, whole, mixed)

    def forward(self, inputs: np.ndarray, skip: int = 0) -> tuple:
        """Logits of the classes after positions skip, skip + 1, ... of windows of ids."""
        h, kept = self.hidden(inputs, skip)
        return h @ self.out + self.bias, kept

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of the valid places, added up over slices of the windows."""
        n, grads, folded = np.float32(max(valid.sum(), 1)), {}, self.folded()
        dx = np.empty((*inputs.shape, WIDTH), np.float32)
        for at in range(0, len(inputs), SLICE_WINDOWS):
            part = slice(at, at + SLICE_WINDOWS)
            for name, g in self.slice_gradients(inputs[part], targets[part], valid[part], n, folded, dx[part]).items():
                grads[name] = grads[name] + g if at else g
        scores, added = np.hsplit(grads.pop("folded"), 2)
        scores = scores * np.float32(WIDTH**-0.5)
        grads |= {"q": scores @ self.k, "k": scores.T @ self.q, "v": added @ self.o.T, "o": self.v.T @ added, "place": dx.sum(axis=0)}
        rows = self.row_of.take(inputs.reshape(-1))
        order = np.argsort(rows, kind="stable")  # of narrow numbers: by radix
        rows = rows[order]
        firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        grads["embed"] = np.zeros_like(self.embed)
        grads["embed"][rows[firsts]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), firsts, axis=0)
        return grads

    def slice_gradients(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, n: np.float32, folded: np.ndarray, dx: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the classes and of `folded`; those of the embedded ids go into `dx`.  `n` is how many places are valid in the whole batch.

        The bias and the sums of the two softmaxes go into narrow factors, so that no more passes over their entries are made than needed.
        """
        h, (x, turned, query, s, whole, mixed) = self.hidden(inputs, 0, folded)
        logits = h @ self.out
        np.exp(logits, out=logits)
        d, up = logits.reshape(-1, CLASSES), np.exp(self.bias)
        sums = d @ up
        target = self.class_of.take(targets.reshape(-1))
        # The gradient of the logits is d * factor * up, row by row and column by column.
        d.reshape(-1)[np.arange(0, d.size, CLASSES) + target] -= sums / up.take(target)
        sums *= n
        factor = valid.reshape(-1) / sums
        wide = np.repeat(factor, WIDTH).reshape(h.shape)
        h *= wide
        grads = {"out": (h.transpose(0, 2, 1) @ logits).sum(axis=0) * up, "bias": (factor @ d) * up}
        dh = logits @ np.ascontiguousarray((self.out * up).T)
        dh *= wide
        g = dh / whole
        ds = g @ (np.ascontiguousarray(folded[:, WIDTH:].T) @ turned)  # the values, turned
        mixed *= g
        ds -= mixed @ np.ones((WIDTH, inputs.shape[1]), np.float32)
        ds *= s
        dboth = np.empty((*inputs.shape, 2 * WIDTH), np.float32)
        np.matmul(ds, x, out=dboth[..., :WIDTH])
        np.matmul(s.transpose(0, 2, 1), g, out=dboth[..., WIDTH:])
        grads["folded"] = (turned @ dboth).sum(axis=0)
        np.matmul(ds.transpose(0, 2, 1), query, out=dx)
        dx += dh
        dx += dboth @ np.ascontiguousarray(folded.T)
        return grads

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in PARTS])

    def set(self, values: np.ndarray) -> None:
        at = 0
        for n in PARTS:
            old = getattr(self, n)
            setattr(self, n, values[at:at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size


MASK = np.tri(CONTEXT, dtype=np.float32)


@dataclass
class Moments:
    """What Adam keeps from step to step."""

    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    turn: int = 0

    @classmethod
    def of(cls, model: Model) -> Moments:
        return cls(*({n: np.zeros_like(getattr(model, n)) for n in PARTS} for _ in range(2)))


def _windows(stream: np.ndarray) -> np.ndarray:
    """For each place the ids from it on, as many as a window reads and the one after; a view, with ends behind the stream."""
    return np.lib.stride_tricks.sliding_window_view(np.append(stream, np.full(CONTEXT, stream[-1] if len(stream) else 0)), CONTEXT + 1)


def _step(weights: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, turn: int, rate: float) -> None:
    """One step of Adam, in place; `g` is used up."""
    root = (1 - 0.99**turn)**0.5
    step = g - first
    step *= np.float32(0.1)
    first += step
    g *= g
    g -= second
    g *= np.float32(0.01)
    second += g
    np.sqrt(second, out=g)
    g += np.float32(1e-7 * root)
    np.divide(first, g, out=g)
    g *= np.float32(rate * root / (1 - 0.9**turn))
    weights -= g


def train(model: Model, stream: np.ndarray, starts: np.ndarray, epochs: int, rate: float = RATE, moments: Moments | None = None, batch: int = BATCH_WINDOWS // 4) -> int:
    """Adam steps over shuffled windows, from `moments` on; returns how many windows there are.  Windows lie side by side: each id is learned once."""
    begin, end, _ = window_starts(starts, 0)
    moments = moments or Moments.of(model)
    turn = moments.turn
    rng = np.random.default_rng(5)
    windows = _windows(stream)
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        for at in range(0, len(order), batch):
            own = order[at:at + batch]
            ids = windows[begin[own]]
            valid = np.arange(CONTEXT) < (end - begin)[own, None]
            grads = model.gradients(ids[:, :-1], ids[:, 1:], valid)
            turn += 1
            for n, g in grads.items():
                _step(getattr(model, n), g, moments.first[n], moments.second[n], turn, rate)
    moments.turn = turn
    return len(begin)


def columns(count: np.ndarray) -> np.ndarray:
    """For each id its place among the 127 most common ones, else 127."""
    common = np.argsort(-count, kind="stable")[:127]
    column = np.full(len(count), 127)
    column[common] = np.arange(len(common))
    return column


def pairs_of(stream: np.ndarray, starts: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 * id + column of the id before it, and how often that stands in the documents."""
    inner = np.ones(len(stream), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    return np.unique(stream[at] * 128 + column[stream[at - 1]], return_counts=True)


def pairs_in_parts(stream: np.ndarray, starts: np.ndarray, column: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`pairs_of` one stretch of places after the other; each begins with the id before it."""
    for at in range(0, len(stream), PAIR_PLACES):
        first, last = max(at - 1, 0), min(at + PAIR_PLACES, len(stream))
        own = starts[np.searchsorted(starts, at):np.searchsorted(starts, last)] - first
        yield pairs_of(stream[first:last], np.concatenate([[0], own, [last - first]]), column)


def added_pairs(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The parts added up: sorted keys and counts, in more than one piece where there are more than half of PAIRS_HELD keys."""
    held, size = [], 0
    for part in parts:
        held, size = [*held, part], size + len(part[0])
        if size > PAIRS_HELD:
            held = [_sums(held)]
            size = len(held[0][0])
            if size > PAIRS_HELD // 2:
                yield held[0]
                held, size = [], 0
    if size:
        yield _sums(held)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = map(np.concatenate, zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[firsts], np.add.reduceat(n, firsts)


def classes(count: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A class for every id: k-means over the ids that stand before it; ids that are too rare share classes by their number."""
    size = len(count)
    known = np.flatnonzero(count >= 5)
    out = np.arange(size) % CLASSES
    if len(known) < CLASSES:
        return out
    row = np.full(size, -1)
    row[known] = np.arange(len(known))
    keys, n = pairs
    pair = row[keys // 128] >= 0
    seen = np.zeros((len(known), 128))
    seen[row[keys[pair] // 128], keys[pair] % 128] = n[pair]
    seen = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    weight = count[known].astype(float)
    centre = seen[np.argsort(-weight, kind="stable")[:CLASSES]].copy()
    for _ in range(15):
        near = (seen @ centre.T * 2 - (centre**2).sum(axis=1)).argmax(axis=1)
        for c in range(CLASSES):
            if (near == c).any():
                centre[c] = np.average(seen[near == c], axis=0, weights=weight[near == c])
    out[known] = near
    return out


def fresh(stream: np.ndarray, size: int, count: np.ndarray | None = None, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """A model with drawn weights; classes and the ids with rows of their own come from the counts, or else those of the stream."""
    rng = np.random.default_rng(3)
    if count is None or pairs is None:
        count = np.bincount(stream, minlength=size)
        pairs = pairs_of(stream, np.array([0, len(stream)]), columns(count)) if len(stream) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    class_of = classes(count, pairs)
    row_of = OWN_IDS + class_of
    common = np.argsort(-count, kind="stable")[:OWN_IDS]
    row_of[common] = np.arange(len(common))
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Model(draw(OWN_IDS + CLASSES, WIDTH), draw(CONTEXT, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH), draw(WIDTH, WIDTH),
                 draw(WIDTH, WIDTH), draw(WIDTH, CLASSES), np.zeros(CLASSES, np.float32), class_of.astype(np.uint8), row_of.astype(np.uint16))


def log_probabilities(model: Model, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place of the streams the natural logarithm of its id's probability; 0 at the start of a document."""
    begin, end, _ = window_starts(starts)
    windows, of_class = _windows(stream), _windows(model.class_of[stream])
    out = np.zeros(len(stream))
    up = np.exp(model.bias)[:, None]
    opening = np.isin(begin, starts[:-1])
    for skip, own in ((0, np.flatnonzero(opening)), (OVERLAP, np.flatnonzero(~opening))):
        for at in range(0, len(own), SCORED_WINDOWS):
            some = begin[own[at:at + SCORED_WINDOWS]]
            h, _ = model.hidden(windows[some, :CONTEXT], skip)
            logits = h @ model.out  # the bias goes into the sum and the class that is asked for
            asked = of_class[some, skip + 1:]
            got = logits.take(np.arange(0, logits.size, CLASSES).reshape(asked.shape) + asked) + model.bias.take(asked)
            np.exp(logits, out=logits)
            got -= np.log((logits @ up)[..., 0])
            valid = np.arange(skip, CONTEXT) < (end[own[at:at + SCORED_WINDOWS]] - some)[:, None]
            out[(some[:, None] + np.arange(skip + 1, CONTEXT + 1))[valid]] = got[valid]
    out += model.emission[stream]
    out[starts[:-1]] = 0
    return out


def word_log_probabilities(values: np.ndarray, starts: np.ndarray, sub: Subwords) -> np.ndarray:
    """Sums over the ids of each word, document by document, each followed by its end."""
    sizes = np.diff(sub.firsts)[sub.number] if len(sub.number) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(sub.counts)), sub.counts)
    before = np.cumsum(sizes) - sizes
    first = np.concatenate([before + 2 * doc + 1, starts[1:] - 1])  # of words, then of ends
    # From each to the next; the start of a document, between an end and a word, has value 0.
    return np.add.reduceat(values, np.sort(first)) if len(first) else np.zeros(0)


def _sender(vocabulary: str, buckets: int):
    end = end_id(vocabulary)

    def send(batches):
        for batch in batches:
            for at, segment in enumerate(batch.column("segment").to_pylist()):
                sub, out = decoded(batch, at)
                n = np.bincount(sub.number[np.repeat(~out, sub.counts)], minlength=len(sub.hashes))
                ids = np.bincount(sub.ids, np.repeat(n, np.diff(sub.firsts)), end + 1).astype("<i8")
                ids[end] += int((~out).sum())
                some = np.flatnonzero(ids)
                of_ids = pa.table({
                    "bucket": pa.array([buckets + segment // ID_SEGMENTS], pa.int32()), "segment": pa.array([-1 - segment], pa.int32()),
                    "hashes": pa.array([pack_sorted(some.astype(np.uint64))], pa.binary()), "extra": pa.array([ids[some].tobytes()], pa.binary())})
                yield from pa.concat_tables([ex.messages(segment, sub.hashes, buckets, n.astype("<u4")), of_ids]).to_batches()

    return send


# The answers of the buckets have no hashes: a segment knows what it asked.
TOLD = "segment int, bucket int, ids binary, counts binary, tokens long, types long"


def _planes(counts: np.ndarray) -> bytes:
    """Counts as byte planes one after the other; the high ones, of zeros, compress."""
    return counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _count(table):
    """For each segment, the counts of its words in the order of its message; the first row also has the bucket's sums of counts and of counted words.

    Messages of negative segments hold id counts; these are added up, and the sums are one row of a negative segment.
    """
    rows = sorted(ex.rows_of(table, "segment", "hashes", "extra"))
    parts = [unpack_sorted(r[1]) for r in rows]
    flat, number = np.unique(np.concatenate(parts), return_inverse=True)
    of_ids = rows[0][0] < 0
    n = np.bincount(number, np.concatenate([np.frombuffer(r[2], "<i8" if of_ids else "<u4") for r in rows]), len(flat)).astype("<i8")
    if of_ids:
        zero = pa.array([0], pa.int64())
        return pa.table({"segment": pa.array([-1], pa.int32()), "bucket": table.column("bucket").slice(0, 1), "ids": pa.array([pack_sorted(flat)], pa.binary()),
                         "counts": pa.array([_planes(n)], pa.binary()), "tokens": zero, "types": zero})
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    first = [1] + [0] * (len(rows) - 1)
    return pa.table({
        "segment": pa.array([r[0] for r in rows], pa.int32()), "bucket": table.column("bucket"), "ids": pa.array([None] * len(rows), pa.binary()),
        "counts": pa.array([_planes(n[number[a:b]]) for a, b in zip(at, at[1:])], pa.binary()),
        "tokens": pa.array([int(n.sum()) * f for f in first], pa.int64()), "types": pa.array([int((n > 0).sum()) * f for f in first], pa.int64())})


def _scorer(model, vocabulary: str, docs_n: int, tokens: int, types: int):
    end = end_id(vocabulary)

    def score(key, docs, told):
        m = model.value
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in SCORED_TYPES.items()})
        sub, _ = decoded(docs, 0)  # one row a segment
        # Buckets cut the sorted hashes, so their answers one after the other are the counts of the segment's words.
        c = np.concatenate([_unplaned(x) for _, x in sorted(ex.rows_of(told, "bucket", "counts"))] or [np.zeros(0, np.int64)])
        below = np.log10(float(tokens + types + 1))
        each = np.concatenate([[0.0], np.cumsum(np.log10(c + 1.0)[sub.number])])
        hit = np.concatenate([[0], np.cumsum((c > 0)[sub.number])])
        lengths = sub.counts + 1
        base = each[sub.bounds[1:]] - each[sub.bounds[:-1]] + np.log10(docs_n + 1.0) - lengths * below
        stream, starts = streams(sub, end)
        attention = word_log_probabilities(log_probabilities(m, stream, starts), starts, sub)
        ends = sub.bounds[1:] + np.arange(len(lengths))  # of the documents, counted in words and ends
        counted = np.empty(len(attention))
        counted[ends] = docs_n
        is_word = np.ones(len(attention), bool)
        is_word[ends] = False
        counted[is_word] = c[sub.number]
        word = np.logaddexp(np.log(COUNTED_SHARE * (counted + 1) / (tokens + types + 1)), np.log(1 - COUNTED_SHARE) + attention) / np.log(10)
        opening = np.concatenate([[0], ends[:-1] + 1])
        return pa.table({
            "doc_id": pa.array(docs.column("doc_id")[0].as_py(), pa.int64()), "held_out": pa.array(docs.column("held_out")[0].as_py(), pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(hit[sub.bounds[1:]] - hit[sub.bounds[:-1]] + (docs_n > 0), pa.int64()),
            "train_tokens": pa.array(np.full(len(lengths), tokens), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(np.add.reduceat(word, opening), pa.float64())})

    return score


def id_pairs(encoded: DataFrame, count: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """`pairs_of` all training documents, added up inside the tasks first; at most 128 rows an id of the vocabulary."""
    sent, end = encoded.sparkSession.sparkContext.broadcast(columns(count)), end_id(vocabulary)

    def pairs(batches):
        parts = (part for batch in batches for at in range(batch.num_rows) for part in pairs_in_parts(*training_streams(batch, at, end), sent.value))
        for keys, n in added_pairs(parts):
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})
        give_back()

    found = encoded.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return found.column("key").to_numpy(), found.column("n").to_numpy()


def _added(table: pa.Table) -> pa.Table:
    return pa.table({"value": pa.array([np.sum([np.frombuffer(v.as_py(), "<f8") for v in table.column("value")], axis=0).tobytes()], pa.binary())})


def first_texts(train_docs: DataFrame) -> list[str]:
    """The texts of the SAMPLE_DOCS least rows by a hash of the id, the id and the text.

    The least hashes are found without texts, so that only rows up to the last of them are read with texts; where many rows share
    an id these are merged in a task.  The driver gets SAMPLE_DOCS texts, not as many from each task.
    """
    rows = train_docs.select(F.xxhash64(F.lit("lm"), "doc_id").alias("draw"), "doc_id", "text")
    least = rows.select("draw").orderBy("draw").limit(SAMPLE_DOCS).agg(F.max("draw")).first()[0]
    if least is None:
        return []
    found = rows.filter(F.col("draw") <= least).orderBy("draw", "doc_id", "text").limit(SAMPLE_DOCS).select("text")
    return [r["text"] for r in found.repartition(1).collect()]


def fit(train_docs: DataFrame, encoded: DataFrame, count: np.ndarray, vocabulary: str) -> Model:
    """Classes from counts over all training documents; first weights from a bounded sample, trained further on all documents."""
    spark = train_docs.sparkSession
    end = end_id(vocabulary)
    texts = first_texts(train_docs)
    stream, starts = streams(subwords(pa.table({"text": pa.array(texts, pa.string())}), vocabulary), end)
    model = fresh(stream, end + 1, count, id_pairs(encoded, count, vocabulary))
    if len(texts):
        train(model, stream, starts, EPOCHS)
    sent = spark.sparkContext.broadcast(model)

    def train_on(batches):
        # A worker keeps what was broadcast from task to task, so each trains weights of its own.
        mine, n = replace(sent.value, **{x: getattr(sent.value, x).copy() for x in PARTS}), 0
        moments = Moments.of(mine)
        for batch in batches:
            for at in range(batch.num_rows):
                stream, starts = training_streams(batch, at, end)
                if len(starts) > 1:
                    n += train(mine, stream, starts, 1, RATE / 3, moments, BATCH_WINDOWS)
        if n:
            yield pa.RecordBatch.from_pydict({"value": pa.array([np.append(mine.flat().astype("<f8") * n, n).tobytes()], pa.binary())})

    # One row of weights a task, added up in groups of tasks before the driver adds the rest.
    sums = encoded.mapInArrow(train_on, "value binary").withColumn("group", F.spark_partition_id() % TREE).groupBy("group").applyInArrow(
        lambda table: _added(table), "value binary").collect()
    if sums:
        values = np.sum([np.frombuffer(r["value"], "<f8") for r in sums], axis=0)
        model.set(values[:-1] / values[-1])
    return model


def with_emission(model: Model, counts: np.ndarray) -> None:
    """Shares of the ids in their classes, from counts of the ids."""
    n = counts + SMOOTHING
    model.emission = np.log(n / np.bincount(model.class_of, n, CLASSES)[model.class_of]).astype(np.float32)


def id_counts(told: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in training documents: sums of the rows of negative segments."""

    def spread(batches):
        for batch in batches:
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_pydict({"id": pa.array(unpack_sorted(ids).astype(np.int64)), "n": pa.array(_unplaned(n))})

    sums = told.filter("segment < 0").select("ids", "counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)  # one number for each id of the vocabulary
    out[sums["id"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=np.int64)
    return out


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, segment_rows: int = ex.SEGMENT_ROWS) -> DataFrame:
    """One row for each row of `docs`: see SCORED."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    train_docs = rows.filter(~F.col("held_out"))
    n_docs, n_train = rows.count(), docs.select("doc_id").filter(~held_out(F.col("doc_id"))).count()
    segments = max(1, -(-n_docs // segment_rows))
    with small_batches(spark):
        encoded = stored(encode_segments(rows, vocabulary, segment_rows), **GROUPS)
    sent = encoded.mapInArrow(_sender(vocabulary, ex.bucket_count(segments)), ex.MESSAGE)
    told = stored(sent.groupBy("bucket").applyInArrow(_count, TOLD))
    encoded = encoded.drop("hashes")
    sums = told.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = (sums[0] or 0) + n_train, (sums[1] or 0) + (n_train > 0)
    count = id_counts(told, end_id(vocabulary) + 1)
    model = fit(train_docs, encoded, count, vocabulary)
    with_emission(model, count)
    score = _scorer(spark.sparkContext.broadcast(model.settled()), vocabulary, n_train, tokens, types)
    return encoded.groupBy("segment").cogroup(told.filter("segment >= 0").select("segment", "bucket", "counts").groupBy("segment")).applyInArrow(score, SCORED)
