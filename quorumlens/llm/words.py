"""Words, their hashes and rolling window hashes of Arrow text columns, as numpy arrays.

The bytes of many documents lie in one Arrow buffer.  Words are found with a 256-entry table over that buffer, never
document by document, so a task spends a few nanoseconds a byte.  Words never cross the end of a document.  Nulls
count as empty texts.

Hashes have 64 bits: a polynomial over the bytes (words) or over word hashes (windows: Rabin-Karp), modulo 2**64, with
a random value for each byte and a final mixing step.  Two different strings of a corpus of n distinct ones share a hash
with a chance of about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes that are worked on at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 20

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_text(text: str) -> int:
    """The hash that `Words.hashes` gives a word."""
    return int(Words(pa.array([text]), np.ones(256, bool)).hashes()[0]) if text else int(mix(np.zeros(1))[0])


def byte_table(*outside: tuple[int, int]) -> np.ndarray:
    """True for every byte but those in the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in outside:
        table[low:high + 1] = False
    return table


# Words of letters, digits and non-ASCII characters; and words between white space.
PLAIN = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE) | np.uint64(1)


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, base, dtype=np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Sum of values[i] * base**(i - start) over each span, modulo 2**64."""
    up, down = powers(int(base), _room(len(values) + 1))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * up[:len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * down[starts]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its documents in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count or not pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = column.buffers()[2]
    found = np.frombuffer(data, dtype=np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return found, offsets - first


def chunks(table: pa.Table | pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, cut so that a piece has at most `size` bytes of text or one row."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        ends = np.cumsum(lengths, dtype=np.int64)
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a text column: byte spans `starts`, `ends`; `bounds[d]:bounds[d + 1]` are the words of document d."""

    column: pa.Array
    table: np.ndarray
    lower: bool = False

    def __post_init__(self) -> None:
        self.data, self.offsets = text_bytes(self.column)
        if self.lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = self.table[self.data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return mix(span_sums(BYTE_VALUE[self.data], self.starts, self.ends, BYTE_BASE))

    def text(self, k: int) -> str:
        return self.data[self.starts[k]:self.ends[k]].tobytes().decode()


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each `width` consecutive words of one document, and the index of its first word."""
    counts = np.diff(bounds)
    each = np.maximum(counts - width + 1, 0)
    total = int(each.sum())
    before = np.cumsum(each) - each
    starts = np.arange(total) + np.repeat(bounds[:-1] - before, each)
    return mix(span_sums(hashes, starts, starts + width, WORD_BASE)), starts


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as bytes: differences, byte planes one after the other, so that high planes compress."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
