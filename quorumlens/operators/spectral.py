"""Spectral regions of the label graph (G12): leading eigenvectors by block Krylov iteration, and k-means for all sizes at once.

The matrix N = D^-1/2 A D^-1/2 is stored in square cells of `ROWS` labels, one binary row each, and a set of vectors in blocks of
`ROWS` labels, one binary row each; a product is one join of cells with blocks and one sum.  How many blocks there are follows from the
number of labels.  Matrices whose size is that of the basis (a multiple of the number of wanted vectors) are handled on
the driver; nothing else comes there.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionary import decoded, dictionary, encoded
from ..functions.lineage import written

# Labels of one block, extra vectors of a block of the basis, and blocks of the basis before it is collapsed.
ROWS, EXTRA, DEPTH = 1024, 8, 6
TOLERANCE, MOST_ROUNDS = 1e-7, 200
BLOCK_SCHEMA = "block long, basis binary, image binary, gram binary"


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<f8").reshape(-1, columns)


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype="<f8").tobytes()


def normalised(affinity: DataFrame) -> DataFrame:
    """Entries (src, dst, w) of D^-1/2 A D^-1/2; negative and diagonal values count as 0."""
    a = affinity.filter("src <> dst AND w > 0").select("src", "dst", "w")
    deg = a.groupBy("src").agg(F.sum("w").alias("_d"))
    return a.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("_d").alias("_e")), "dst").select(
        "src", "dst", (F.col("w") / F.sqrt(F.col("_d") * F.col("_e"))).alias("w"))


def cells(entries: DataFrame) -> DataFrame:
    """(row, col, data): the entries (src, dst, w) of each square of ROWS x ROWS ids, packed."""
    placed = entries.select(
        F.floor(F.col("src") / ROWS).alias("row"), F.floor(F.col("dst") / ROWS).alias("col"), (F.col("src") % ROWS).cast("int").alias("i"),
        (F.col("dst") % ROWS).cast("int").alias("j"), F.col("w").cast("double").alias("w"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        flat = [table.column(c).to_numpy() for c in ("i", "j", "w")]
        data = np.concatenate([np.array([table.num_rows], "<i4"), flat[0].astype("<i4"), flat[1].astype("<i4")]).tobytes() + flat[2].astype("<f8").tobytes()
        return pa.table({"row": pa.array([key[0].as_py()]), "col": pa.array([key[1].as_py()]), "data": pa.array([data], pa.binary())})

    return placed.groupBy("row", "col").applyInArrow(pack, "row long, col long, data binary")


def _times(data: bytes, x: np.ndarray, rows: int) -> np.ndarray:
    n = int(np.frombuffer(data, "<i4", 1)[0])
    at = np.frombuffer(data, "<i4", 2 * n, 4)
    i, j, w = at[:n], at[n:], np.frombuffer(data, "<f8", n, 4 + 8 * n)
    out = np.zeros((rows, x.shape[1]))
    order = np.argsort(i, kind="stable")
    i, firsts = np.unique(i[order], return_index=True)
    out[i] = np.add.reduceat(w[order, None] * x[j[order]], firsts, axis=0)
    return out


def _size(block: int, labels: int) -> int:
    return min(ROWS, labels - block * ROWS)


def product(matrix: DataFrame, vectors: DataFrame, columns: int, labels: int) -> DataFrame:
    """(block, image) of N X for the blocks (block, x) of X."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, x in zip(*[batch.column(c) for c in ("row", "data", "x")], strict=True):
                part = _times(data.as_py(), _matrix(x.as_py(), columns), _size(row.as_py(), labels))
                yield pa.RecordBatch.from_pydict({"block": pa.array([row.as_py()]), "part": pa.array([_bytes(part)], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(_matrix(p.as_py(), columns) for p in table.column("part"))
        return pa.table({"block": pa.array([key[0].as_py()]), "image": pa.array([_bytes(total)], pa.binary())})

    met = matrix.join(vectors.select(F.col("block").alias("col"), "x"), "col").select("row", "data", "x")
    return met.mapInArrow(multiply, "block long, part binary").groupBy("block").applyInArrow(add, "block long, image binary")


def _added(df: DataFrame, column: str, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices in a binary column; one a task comes to the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for data in batch.column(0):
                total += _matrix(data.as_py(), shape[1])
        yield pa.RecordBatch.from_pydict({"m": pa.array([_bytes(total)], pa.binary())})

    return sum((_matrix(r["m"], shape[1]) for r in df.select(column).mapInArrow(add, "m binary").collect()), np.zeros(shape))


def _start(block: int, labels: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, block]).uniform(-1, 1, (_size(block, labels), width))


def _ritz(a: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, falling, and coefficients of the best approximations in a basis with Gram matrix s."""
    size, turn = np.linalg.eigh(s)
    kept = size > 1e-12 * size[-1]
    z = turn[:, kept] / np.sqrt(size[kept])
    values, vectors = np.linalg.eigh(z.T @ a @ z)
    return values[::-1], z @ vectors[:, ::-1]


def leading(matrix: DataFrame, labels: int, k: int, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """The k eigenvectors of N with the largest eigenvalues, as blocks (block, x), and the eigenvalues, falling.

    Block Krylov with Rayleigh-Ritz: in every round the newest block of the basis is multiplied by N and what is new in the product is the
    next block; after `DEPTH` blocks the basis collapses to its best vectors.  Basis B and image N B stay together, so their Gram
    matrices give the residuals of all approximations.  Ends when the residuals of k vectors are below TOLERANCE or the space is exhausted.
    """
    spark = matrix.sparkSession
    k = min(k, labels)
    width = min(k + EXTRA, labels)
    blocks = spark.range(-(-labels // ROWS)).withColumnRenamed("id", "block")

    def starting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_start(b.as_py(), labels, width, seed) for b in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"block": batch.column(0), "basis": pa.array([b""] * len(x), pa.binary()),
                                              "image": pa.array([_bytes(m) for m in x], pa.binary()), "gram": pa.array([_bytes(m.T @ m) for m in x], pa.binary())})

    table = written(blocks.mapInArrow(starting, BLOCK_SCHEMA))
    first = _added(table, "gram", (width, width))
    # Gram matrices of the basis with itself, of the basis with its image, and of the image with itself.
    s = a = t = np.zeros((0, 0))
    # The next block is image @ take - basis @ drop; before the first round `image` holds the random start.
    size, turn = np.linalg.eigh(first)
    take, drop, m, held = turn / np.sqrt(np.maximum(size, 1e-300)), np.zeros((0, width)), 0, width

    def extended(df: DataFrame, take: np.ndarray, drop: np.ndarray, m: int, held: int, fresh: bool) -> DataFrame:
        """basis with the next block, image and the block alone."""
        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, basis, image in zip(*[batch.column(c) for c in ("block", "basis", "image")], strict=True):
                    image = _matrix(image.as_py(), held)
                    basis = _matrix(basis.as_py(), m) if m else np.zeros((len(image), 0))
                    new = image @ take - basis @ drop
                    if fresh:
                        image = image[:, :0]
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([block.as_py()]), "basis": pa.array([_bytes(np.hstack([basis, new]))], pa.binary()),
                        "image": pa.array([_bytes(image)], pa.binary()), "x": pa.array([_bytes(new)], pa.binary())})

        return df.select("block", "basis", "image").mapInArrow(extend, "block long, basis binary, image binary, x binary")

    def joined(df: DataFrame, m: int, held: int, new: int) -> DataFrame:
        """Image with that of the newest block; gram: (basis, image) against (newest block, its image)."""
        def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, basis, image, last in zip(*[batch.column(c) for c in ("block", "basis", "image", "last")], strict=True):
                    basis = _matrix(basis.as_py(), m)
                    last = np.zeros((len(basis), new)) if last.as_py() is None else _matrix(last.as_py(), new)
                    image = np.hstack([_matrix(image.as_py(), held), last]) if held else last
                    gram = np.vstack([basis.T @ np.hstack([basis[:, m - new:], last]), image.T @ np.hstack([basis[:, m - new:], last])])
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block.as_py()]), "basis": pa.array([_bytes(basis)], pa.binary()),
                                                      "image": pa.array([_bytes(image)], pa.binary()), "gram": pa.array([_bytes(gram)], pa.binary())})

        return df.mapInArrow(attach, BLOCK_SCHEMA)

    for turn_no in range(MOST_ROUNDS):
        new = take.shape[1]
        grown = extended(table, take, drop, m, held, turn_no == 0)
        held = 0 if turn_no == 0 else held
        image = product(matrix, grown.select("block", "x"), new, labels).select("block", F.col("image").alias("last"))
        m += new
        table = written(joined(grown.drop("x").join(image, "block", "left"), m, held, new))
        held = m
        gram = _added(table, "gram", (2 * m, 2 * new))

        def bordered(old: np.ndarray, columns: np.ndarray) -> np.ndarray:
            n = len(old)
            out = np.zeros((len(columns), len(columns)))
            out[:n, :n] = old
            out[:, n:] = columns
            out[n:, :n] = columns[:n].T
            out[n:, n:] = (out[n:, n:] + out[n:, n:].T) / 2
            return out

        s, a, t = bordered(s, gram[:m, :new]), bordered(a, gram[:m, new:]), bordered(t, gram[m:, new:])
        values, c = _ritz(a, s)
        best = c[:, :k]
        rest = np.einsum("ij,ij->j", best, t @ best) - 2 * values[:k] * np.einsum("ij,ij->j", best, a @ best) + values[:k] ** 2
        if m >= labels or np.sqrt(np.maximum(rest, 0)).max() < TOLERANCE:
            break
        last = slice(m - new, m)
        if m + width > DEPTH * width:
            # Collapse to the best vectors; their images hold the new directions.
            c = c[:, :width]
            table = written(_collapsed(table, c, m))
            m = held = c.shape[1]
            s, a, t = c.T @ s @ c, c.T @ a @ c, c.T @ t @ c
            last, c = slice(0, m), np.eye(m)
        inside = np.linalg.solve(s, a[:, last])
        outside = t[last, last] - a[:, last].T @ inside
        size, turn = np.linalg.eigh((outside + outside.T) / 2)
        kept = size > 1e-13
        if not kept.any():
            break
        scale = turn[:, kept] / np.sqrt(size[kept])
        take = np.zeros((held, scale.shape[1]))
        take[last] = scale
        drop = inside @ scale
    else:
        raise RuntimeError(f"eigenvectors still move after {MOST_ROUNDS} rounds")
    return _mapped(table, c[:, :k], m), values[:k]


def _mapped(table: DataFrame, c: np.ndarray, m: int) -> DataFrame:
    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "x": pa.array([_bytes(_matrix(b.as_py(), m) @ c) for b in batch.column("basis")], pa.binary())})

    return table.select("block", "basis").mapInArrow(times, "block long, x binary")


def _collapsed(table: DataFrame, c: np.ndarray, m: int) -> DataFrame:
    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = {n: pa.array([_bytes(_matrix(b.as_py(), m) @ c) for b in batch.column(n)], pa.binary()) for n in ("basis", "image")}
            yield pa.RecordBatch.from_pydict({"block": batch.column("block"), **both, "gram": pa.array([b""] * batch.num_rows, pa.binary())})

    return table.select("block", "basis", "image").mapInArrow(times, BLOCK_SCHEMA)


def unpacked(vectors: DataFrame, columns: int) -> DataFrame:
    """(id, x): one row of the vectors for each id."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(batch.column("block"), batch.column("x"), strict=True):
                x = _matrix(x.as_py(), columns)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * columns, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_pydict({"id": pa.array(block.as_py() * ROWS + np.arange(len(x))), "x": lists})

    return vectors.mapInArrow(rows, "id long, x array<double>")


def eigenvectors(affinity: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(label, x) with the k leading components of every label that has a row in `affinity`, and the eigenvalues."""
    ids = dictionary((affinity, "src"), (affinity, "dst"))
    n = ids.count()
    if n == 0:
        return affinity.select(F.col("src").alias("label"), F.array().cast("array<double>").alias("x")).limit(0), np.zeros(0)
    found, values = leading(written(cells(encoded(normalised(affinity), ids, ["src", "dst"]))), n, k)
    rows = unpacked(found, len(values)).withColumnRenamed("id", "label")
    return decoded(rows, ids, ["label"]), values


# k-means of all sizes and starts


def _unit(x: np.ndarray, k: int) -> np.ndarray:
    part = x[:, :k]
    norm = np.linalg.norm(part, axis=1, keepdims=True)
    return np.divide(part, norm, out=np.zeros_like(part), where=norm > 0)


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)


def _draws(block: int, rows: int, seed: int, start: int, step: int) -> np.ndarray:
    return -np.log(1.0 - np.random.default_rng([seed, start, step, block]).random(rows))


def _passes(points: DataFrame, columns: int, visit: Callable, merge: Callable) -> dict:
    """visit(block, x) gives a dict for each block; merge(a, b) puts two values together, in the tasks first."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for block, x in zip(batch.column("block"), batch.column("x"), strict=True):
                for key, value in visit(block.as_py(), _matrix(x.as_py(), columns)).items():
                    total[key] = merge(total[key], value) if key in total else value
        yield pa.RecordBatch.from_pydict({"m": pa.array([pickle.dumps(total)], pa.binary())})

    out: dict = {}
    for row in points.mapInArrow(over, "m binary").collect():  # sizes and starts, times the tasks
        for key, value in pickle.loads(row["m"]).items():
            out[key] = merge(out[key], value) if key in out else value
    return out


def clusterings(points: DataFrame, columns: int, sizes: Sequence[int], starts: int, seed: int, most: int = 100) -> dict[int, np.ndarray]:
    """For each size k the centres with the least cost among the starts; `points` are blocks (block, x).

    Rows are the first k components scaled to length 1.  A start draws its centres with chances in proportion to the squared distance from the
    ones it has (an exponential race in one pass).  All sizes and starts share the passes; an empty region takes the row
    farthest from its centre.  Ends when no centre moves.
    """
    runs = [(k, start) for k in sizes for start in range(starts)]
    centres: dict[tuple[int, int], np.ndarray] = {}
    for step in range(max(sizes)):
        held = {run: centres.get(run) for run in runs if step < run[0]}

        def race(block: int, x: np.ndarray, held: dict = held, step: int = step) -> dict:
            out = {}
            units: dict[int, np.ndarray] = {}
            for (k, start), own in held.items():
                u = units.setdefault(k, _unit(x, k))
                far = np.ones(len(u)) if own is None else _distances(u, own).min(axis=1)
                draw = _draws(block, len(u), seed, start, step)
                # Rows at distance 0 come behind all others.
                key = np.where(far > 0, draw / np.maximum(far, 1e-300), 1e300 * (1 + draw))
                at = int(key.argmin())
                out[k, start] = (float(key[at]), block * ROWS + at, u[at])
            return out

        for run, (_, _, row) in _passes(points, columns, race, lambda a, b: min(a, b, key=lambda v: v[:2])).items():
            centres[run] = np.vstack([centres[run], row]) if run in centres else row[None]
    moving, cost = set(runs), {}

    for last in [*[False] * most, True]:
        held = {run: centres[run] for run in (runs if last else moving)}

        def sums(block: int, x: np.ndarray, held: dict = held) -> dict:
            out = {}
            units: dict[int, np.ndarray] = {}
            for (k, start), own in held.items():
                u = units.setdefault(k, _unit(x, k))
                d = _distances(u, own)
                near, least = d.argmin(axis=1), d.min(axis=1)
                total = np.zeros((k, k))
                np.add.at(total, near, u)
                far = int(least.argmax())
                out[k, start] = (total, np.bincount(near, minlength=k), float(least.sum()), (float(least[far]), -(block * ROWS + far), u[far]))
            return out

        found = _passes(points, columns, sums, lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2], max(a[3], b[3], key=lambda v: v[:2])))
        for run, (total, count, spent, far) in found.items():
            cost[run] = spent
            new = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[run])
            empty = np.flatnonzero(count == 0)
            if len(empty) and far[0] > 0:
                new[empty[0]] = far[2]
            if np.abs(new - centres[run]).max() < 1e-12:
                moving.discard(run)
            elif not last:
                centres[run] = new
        if not moving and not last:
            break
    return {k: centres[k, min(range(starts), key=lambda s: (round(cost[k, s], 12), s))] for k in sizes}


def nearest_centres(points: DataFrame, columns: int, centres: dict[int, np.ndarray]) -> DataFrame:
    """(k, id, c, own, least): the region of each id for each size, its squared distance to that centre and the least one."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, x in zip(batch.column("block"), batch.column("x"), strict=True):
                x = _matrix(x.as_py(), columns)
                for k, own in centres.items():
                    d = _distances(_unit(x, k), own)
                    near = d.argmin(axis=1)
                    yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(x), k)), "id": pa.array(block.as_py() * ROWS + np.arange(len(x))), "c": pa.array(near),
                                                      "own": pa.array(d[np.arange(len(x)), near]), "least": pa.array(d.min(axis=1))})

    return points.mapInArrow(place, "k long, id long, c long, own double, least double")


def spectral_regions(affinity: DataFrame, sizes: Sequence[int], starts: int = 8, seed: int = 13) -> DataFrame:
    """(k, label, c, x): for each size not above the number of labels, the region of each label, and its k leading components scaled to length 1."""
    ids = dictionary((affinity, "src"), (affinity, "dst"))
    n = ids.count()
    sizes = [k for k in sizes if k <= n]
    if not sizes:
        return affinity.select(F.lit(0).cast("long").alias("k"), F.col("src").alias("label"), F.lit(0).cast("long").alias("c"), F.array().cast("array<double>").alias("x")).limit(0)
    found, values = leading(written(cells(encoded(normalised(affinity), ids, ["src", "dst"]))), n, max(sizes))
    points = written(found)
    centres = clusterings(points, len(values), sizes, starts, seed)
    placed = nearest_centres(points, len(values), centres).select("k", F.col("id").alias("label"), "c")
    part = F.slice("x", 1, F.col("k").cast("int"))
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, v: s + v * v))
    rows = placed.join(unpacked(points, len(values)).withColumnRenamed("id", "label"), "label")
    rows = rows.select("k", "label", "c", F.transform(part, lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("x"))
    return decoded(rows, ids, ["label"])
