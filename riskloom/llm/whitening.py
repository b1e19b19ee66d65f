"""Whitening of embeddings: distributed centred covariance, a small symmetric eigenproblem, broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskloom.session import materialise

# an eigenvalue this close to its neighbour, relative to the matrix, belongs to the same cluster
CLUSTER = 1e-3
# bytes of vectors that are worked on at once
BLOCK = 16 << 20


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): Householder reflections turn the symmetric matrix into a tridiagonal one."""
    a = np.array(matrix, np.float64)
    size = len(a)
    reflectors = []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0 or np.all(v[1:] == 0):
            reflectors.append(np.zeros(size - k - 1))
            continue
        v[0] += length if v[0] >= 0 else -length
        v /= np.linalg.norm(v)
        reflectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        image = rest @ v
        image -= (v @ image) * v
        rest -= 2 * (np.outer(v, image) + np.outer(image, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def rotated_back(vectors: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """Eigenvectors (columns) of the matrix from those of its tridiagonal form."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def eigenvalues_below(diagonal: np.ndarray, squares: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each point. ``squares`` are the squared off-diagonals."""
    tiny = np.finfo(np.float64).tiny * max(1.0, squares.max(initial=0.0)) / np.finfo(np.float64).eps
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - points - squares[i - 1] / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection on Sturm counts down to neighbouring numbers."""
    radius = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    spread = max(np.max(np.abs(diagonal) + radius), np.finfo(np.float64).tiny)
    low = np.full(wanted, np.min(diagonal - radius) - 1e-15 * spread)
    high = np.full(wanted, np.max(diagonal + radius) + 1e-15 * spread)
    rank = len(diagonal) - np.arange(wanted)
    while True:
        middle = 0.5 * (low + high)
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return 0.5 * (low + high)
        enough = eigenvalues_below(diagonal, off**2, middle) >= rank
        high, low = np.where(open_ & enough, middle, high), np.where(open_ & ~enough, middle, low)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right by elimination with row exchanges; pivots are ``least`` in size at least."""
    size = len(diagonal)
    main, upper, second = [0.0] * size, [0.0] * size, [0.0] * size
    x = right.tolist()
    below = off.tolist()
    here, beside = float(diagonal[0] - shift), below[0] if size > 1 else 0.0
    for i in range(size - 1):
        lower, next_main = below[i], float(diagonal[i + 1] - shift)
        next_beside = below[i + 1] if i + 2 < size else 0.0
        if abs(here) >= abs(lower):
            here = here if abs(here) >= least else least
            main[i], upper[i] = here, beside
            ratio = lower / here
            here, beside = next_main - ratio * beside, next_beside
            x[i + 1] -= ratio * x[i]
        else:
            main[i], upper[i], second[i] = lower, next_main, next_beside
            ratio = here / lower
            here, beside = beside - ratio * next_main, -ratio * next_beside
            x[i], x[i + 1] = x[i + 1], x[i] - ratio * x[i + 1]
    main[size - 1] = here if abs(here) >= least else least
    for i in range(size - 1, -1, -1):
        rest = x[i]
        if i + 1 < size:
            rest -= upper[i] * x[i + 1]
        if i + 2 < size:
            rest -= second[i] * x[i + 2]
        x[i] = rest / main[i]
    return np.array(x)


def tridiagonal_eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; inside a cluster of close eigenvalues every step is made
    orthogonal to the vectors found before it."""
    size = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    least = np.finfo(np.float64).eps * norm
    random = np.random.default_rng(0)
    out = np.zeros((size, len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # equal eigenvalues are told apart, so that each starts another elimination
        shift = value - (j - first) * least
        x = random.uniform(-1, 1, size)
        for _ in range(6):
            x /= np.abs(x).max()
            before = solved(diagonal, off, shift, x, least)
            x = before / np.linalg.norm(before)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            length = np.linalg.norm(x)
            if length < 1e-8:
                x = random.uniform(-1, 1, size)
                continue
            x /= length
        out[:, j] = x
    return out


def leading_components(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, largest first. Eigenvalues that cannot be told
    from zero are left out."""
    wanted = min(wanted, len(matrix))
    if wanted == 0 or not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflectors = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, wanted)
    values = values[values > len(matrix) * np.finfo(np.float64).eps * values[0]]
    return values, rotated_back(tridiagonal_eigenvectors(diagonal, off, values), reflectors)


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their vectors as a matrix), a bounded number at a time."""
    for batch in batches:
        step = max(1, BLOCK // (8 * max(1, width)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            flat = part.column(part.schema.get_field_index("_vector")).flatten()
            yield part, flat.to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def product_sums(rows: DataFrame, width: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of the products of two entries of ``centred(vector)``: each task sends one row per pair of
    entries, Spark adds them, the driver sees width * width numbers."""
    above = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for _, vectors in blocks(batches, width):
            values = centred(vectors)
            total += values.T @ values
        columns = [pa.array(above[0].astype(np.int32)), pa.array(above[1].astype(np.int32)), pa.array(total[above])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "part"])

    parts = rows.select("_vector").mapInArrow(partial, "i int, j int, part double")
    out = np.zeros((width, width))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("part")).collect():
        out[i, j] = out[j, i] = value
    return out


def entry_sums(rows: DataFrame, width: int, kind: str) -> tuple[int, list]:
    """(rows, sum of each entry); integer entries (``kind`` bigint) are added exactly."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in blocks(batches, width):
            columns = [pa.array(np.arange(width, dtype=np.int32)), pa.array(vectors.sum(axis=0)), pa.array([part.num_rows] * width, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "part", "n"])

    parts = rows.select("_vector").mapInArrow(partial, f"i int, part {kind}, n bigint")
    whole = F.col("part").cast("decimal(38,0)") if kind == "bigint" else F.col("part")
    found = {i: (n, s) for i, n, s in parts.groupBy("i").agg(F.sum("n"), F.sum(whole)).collect()}
    if not found:
        return 0, [0] * width
    return found[0][0], [int(found[i][1]) if kind == "bigint" else found[i][1] for i in range(width)]


@dataclass(frozen=True)
class Centre:
    """The exact mean of integer vectors: sums over n, as a whole part and a remainder."""

    n: int
    sums: tuple[int, ...]

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors minus their mean; the whole part is subtracted as an integer, so no digit is lost."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (vectors - np.array(whole, np.int64)).astype(np.float64) - rest

    def deviations(self, vectors: np.ndarray) -> list[Decimal]:
        """Sum over the entries of (n * x - sum) ** 2, exact."""
        far = np.abs(self(vectors)).max(initial=0.0) * self.n + self.n
        if far * far * max(1, len(self.sums)) < 2**62:
            away = vectors * self.n - np.array(self.sums, np.int64)
            return [Decimal(d) for d in (away * away).sum(axis=1).tolist()]
        away = vectors.astype(object) * self.n - np.array(self.sums, object)
        return [Decimal(d) for d in (away * away).sum(axis=1).tolist()]


def whitened_embeddings(
    embeddings: DataFrame,
    *,
    key: str = "node_id",
    vector: str | None = None,
    components: int = 32,
    scale: float = 2.0**20,
    offset: int = 0,
) -> DataFrame:
    """Decorrelates account embeddings: one row per embedding with its coordinates along the leading principal
    components, each scaled to variance 1.

    ``vector`` names an array column; without it the columns ``embedding_0``, ``embedding_1``, ... of
    ``spectral_embedding`` are the entries. An entry c enters as the integer floor(scale * c) + offset, which makes
    counts, sums and deviations exact; the covariance (divisor: the number of rows) is formed from centred values.
    The result has ``key``, ``n`` (rows), ``deviation`` (decimal(38,0): sum over the entries of (n * x - sum)^2),
    ``whitened`` and ``explained`` (arrays, one entry per component: the coordinate, and the part of the total
    variance), ``identity_error`` (largest entry of the coordinates' covariance minus the identity, one value).

    At most ``components`` components, numbered by falling variance; those without any variance are left out, so
    one row, or equal rows, have none. Rows whose vector is NULL, holds NULL, NaN or an infinity, or is shorter
    than the longest are left out. A NULL key is kept, repeated rows are rows, other columns are ignored, an empty
    table gives an empty result. The driver holds matrices of vector length squared, tasks bounded blocks of rows.
    """
    if vector is None:
        names = sorted((c for c in embeddings.columns if c.startswith("embedding_") and c[10:].isdigit()), key=lambda c: int(c[10:]))
        entries = F.array(*[F.col(c).cast("double") for c in names])
    else:
        entries = F.col(vector).cast("array<double>")
    read = embeddings.select(F.col(key).alias("_key"), entries.alias("_c"))
    whole = read.where(F.col("_c").isNotNull() & F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    width = whole.agg(F.max(F.size("_c"))).first()[0] or 0
    fixed = F.transform("_c", lambda c: F.floor(F.lit(float(scale)) * c) + F.lit(offset).cast("bigint"))
    rows = whole.where(F.size("_c") == width).select("_key", fixed.alias("_vector"))
    kind = embeddings.schema[key].dataType.simpleString()
    count, sums = entry_sums(rows, width, "bigint") if width else (0, [])
    if not count:
        schema = f"`{key}` {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
        return embeddings.sparkSession.createDataFrame([], schema)
    centre = Centre(count, tuple(sums))
    covariance = product_sums(rows, width, centre) / count
    values, vectors = leading_components(covariance, components)
    shared = embeddings.sparkSession.sparkContext.broadcast((centre, vectors / np.sqrt(values)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, projection = shared.value
        for part, x in blocks(batches, width):
            coordinates = middle(x) @ projection
            flat = pa.array(coordinates.reshape(-1))
            ends = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * projection.shape[1])
            columns = [part.column(0), pa.array(middle.deviations(x), pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "deviation", "whitened"])

    projected = materialise(rows.mapInArrow(project, f"_key {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    found = len(values)
    error = 0.0
    if found:
        again = projected.select(F.col("whitened").alias("_vector"))
        mean = np.array(entry_sums(again, found, "double")[1]) / count
        error = float(np.abs(product_sums(again, found, lambda w: w - mean) / count - np.eye(found)).max())
    explained = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)]).cast("array<double>") if found else F.array().cast("array<double>")
    return projected.select(
        F.col("_key").alias(key), F.lit(count).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )
