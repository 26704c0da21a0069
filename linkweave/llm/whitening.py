"""Whitening of embeddings from an exact integer scatter.

Entries become whole numbers x = floor(scale * c). The fit list is each distinct x once. A shift, the mean of a few vectors of the fit list, is subtracted; sums S
and cross-products of what is left are accumulated without rounding: numbers are cut into limbs of LIMB bits, blocks of rows are multiplied as doubles
that hold every product and sum exactly, and a task's totals, whole numbers of any size, leave it in limbs of 32 bits that Spark adds up. n XtX - S St, which no
shift changes, is formed in whole numbers on the driver; only then is it divided, becomes double and is decomposed by eigh.

The driver gets width * width numbers for each length of vectors, whatever their number: at most MOST_WIDTH entries and MOST_WIDTHS lengths are allowed, more are refused.
The fit list is written once; equal vectors are one row of it before they are shuffled, so a vector that a third of all rows repeat costs one row of each task.

Defined cases: rows whose vector is null, or holds null or non-finite entries or one whose x is no 64-bit number, are dropped, and so are vectors without entries.
Vectors of different lengths are fitted apart. Repeated rows get their rows each, null ids are carried. A component whose eigenvalue is nothing but rounding (at most width * 2^-50
of the largest) is left out, so a fit list of one vector gives no rows. `deviation` is null where it has over 38 digits. Other columns are ignored; an empty
table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import checkpointed, frugal

SCALE, COMPONENTS, LIMB, BLOCK, MOST_WIDTH, MOST_WIDTHS, SHIFT_FROM = 256, 4, 20, 4096, 4096, 64, 64


@dataclass(frozen=True)
class Fit:
    """What one length of vectors is whitened by: n fit vectors whose mean is shift + rest / n, the components as rows, their eigenvalues and shares of the variance."""

    n: int
    shift: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """Of vectors less the shift: less the mean."""
        return y - np.array([int(r) / self.n for r in self.rest])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return self.centred(y) @ self.components.T / np.sqrt(self.values)

    def deviation(self, y: np.ndarray) -> list[int]:
        """Sums of squares of n y - rest, exactly: n n sum(yy) - 2 n sum(y rest) + sum(rest rest)."""
        rest, y = _fitting(self.rest, y), _fitting(y, y)
        squares, products = (y * y).sum(1).tolist(), (y * rest).sum(1).tolist()
        last = sum(int(r) * int(r) for r in self.rest)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + last for a, b in zip(squares, products, strict=True)]


def _fitting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a as 64-bit numbers if sums of its products with b's rows fit into them, else as Python's whole numbers."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    return a.astype(np.int64) if most[0] < 1 << 62 and most[0] * most[1] * b.shape[-1] < 1 << 62 else a.astype(object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2 ** (LIMB * k), is y; all but the last are in 0 to 2 ** LIMB - 1."""
    out = []
    while True:
        if np.abs(y).max(initial=0) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


class Scatter:
    """Sums and cross-products of whole numbers, of any size."""

    def __init__(self, width: int) -> None:
        self.n, self.sums, self.products = 0, np.zeros(width, object), np.zeros((width, width), object)

    def add(self, y: np.ndarray) -> None:
        """y: at most BLOCK rows, whole numbers."""
        parts = limbs(y)
        self.n += len(y)
        for i, a in enumerate(parts):
            self.sums += a.sum(0).astype(np.int64).astype(object) << LIMB * i if i else a.sum(0).astype(np.int64).astype(object)
            for j, b in enumerate(parts):
                # products below 2 ** 40, sums of 4096 of them below 2 ** 52: exact as doubles
                self.products += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Its totals as (i, j, k, limb): numbers sum(limb * 2 ** (32 * k)); j is -1 for the sums, and i too for the count. The upper triangle alone."""
        width = len(self.sums)
        up = np.triu_indices(width)
        i, j = np.concatenate([[-1], np.arange(width), up[0]]), np.concatenate([np.full(width + 1, -1), up[1]])
        left, out, k = np.concatenate([np.array([self.n], object), self.sums, self.products[up]]), [], 0
        while len(left):
            last = np.array([-(1 << 31) <= x < 1 << 31 for x in left])
            low = np.where(last, left, left & 0xFFFFFFFF)
            some = low != 0
            out.append((i[some], j[some], np.full(int(some.sum()), k), low[some]))
            i, j, left, k = i[~last], j[~last], left[~last] >> 32, k + 1
        return tuple(np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(4))


def whole_numbers(vectors: DataFrame, vector_column: str, scale: int) -> DataFrame:
    """The table's rows that can be whitened, with x, an array of long, and its width."""
    v = F.col(vector_column).cast("array<double>")
    # a null entry's comparison is null, and not a number's is false
    fine = F.forall(v, lambda c: F.coalesce((c * scale >= -(2.0**63)) & (c * scale < 2.0**63), F.lit(False)))
    rows = vectors.where(F.coalesce((F.size(vector_column) > 0) & fine, F.lit(False)))
    return rows.withColumn("__x", F.transform(v, lambda c: F.floor(c * scale))).withColumn("__width", F.size("__x"))


def matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch whose last column is an array, cut by its length."""
    lengths = pc.list_value_length(batch.column(batch.num_columns - 1))
    for width in lengths.unique().to_pylist():
        yield width, batch.filter(pc.equal(lengths, width))


def less(x: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x - shift; as Python's whole numbers where 64 bits can't hold it."""
    far = 1 << 62
    return x - shift if max(abs(int(a)) for a in (x.max(initial=0), x.min(initial=0), shift.max(), shift.min())) < far else x.astype(object) - shift.astype(object)


def fit(distinct: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """Of distinct vectors (x, width) the fit of each length."""
    widths = [r.width for r in distinct.select("width").distinct().limit(MOST_WIDTHS + 1).collect()]
    if len(widths) > MOST_WIDTHS or max(widths, default=0) > MOST_WIDTH:
        raise ValueError(f"vectors of more than {MOST_WIDTHS} lengths, or of more than {MOST_WIDTH} entries")
    shifts = {}
    for w in sorted(widths):  # any shift gives the same result; one near the mean keeps numbers small
        few = [r.x for r in distinct.where(F.col("width") == w).orderBy(F.xxhash64("x"), "x").limit(SHIFT_FROM).collect()]
        shifts[w] = np.array([sum(c) // len(few) for c in zip(*few, strict=True)], np.int64)

    def scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for batch in batches:
            for width, part in by_width(batch):
                x = matrix(part.column(0), width)
                for k in range(0, len(x), BLOCK):
                    found.setdefault(width, Scatter(width)).add(less(x[k : k + BLOCK], shifts[width]))
        for width, scatter in found.items():
            columns = scatter.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), width)), *map(pa.array, columns)], names=["width", "i", "j", "k", "part"])

    parts = distinct.select("x").mapInArrow(frugal(scattered), "width long, i long, j long, k long, part long")
    # a part is below 2 ** 32, so parts of 2 ** 31 tasks can be added
    sums = parts.groupBy("width", "i", "j", "k").agg(F.sum("part").alias("part")).toArrow().to_pydict()
    totals: dict[int, dict[tuple[int, int], int]] = {w: {} for w in shifts}
    for w, i, j, k, part in zip(*(sums[c] for c in ("width", "i", "j", "k", "part")), strict=True):
        totals[w][i, j] = totals[w].get((i, j), 0) + (part << 32 * k)
    return {w: _fitted(shifts[w], totals[w], most) for w in shifts}


def _fitted(shift: np.ndarray, totals: dict[tuple[int, int], int], most: int) -> Fit:
    width, n = len(shift), totals[-1, -1]
    sums = [totals.get((i, -1), 0) for i in range(width)]
    scatter = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            scatter[i, j] = scatter[j, i] = (n * totals.get((i, j), 0) - sums[i] * sums[j]) / (n * n)  # whole numbers until this division, which rounds once
    values, vectors = np.linalg.eigh(scatter)
    trace = float(np.trace(scatter))
    order = [k for k in np.argsort(-values, kind="stable")[:most] if values[k] > width * 2.0**-50 * values[-1]]
    # what exceeds the shift by whole steps of the mean goes to it, so that the rest is below n
    whole = np.array([s // n for s in sums], object)
    shift, rest = shift.astype(object) + whole, np.array([s - q * n for s, q in zip(sums, whole, strict=True)], object)
    shift = shift.astype(np.int64)  # between the smallest and the largest of 64-bit numbers
    return Fit(n, shift, rest, vectors.T[order], values[order], values[order] / trace if order else values[order])


def identity_errors(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each length the largest entry, without its sign, of the covariance of its whitened fit list minus the identity."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, list[float], list[float]]] = []
        for batch in batches:
            for width, part in by_width(batch):
                f = fits[width]
                z = f.whitened(less(matrix(part.column(0), width), f.shift).astype(np.float64))
                mean = z.mean(0)
                spread = (z - mean).T @ (z - mean) + len(z) * np.outer(mean, mean)
                rows.append((width, len(z), z.sum(0).tolist(), spread.ravel().tolist()))
        values = [(w, n, k, x) for w, n, a, b in rows for k, x in enumerate([*a, *b])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True) if values else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["width", "n", "k", "x"])

    found = distinct.select("x").mapInArrow(frugal(moments), "width long, n long, k long, x double").groupBy("width", "k").agg(F.sum("x").alias("x")).collect()
    out = {}
    for width, f in fits.items():
        c = len(f.values)
        sums = np.zeros(c + c * c)
        for r in found:
            if r.width == width:
                sums[r.k] = r.x
        mean = sums[:c] / f.n
        out[width] = float(np.abs(sums[c:].reshape(c, c) / f.n - np.outer(mean, mean) - np.eye(c)).max(initial=0))
    return out


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """WHITENED for each row and each of the first components."""
    rows = whole_numbers(vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")), "v", scale)
    distinct = checkpointed(rows.select(F.col("__x").alias("x"), F.col("__width").alias("width")).distinct())
    fits = fit(distinct, components)
    errors = identity_errors(distinct, fits)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in by_width(batch):
                f = fits[width]
                y = less(matrix(part.column(1), width), f.shift)
                z, n, c = f.whitened(y.astype(np.float64)), len(y), len(f.values)
                deviation = [Decimal(d) if d < 10**38 else None for d in f.deviation(y)]
                each = np.repeat(np.arange(n), c)
                same = lambda values: pa.array(np.tile(values, n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(each)), same(np.arange(1, c + 1, dtype=np.int32)), pa.array(np.full(n * c, f.n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(z.ravel()), same(f.explained), pa.array(np.full(n * c, errors[width])), same(f.values)],
                    names=[x.split(" ")[0] for x in WHITENED.split(", ")],
                )

    return rows.select("vec_id", "__x").mapInArrow(frugal(projected), WHITENED)
