"""Whitening of embeddings by a bidiagonal qd solver.

Vectors are put on a grid of whole numbers, and each distinct one counts once for the fit. In blocks, the centred
vectors are reduced to triangular factors (QR), and those by tens to one; its singular values and right singular vectors
(see ``bidiagonal``) are the deviations and directions of the data. The covariance matrix is never formed.

Only sums, triangular factors and one number a block move between tasks. The driver holds one factor, the square of the
dimension. Blocks are what a task reads at a time, so their number grows with the input and their size doesn't.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from zonetide.llm.bidiagonal import EPS, right_singular
from zonetide.llm.common import stored, unused_name

GRID = 64
OFFSET = 1_000_000
COMPONENTS = 16
FAN_IN = 16      # triangular factors reduced to one at a time
BLOCK_ENTRIES = 1 << 20
LARGEST = 2.0 ** 40  # of a grid entry; larger ones would overflow in sums


def _sound(vector: Column) -> Column:
    return (vector.isNotNull() & (F.size(vector) > 0)
            & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))


def on_grid(vector: Column) -> Column:
    """The grid vector; an entry that would overflow later raises an error."""
    too_large = F.raise_error(F.lit("vector entry too large to be whitened")).cast("long")
    return F.transform(vector, lambda c: F.when(F.abs(c * GRID) < LARGEST, F.floor(c * GRID) + OFFSET)
                       .otherwise(too_large))


_LONGS = StructType([StructField("r", ArrayType(LongType()))])
_DOUBLES = StructType([StructField("r", ArrayType(DoubleType()))])


@dataclass(frozen=True)
class Fit:
    n: int
    sums: np.ndarray        # whole numbers, of each dimension
    directions: np.ndarray  # columns
    variances: np.ndarray   # of the components, falling
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``: n times the distance from the mean, in whole numbers."""
        if len(x) and self.n * int(np.abs(x).max()) >= 2 ** 62:
            raise OverflowError("too many vectors for entries so large")
        return self.n * x - self.sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) / self.n @ self.directions / np.sqrt(self.variances)


def _matrix(column: pa.Array, dimension: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dimension)


def _blocks(columns: Iterable[pa.Array], dimension: int) -> Iterator[np.ndarray]:
    """The grid vectors in blocks of bounded size."""
    size = max(BLOCK_ENTRIES // dimension, dimension)
    for column in columns:
        for at in range(0, len(column), size):
            yield _matrix(column.slice(at, size), dimension)


def _list(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())


def _per_task(result):
    """A function for mapInArrow that yields ``result(matrices)`` once a task, where the task has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = result(batch.column(0) for batch in batches if batch.num_rows)
        if found is not None:
            yield pa.RecordBatch.from_arrays([_list(found.reshape(1, -1))], names=["r"])
    return run


def _sums(rows: DataFrame, width: int, kind: type) -> np.ndarray:
    """The sum of the lists in ``r``, entry by entry."""
    found = np.zeros(width, kind)
    for row in (rows.select(F.posexplode("r").alias("place", "entry"))
                .groupBy("place").agg(F.sum("entry").alias("s")).collect()):
        found[row["place"]] = row["s"]
    return found


def _factor(blocks, dimension: int) -> np.ndarray | None:
    """The triangular factor of all rows of the blocks, one block after the other."""
    found = None
    for block in blocks:
        rows = block if found is None else np.concatenate((found, block))
        found = np.linalg.qr(rows, mode="r")
    if found is None:
        return None
    square = np.zeros((dimension, dimension))
    square[:len(found)] = found
    return square


def fit(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> Fit:
    """The whitening of the vectors in ``x``, each taken once."""
    def summed(columns):
        total = None
        for x in _blocks(columns, dimension):
            own = np.concatenate(([len(x)], x.sum(axis=0)))
            total = own if total is None else total + own
        return total

    totals = _sums(distinct.select("x").mapInArrow(_per_task(summed), _LONGS), dimension + 1, np.int64)
    n, total = int(totals[0]), totals[1:]
    empty = Fit(n, total, np.zeros((dimension, 0)), np.zeros(0), 0.0)

    def reduced(columns):
        return _factor((empty.centred(x) / n for x in _blocks(columns, dimension)), dimension)

    def joined(columns):
        return _factor((_matrix(c, dimension * dimension, float).reshape(-1, dimension) for c in columns), dimension)

    factors = stored(distinct.select("x").mapInArrow(_per_task(reduced), _DOUBLES), "factors")
    while (left := factors.count()) > FAN_IN:
        factors = stored(factors.repartition(-(-left // FAN_IN)).mapInArrow(_per_task(joined), _DOUBLES), "factors")
    last = [np.array(row["r"]).reshape(dimension, dimension) for row in factors.collect()]  # FAN_IN at most
    if not last:
        return empty
    squares, directions = right_singular(_factor(last, dimension))
    # Beyond the rank of the data there is nothing to whiten.
    kept = min(components, int((squares > squares[0] * (max(n, dimension) * EPS) ** 2).sum())) if squares[0] else 0
    return Fit(n, total, directions[:, :kept], squares[:kept] / n, float(squares.sum() / n))


def identity_error(distinct: DataFrame, found: Fit, dimension: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the fit list."""
    width = len(found.variances)

    def moments(columns):
        """Sums of the whitened vectors and of their products, in one square with an extra row."""
        total = None
        for x in _blocks(columns, dimension):
            w = found.whitened(x)
            block = np.concatenate((w.T @ w, w.sum(axis=0)[None]))
            total = block if total is None else total + block
        return total

    sums = _sums(distinct.select("x").mapInArrow(_per_task(moments), _DOUBLES), width * (width + 1), float)
    whole = sums.reshape(width + 1, width) / max(found.n, 1)
    mean = whole[-1]
    return float(np.abs(whole[:-1] - np.outer(mean, mean) - np.eye(width)).max())


def _projected(found: Fit, error: float, dimension: int, names: list[str]):
    width, limit = len(found.variances), 2 ** 63 - 1
    explained = found.variances / found.trace if found.trace else found.variances

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), dimension)
            centred = found.centred(x)
            if len(centred) and int(np.abs(centred).max()) ** 2 * dimension > limit:
                totals = [sum(int(v) ** 2 for v in row) for row in centred.tolist()]
                if max(totals) > limit:
                    raise OverflowError("deviation doesn't fit into a long")
                deviation = np.array(totals, np.int64)
            else:
                deviation = (centred * centred).sum(axis=1)
            rows = len(x)
            for component in range(width):
                yield pa.RecordBatch.from_arrays([
                    *batch.columns[:-1], pa.array(np.full(rows, component + 1, np.int32)),
                    pa.array(np.full(rows, found.n)), pa.array(deviation),
                    pa.array(centred / found.n @ found.directions[:, component] / np.sqrt(found.variances[component])),
                    pa.array(np.full(rows, explained[component])), pa.array(np.full(rows, error))],
                    names=[*batch.schema.names[:-1], *names])
    return projected


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, up to ``components``: the other columns without ``embedding``, and
    ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``. Columns of those names are replaced.

    Null and empty vectors and those with a null, NaN or infinite entry drop out; of vectors of different length, those of the
    most frequent one stay (the shorter one if two are as frequent). Repeated rows each get their result but count once for
    the fit, as do different vectors that are equal on the grid. Components without any deviation are left out, so if
    all vectors are equal, or there is none, there are no rows. Grid entries of 2^40 or more raise an error, as does a deviation
    beyond a long. A null ``vec_id`` is carried along.
    """
    added = {"component": IntegerType(), "n": LongType(), "deviation": LongType(), "whitened": DoubleType(),
             "explained": DoubleType(), "identity_error": DoubleType()}
    kept, helper = embeddings.drop("embedding", *added), unused_name(embeddings, "x")
    vector = embeddings["embedding"].cast("array<double>")
    sound = embeddings.where(_sound(vector)).select(*kept.columns, on_grid(vector).alias(helper))
    lengths = sound.groupBy(F.size(helper).alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    dimension = lengths[0]["length"] if lengths else 1
    usable = sound.where(F.size(helper) == dimension)
    distinct = stored(usable.select(F.col(helper).alias("x")).distinct(), "vectors")
    found = fit(distinct, dimension, components)
    error = identity_error(distinct, found, dimension) if len(found.variances) else 0.0
    schema = StructType([*kept.schema, *[StructField(name, kind) for name, kind in added.items()]])
    return usable.mapInArrow(_projected(found, error, dimension, list(added)), schema)
