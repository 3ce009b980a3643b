"""Embedding whitening by a tall-skinny QR: rows are centred by exact sums, never multiplied into a covariance.

Entries become whole numbers, so that sums over all rows are exact in any order. Each partition turns its
centred rows into one triangular factor, batch after batch; factors meet in a tree, FAN of them in a task,
until one is left. Its right singular vectors are the components, its singular values the deviations: a
row times a component over the deviation is white. What reaches the driver is one factor, as large as the
dimension squared, and one row of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Factors that a task merges: so many, and fewer where they have more bytes together.
FAN, FAN_BYTES = 32, 1 << 26
#: Rows that a task adds to its factor at once.
STEP_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n rows with sums by dimension; components, a unit row each, by falling eigenvalue; their share of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.sums)


def whole_numbers(vector: Column) -> Column:
    """The entries as whole numbers; null for a null vector and one with a null or non-finite entry."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean, from whole numbers: only the last division rounds."""
    return scaled_deviations(x, n, sums).astype(np.float64) / n


def scaled_deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly; Python's integers where 64 bits don't hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(s)) for s in sums), default=0))
    return x * np.int64(n) - sums.astype(np.int64) if most < 1 << 62 else x.astype(object) * n - sums


def squared_lengths(deviations: np.ndarray) -> list[int]:
    """Row by row the sum of squares, exactly."""
    most = int(np.abs(deviations).max(initial=0))
    if deviations.dtype != object and most * most * max(1, deviations.shape[1]) < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    wide = deviations.astype(object)
    return [int(v) for v in (wide * wide).sum(axis=1)]


def batches_of(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, whole numbers) of up to STEP_ROWS rows of a batch; its last column is the array."""
    for at in range(0, batch.num_rows, STEP_ROWS):
        some = batch.slice(at, STEP_ROWS)
        yield at, some.column(some.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dimension)


def tall_factor(rows: DataFrame, dimension: int, prepared: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The triangular factor of prepared(x) over all rows of one array column (dimension entries each)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            for _, x in batches_of(batch, dimension):
                a = prepared(x)
                r = np.linalg.qr(a if r is None else np.vstack([r, a]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "wide": [r.shape[1]], "factor": [r.tobytes()]}, schema)

    schema = pa.schema([("part", pa.int64()), ("wide", pa.int64()), ("factor", pa.binary())])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        wide = int(frame["wide"].iloc[0])
        r = np.linalg.qr(np.vstack([np.frombuffer(f).reshape(-1, wide) for f in frame["factor"]]), mode="r")
        return pd.DataFrame({"part": [int(frame["to"].iloc[0])], "wide": [wide], "factor": [r.tobytes()]})

    fan = max(2, min(FAN, FAN_BYTES // max(1, 8 * dimension * dimension)))
    factors = written(rows.mapInArrow(own, "part long, wide long, factor binary"), "white-factors")
    while factors.count() > 1:  # no two parts have one number, so each level has at most a fan-th of the factors, and one more
        to = F.floor(F.col("part") / fan).cast("long").alias("to")
        factors = written(factors.select("part", "wide", "factor", to).groupBy("to").applyInPandas(merged, "part long, wide long, factor binary"), "white-factors")
    last = factors.first()
    return np.empty((0, dimension)) if last is None else np.frombuffer(last["factor"]).reshape(-1, last["wide"])


def usable_rows(df: DataFrame, vector: str, number: str) -> tuple[DataFrame, int]:
    """The rows whose vector can be used, with its whole numbers as a further column, and the dimension.

    The dimension is the most frequent length of such vectors, of equally frequent ones the greater;
    vectors of another length go, as do empty ones.
    """
    rows = df.withColumn(number, whole_numbers(F.col(vector))).filter(F.size(number) > 0)
    most = rows.groupBy(F.size(number).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(number) == (most["d"] if most else 0)), most["d"] if most else 0


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of df.

    Rows whose vector is null, empty, of another length than most or holds a null or non-finite entry are
    left out. Repeated rows count each. A component is left out where the rows don't vary, to double
    precision; no rows, one row or equal rows have none. An entry beyond 2**57 or so doesn't fit a long
    and raises. Other columns aren't read.
    """
    rows, dimension = usable_rows(df.select(F.col(vector).alias("v")), "v", "x")
    if not dimension:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.get("x", F.lit(k))) for k in range(dimension)]).alias("sums")).first()
    n, sums = totals["n"], np.array(totals["sums"], object)
    r = tall_factor(rows.select("x"), dimension, lambda x: centred(x, n, sums))
    _, deviations, right = np.linalg.svd(r, full_matrices=False)
    kept = deviations > (deviations.max(initial=0) * max(r.shape) * np.finfo(float).eps)
    eigenvalues, trace = deviations**2 / n, float((deviations**2).sum() / n)
    right = right[kept][:components]
    # one sign for all rows: the entry that is largest in size is positive
    right = right * np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:, None] if len(right) else right
    eigenvalues = eigenvalues[kept][:components]
    return Whitening(n, sums, right, eigenvalues, eigenvalues / trace if len(eigenvalues) else eigenvalues)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding", white: str = "white", deviation: str = "deviation") -> DataFrame:
    """df's rows that the fit could use, with white (array<double>, a number a component) and deviation
    (decimal(38,0): the sum of squares of n * x - sums, exact). Columns of these names are replaced."""
    n, sums, wide, d = model.n, model.sums, model.components.T / np.sqrt(model.eigenvalues), model.dimension
    kept = [c for c in df.columns if c.lower() not in (white.lower(), deviation.lower())]
    (number,) = unused(df, "_x")
    rows = df.withColumn(number, whole_numbers(F.col(f"`{vector}`"))).filter(F.size(number) == d if d else F.lit(False))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], number)
    schema = rows.select(*kept, F.array(F.lit(0.0)).alias(white), F.lit(0).cast("decimal(38,0)").alias(deviation)).schema

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for at, x in batches_of(batch, d):
                far = scaled_deviations(x, n, sums)
                found = (far.astype(np.float64) / n) @ wide
                ends = np.arange(len(x) + 1, dtype=np.int32) * found.shape[1]
                made = [pa.ListArray.from_arrays(ends, pa.array(found.ravel())), pa.array([Decimal(v) for v in squared_lengths(far)], pa.decimal128(38, 0))]
                own = [c.slice(at, len(x)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, *made], [*kept, white, deviation])

    return rows.mapInArrow(project, schema)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest entry, in size, of the whitened rows' covariance minus the identity; 0 without components.

    The covariance comes from the factor of the rows with a leading column of ones: what is below it in the
    factor is that of the rows less their mean.
    """
    if not len(model.components):
        return 0.0
    n, sums, wide, d = model.n, model.sums, model.components.T / np.sqrt(model.eigenvalues), model.dimension
    rows = df.select(whole_numbers(F.col(f"`{vector}`")).alias("x")).filter(F.size("x") == d)
    r = tall_factor(rows, d, lambda x: np.hstack([np.ones((len(x), 1)), centred(x, n, sums) @ wide]))[1:, 1:]
    return float(np.abs(r.T @ r / n - np.eye(len(model.components))).max())


def whitened_rows(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The columns of df but the vector, and a row a component: component (from 1), n, deviation, whitened,
    explained, identity_error.

    Rows that the fit leaves out have no row, nor has a component without variance; see fit_whitening.
    An empty table gives no rows. Columns of df with one of these names are replaced.
    """
    model = fit_whitening(df, vector, components)
    error = identity_error(df, model, vector)
    made = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in df.columns if c.lower() not in made and c.lower() != vector.lower()]
    (white,) = unused(df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made]), "_white")
    rows = whiten(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`")), model, vector, white)
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if len(model.explained) else F.array().cast("array<double>")
    out = rows.select(*[F.col(f"`{c}`") for c in kept], "deviation", F.posexplode(white).alias("_place", "whitened"))
    return out.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col("_place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
