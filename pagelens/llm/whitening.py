"""Embeddings whitened by the leading components of their covariance, found by spectrum slicing.

Three passes over the vectors return sums that Spark adds up: exact sums of the integers made of the entries, sums of
products of centred entries, and sums of products of the whitened values, from which ``identity_error`` is taken. Only
one row for each pair of dimensions reaches the driver.

Vectors that are null or hold a null, NaN or infinite entry are dropped. All others must have one length: those whose
length is not the most frequent one (the larger on ties) cannot stand in the same covariance and are dropped as well.
Null ids and repeated rows are kept as they are, other columns are not read, and a table without vectors gives no rows.
Integers beyond 2 ** 60 are held at that value. A component without variance has whitened and explained 0 and does not
count in ``identity_error``. ``deviation`` is null where it passes a long; ``deviation_exact`` holds it up to 2 ** 124.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import table
from pagelens.llm.spectrum import EPS, leading_pairs
from pagelens.session import written

SCALE, SHIFT = 1024, 100_000  # an entry c stands for floor(SCALE * c) + SHIFT
COMPONENTS = 8
LIMB = 26  # bits of the lower part of an integer in exact sums
LARGEST = 1 << 62
HELD = 1 << 60  # of an integer


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch that hold finite vectors of one length, and their integers, for each length."""
    vectors = batch.column(name)
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)
        values = values.reshape(len(rows), length)  # nulls are NaN by now
        good = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            scaled = np.clip(np.floor(SCALE * values[good]), -HELD, HELD)
        yield rows[good], scaled.astype(np.int64) + SHIFT


def sums(vectors: DataFrame, name: str) -> DataFrame:
    """Exact sums: length, pos (-1: none), n, high and low limb."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for rows, x in by_length(batch, name):
                n, high, low = totals.get(x.shape[1], (0, 0, 0))
                totals[x.shape[1]] = [
                    n + len(rows), high + (x >> LIMB).sum(axis=0), low + (x & ((1 << LIMB) - 1)).sum(axis=0)]
        for length, (n, high, low) in totals.items():
            columns = [np.full(length, length), np.arange(length), np.full(length, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["length", "pos", "n", "high", "low"])

    parts = vectors.mapInArrow(add, "length long, pos long, n long, high long, low long")
    return written(parts.groupBy("length", "pos").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.col(c).cast("decimal(28, 0)")).alias(c) for c in ("high", "low")],
    ))


def products(vectors: DataFrame, name: str, values: Callable[[np.ndarray], np.ndarray], length: int, width: int) -> np.ndarray:
    """Matrix of the sums of products of ``values`` (rows of ``width`` numbers), and their sums in its last row."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            for _, x in by_length(batch, name):
                if x.shape[1] == length:
                    z = values(x)
                    total += np.concatenate([z.T @ z, z.sum(axis=0)[None]])
        row, column = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (row, column, total)], ["i", "j", "v"])

    found = vectors.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width + 1, width))
    for row in found.collect():  # (width + 1) * width rows
        out[row["i"], row["j"]] = row["v"]
    return out


class Whitener:
    def __init__(self, n: int, total: list[int], values: np.ndarray, vectors: np.ndarray):
        """From the count, the exact sums, and leading eigenpairs of the covariance."""
        self.n, self.rest = n, [s % n for s in total]
        self.mean = np.array([s // n for s in total], np.int64)
        self.part = np.array([r / n for r in self.rest])
        real = values > len(total) * EPS * max(values.max(initial=0.0), 0.0)
        self.values, self.real = np.where(real, values, 0.0), real
        self.weights = (vectors * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)[:, None]).T

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean; whole parts are subtracted as integers."""
        return (x - self.mean) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum) ** 2, exact."""
        d = x - self.mean
        size = (np.abs(d).astype(float) + 1) * self.n
        if (size * size).sum(axis=1).max(initial=0.0) < LARGEST:
            y = d * self.n - np.array(self.rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in d.tolist()]


def fit(vectors: DataFrame, name: str, components: int = COMPONENTS) -> tuple[Whitener | None, int, float, float]:
    """The whitener, the length of its vectors, the trace of the covariance, and the identity error."""
    found = sums(vectors, name)
    common = found.select("length", "n").distinct().orderBy(F.col("n").desc(), F.col("length").desc()).first()
    if common is None:
        return None, 0, 0.0, 0.0
    length, n = common["length"], common["n"]
    total = [(int(r["high"]) << LIMB) + int(r["low"]) for r in found.filter(F.col("length") == length).orderBy("pos").collect()]
    centre = Whitener(n, total, np.zeros(0), np.zeros((0, length)))
    covariance = products(vectors, name, centre.centred, length, length)[:-1] / n
    whitener = Whitener(n, total, *leading_pairs(covariance, components))
    width = len(whitener.values)
    check = products(vectors, name, whitener.whitened, length, width) / n
    error = np.abs(check[:-1] - np.outer(check[-1], check[-1]) - np.eye(width))[np.ix_(whitener.real, whitener.real)]
    return whitener, length, float(np.trace(covariance)), float(error.max(initial=0.0))


def whiten(docs: DataFrame, key: str = "vec_id", name: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each vector's values on the leading components: key, component (from 1), n, deviation, whitened, explained,
    identity_error, deviation_exact."""
    vectors = docs.select(F.col(name).cast("array<double>").alias(name))
    whitener, length, trace, error = fit(vectors, name, components)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, high long, low long, whitened array<double>"
    explained = [float(e / trace) if trace else 0.0 for e in whitener.values] if whitener else []
    number = whitener.n if whitener else 0

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_length(batch, name):
                if whitener is None or x.shape[1] != length:
                    continue
                exact = [d if d < 1 << 124 else None for d in whitener.deviations(x)]
                values = whitener.whitened(x)
                ends = pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), pa.array([None if d is None else d >> 62 for d in exact], pa.int64()),
                     pa.array([None if d is None else d & (LARGEST - 1) for d in exact], pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                    ["key", "high", "low", "whitened"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(name).cast("array<double>").alias(name)).mapInArrow(transform, schema)
    exact = F.expr(f"CAST(high AS DECIMAL(19, 0)) * CAST({LARGEST} AS DECIMAL(19, 0)) + low").cast("decimal(38, 0)")
    share = F.element_at(F.array(*[F.lit(v) for v in explained or [0.0]]), F.col("component"))
    return rows.select("key", "high", "low", F.posexplode("whitened").alias("pos", "whitened")).withColumn(
        "component", (F.col("pos") + 1).cast("int")
    ).select(
        F.col("key").alias(key), "component", F.lit(number).cast("long").alias("n"),
        F.when(F.col("high") < 2, F.shiftleft("high", 62) + F.col("low")).alias("deviation"),
        "whitened", share.alias("explained"), F.lit(error).alias("identity_error"), exact.alias("deviation_exact"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
