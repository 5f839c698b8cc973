"""Embedding whitening from upper-triangle column aggregates.

Entries become integers, floor(64 * entry) + 1000000.  One aggregation sums each dimension; a second one, of
generated Spark SQL expressions, sums the products of every pair of dimensions after taking the rounded mean
from each, so that the sums are of small integers and exact up to 2^53.  The driver gets these d * (d + 1) / 2
numbers and no vector, takes off the rest of the means exactly, and LAPACK decomposes the covariance.
Tasks then project the vectors on the components, in Arrow batches.  The covariance of the result is summed in
the same way over all rows as written.

The expressions grow with the square of the dimensions; the number of rows changes neither what is shuffled (a
row for each task) nor what the driver gets.

Defined cases: null vectors and vectors with null, NaN or infinite entries are dropped, and so are vectors of
another length than most have (of equally frequent lengths the longest counts) and those without entries;
entries outside +-2^55 are taken as that bound; repeated rows all count; components whose eigenvalue is 0 up to
rounding are left out; a deviation beyond a long is null; a table without usable rows gives none; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
LARGEST = float(1 << 55)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """id and __vec (doubles) of the rows that count, and their number of dimensions (0 if there are none)."""
    finite = F.forall("__vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.select(id_col, F.col(vec_col).cast("array<double>").alias("__vec")).where(F.col("__vec").isNotNull() & (F.size("__vec") > 0) & finite)
    top = kept.groupBy(F.size("__vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("__vec") == (top.d if top else 0)), top.d if top else 0


def scaled(d: int) -> list[Column]:
    """x0, x1 and so on: the integers of __vec."""
    entry = lambda i: F.greatest(F.least(F.get("__vec", F.lit(i)), F.lit(LARGEST)), F.lit(-LARGEST))
    return [(F.floor(entry(i) * SCALE) + OFFSET).alias(f"x{i}") for i in range(d)]


def triangle(centred: DataFrame, d: int) -> np.ndarray:
    """Sums of the products of all pairs of the columns y0, y1 and so on, by one aggregation of generated expressions."""
    whole = centred.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in centred.columns))  # none is null: Spark leaves out its checks for null
    sums = whole.agg(F.expr("array(" + ", ".join(f"sum(y{i} * y{j})" for i in range(d) for j in range(i, d)) + ")")).first()[0]
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = sums
    return out + np.triu(out, 1).T


def integer_covariance(x: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, exact sums and covariance (divisor n) of the integer columns x0, x1 and so on."""
    n, *sums = x.agg(F.count("*"), *(F.sum(F.col(f"x{i}").cast("decimal(20,0)")) for i in range(d))).first()
    sums = [int(s) for s in sums]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    products = triangle(x.select(*((F.col(f"x{i}") - F.lit(m)).cast("double").alias(f"y{i}") for i, m in enumerate(middle))), d)
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle, strict=True)])
    return n, sums, products / n - np.outer(rest, rest)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = min(most, int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()))
    return values[:real], vectors[:, :real]


def deviations(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int | None]:
    """The sum of (n * x - S)^2 over the dimensions of each row, exactly."""
    widest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if widest < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (off * off).sum(1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, deviation and the array whitened, one value for each component; n, explained and identity_error in each row."""
    spark, key = rows.sparkSession, f"`{id_col}` {dict(rows.dtypes)[id_col]}"
    kept, d = usable(rows, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], f"{key}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    n, sums, covariance = integer_covariance(kept.select(*scaled(d)), d)
    values, vectors = components(covariance, most)
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])
    project = vectors / np.sqrt(values)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        entries = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        x = np.floor(np.clip(entries, -LARGEST, LARGEST) * SCALE).astype(np.int64) + OFFSET
        white = ((x - middle).astype(float) - rest) @ project
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.int64()), lists], [id_col, "deviation", "whitened"])

    white = materialize(map_arrow(kept, run, f"{key}, deviation long, whitened array<double>"), "whitened")
    error = identity_error(white, n, len(values))
    explained = F.array(*(F.lit(float(v)) for v in values / np.trace(covariance))) if len(values) else F.expr("cast(array() as array<double>)")
    return white.select(id_col, F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity, over all rows."""
    if not k:
        return 0.0
    z = white.select(*(F.get("whitened", F.lit(i)).alias(f"z{i}") for i in range(k)))
    means = z.agg(*(F.sum(f"z{i}") / n for i in range(k))).first()
    covariance = triangle(z.select(*((F.col(f"z{i}") - F.lit(m)).alias(f"y{i}") for i, m in enumerate(means))), k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def by_component(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """A row for each id and component, numbered from 1."""
    pairs = white.select(id_col, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair"))
    return pairs.select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
