"""Whitening of embeddings over distinct vectors with multiplicities.

Entries are quantised to integers, identical vectors are grouped and counted, and everything is done once for each distinct
vector: the covariance is a matrix product of the centred vectors, weighted by their counts (or by one, `weights="one"`),
summed over the tasks; each distinct vector is projected once, and the results are joined back to the rows. Only sums by
dimension or by two dimensions reach the driver, where the eigenvectors are found. Vectors with over a 64th of all rows,
of which there are fewer than 64, are joined back by broadcast, so copies don't meet in one task.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are left out; repeated rows and ids each
give their rows; a component with no variance beyond rounding (the vectors span fewer dimensions) has a null `whitened` and
stays out of the identity's error; an empty table, or one without a usable vector, gives an empty result; other columns are
ignored. Vectors of different lengths have no covariance and raise ValueError; sums that exceed a long raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: A vector with more than this share of all rows is joined by broadcast.
HOT = 64


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long") + F.lit(offset))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(h, x, weight): each x-vector once, with its number of rows; copies are counted before the shuffle."""
    return rows.groupBy("h", "x").agg(F.count(F.lit(1)).alias("weight"))


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def weighted_covariance(vectors: DataFrame, column: str, centre: np.ndarray, total: int, base: int = 0) -> np.ndarray:
    """The covariance (divisor `total`) of `column` (arrays of numbers) with the counts in `weight`.

    `centre` is the mean of the entries less `base`, which is taken off them first. Each task multiplies its centred
    vectors; the sums of the tasks' products are Spark's.
    """
    dims = len(centre)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims))
        for b in batches:
            centred = (_matrix(b, column, dims) - base) - centre
            out += (centred * b.column("weight").to_numpy()[:, None].astype(float)).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(dims + 1, dtype=np.int32) * dims), pa.array(out.ravel()))], ["i", "row"])

    rows = vectors.select(column, "weight").mapInArrow(products, "i int, row array<double>")
    sums = rows.select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((dims, dims))
    for i, j, s in sums.collect():  # dims x dims numbers
        out[i, j] = s
    return (out + out.T) / (2 * total)


def _sums(vectors: DataFrame, column: str) -> list:
    """The weighted sum of each dimension."""
    rows = vectors.select(F.posexplode(column).alias("i", "c"), "weight").groupBy("i").agg(F.sum(F.col("c") * F.col("weight")).alias("s")).collect()
    return [s for _, s in sorted(map(tuple, rows))]


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eigenvalues by falling size, their unit eigenvectors (columns; the largest entry is positive), and which have variance beyond rounding."""
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(len(e))])
    k = min(most, len(e))
    return e[:k], v[:, :k], e[:k] > max(e[0], 0) * len(e) * np.finfo(float).eps


def project(vectors: DataFrame, dims: int, n: int, sums: list[int], centre: np.ndarray, base: int, axes: np.ndarray) -> DataFrame:
    """(h, x, weight, deviation, y): each distinct vector's squared distance from the mean, times n squared (exact), and its coordinates along `axes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "x", dims)
            far = n * np.abs(x.astype(float)).max(initial=0) + max(map(abs, sums))
            kind = np.int64 if dims * far * far < 2**62 else object  # Python's integers where a sum might not fit
            moved = n * x.astype(kind) - np.array(sums, kind)
            y = ((x - base) - centre) @ axes
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1])
            columns = [b.column("h"), b.column("x"), b.column("weight"), pa.array((moved * moved).sum(1).tolist(), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "x", "weight", "deviation", "y"])

    return vectors.mapInArrow(run, "h long, x array<long>, weight long, deviation long, y array<double>")


def join_back(rows: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """Each row with its vector's results. Vectors of over n / HOT rows, fewer than HOT in number, are broadcast."""
    hot = vectors.filter(F.col("weight") * HOT > n)
    rare = rows.join(F.broadcast(hot.select("h", "x")), ["h", "x"], "left_anti").join(vectors.filter(F.col("weight") * HOT <= n), ["h", "x"])
    return rare.unionByName(rows.join(F.broadcast(hot), ["h", "x"]))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS, weights: str = "count") -> DataFrame:
    """One row per usable row and component (up to `most`): vec_id, component, n, deviation, whitened, explained, identity_error.

    `weights` says whether a distinct vector counts in the fit as often as it occurs (`count`) or once (`one`); n is the
    number of vectors so counted, and the identity's error is measured with the same weights.
    """
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    rows = rows.filter(usable(v)).select(F.col(f"`{key}`").alias("vec_id"), quantised(v).alias("x"))
    rows = rows.select("vec_id", F.xxhash64("x").alias("h"), "x")
    vectors = materialise(distinct_vectors(rows), "vectors")
    lengths = vectors.select(F.size("x").alias("d")).distinct().limit(2).collect()
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if not lengths:
        return spark.createDataFrame([], schema)
    if len(lengths) > 1:
        raise ValueError("vectors have different lengths")
    dims = lengths[0]["d"]
    fit = vectors if weights == "count" else vectors.withColumn("weight", F.lit(1).cast("long"))
    n, sums = fit.agg(F.sum("weight")).first()[0], _sums(fit, "x")
    base = round(Fraction(sums[0], n))
    centre = np.array([float(Fraction(s, n) - base) for s in sums])
    covariance = weighted_covariance(fit, "x", centre, n, base)
    e, axes, real = components(covariance, most)
    trace = float(np.trace(covariance))
    scaled = np.where(real, axes / np.sqrt(np.where(real, e, 1.0)), 0.0)
    done = materialise(project(vectors, dims, n, sums, centre, base, scaled), "whitened")
    fit = done if weights == "count" else done.withColumn("weight", F.lit(1).cast("long"))
    got = weighted_covariance(fit, "y", np.array([s / n for s in _sums(fit, "y")]), n)
    error = float(np.abs(got - np.eye(len(e)))[np.ix_(real, real)].max()) if real.any() else None
    explained = F.array(*[F.lit(float(a) / trace if trace > 0 else None).cast("double") for a in e])
    flags = F.array(*[F.lit(bool(r)) for r in real])
    back = join_back(rows, done, vectors.agg(F.sum("weight")).first()[0] if weights != "count" else n)
    back = back.select("vec_id", "deviation", F.posexplode("y").alias("i", "c"))
    return back.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                       F.when(F.get(flags, F.col("i")), F.col("c")).alias("whitened"), F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
