"""Symmetric and general small matrices as Column expressions; batched numpy where no closed form exists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import _c


def _finite(x: Column) -> Column:
    """0 in place of NaN and NULL."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def tensor_invariants(xx, xy, xz, yy, yz, zz) -> dict[str, Column]:
    """Trace, Frobenius norm and fractional anisotropy sqrt(3/2) |D| / |T| (0 for a zero tensor); D is the deviatoric part."""
    xx, xy, xz, yy, yz, zz = map(_c, (xx, xy, xz, yy, yz, zz))
    trace = xx + yy + zz
    m = trace / 3
    off = 2 * (xy * xy + xz * xz + yz * yz)
    square = xx * xx + yy * yy + zz * zz + off
    deviatoric = (xx - m) ** 2 + (yy - m) ** 2 + (zz - m) ** 2 + off
    fa = F.when(square > 0, F.sqrt(F.lit(1.5) * deviatoric / square)).otherwise(F.lit(0.0))
    return {"trace": trace, "frobenius": F.sqrt(square), "fa": fa}


def sym_eig2(xx, xy, yy) -> tuple[Column, Column, Column, Column]:
    """Eigenvalues (descending) and the unit vector of the larger one."""
    xx, xy, yy = map(_c, (xx, xy, yy))
    mean, half = (xx + yy) / 2, (xx - yy) / 2
    root = F.sqrt(half * half + xy * xy)
    angle = F.atan2(xy, half) / 2
    return mean + root, mean - root, F.cos(angle), F.sin(angle)


def eigenvectors2(xx, xy, yx, yy) -> tuple[Column, Column, Column, Column]:
    """Unit eigenvectors (x0, y0, x1, y1) of a 2 x 2 matrix that needn't be symmetric, the larger eigenvalue's first.

    NULL where the eigenvalues aren't real, or the matrix is a multiple of the identity. Either sign may result.
    """
    xx, xy, yx, yy = map(_c, (xx, xy, yx, yy))
    half, root = (xx + yy) / 2, (xx - yy) * (xx - yy) / 4 + xy * yx
    out = []
    for sign in (1, -1):
        value = half + sign * F.when(root >= 0, F.sqrt(F.greatest(root, F.lit(0.0))))
        rows = [(xy, value - xx), (value - yy, yx)]  # both solve the equation; the longer one is the safer
        n = [F.sqrt(a * a + b * b) for a, b in rows]
        first = n[0] >= n[1]
        for k in (0, 1):
            out.append(F.when(F.greatest(*n) > 0, F.when(first, rows[0][k] / n[0]).otherwise(rows[1][k] / n[1])))
    return tuple(out)


def sym_eig3(xx, xy, xz, yy, yz, zz) -> tuple[Column, Column, Column]:
    """Eigenvalues, descending, by the trigonometric closed form."""
    xx, xy, xz, yy, yz, zz = map(_c, (xx, xy, xz, yy, yz, zz))
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * off) / 6)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (2 * p * p * p)).otherwise(F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3
    high = q + 2 * p * F.cos(angle)
    low = q + 2 * p * F.cos(angle + F.lit(2 * math.pi / 3))
    return high, 3 * q - high - low, low


def principal_vector3(xx, xy, xz, yy, yz, zz, value) -> tuple[Column, Column, Column]:
    """A unit eigenvector of the eigenvalue: the longest cross product of two rows of T - value. NULL where the value is repeated."""
    xx, xy, xz, yy, yz, zz, v = map(_c, (xx, xy, xz, yy, yz, zz, value))
    rows = [(xx - v, xy, xz), (xy, yy - v, yz), (xz, yz, zz - v)]
    cross = lambda r, s: (r[1] * s[2] - r[2] * s[1], r[2] * s[0] - r[0] * s[2], r[0] * s[1] - r[1] * s[0])
    each = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    best = F.array_max(F.array(*[F.struct((x * x + y * y + z * z).alias("n"), x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in each]))
    scale = F.sqrt(best["n"])
    return tuple(F.when(scale > 0, best[k] / scale) for k in ("x", "y", "z"))


def westin_anisotropy(l1, l2, l3) -> dict[str, Column]:
    """Linear, planar and spherical shares of sorted eigenvalues; they sum to 1. NULL for a zero trace."""
    l1, l2, l3 = map(_c, (l1, l2, l3))
    t = l1 + l2 + l3
    share = lambda x: F.when(t != 0, x / t)
    return {"cl": share(l1 - l2), "cp": share(2 * (l2 - l3)), "cs": share(3 * l3)}


def matrix_transpose(m, n: int) -> Column:
    """Row-major n x n arrays."""
    return F.array(*[F.get(_c(m), F.lit(j * n + i)) for i in range(n) for j in range(n)])


def matrix_sum(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def matrix_difference(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def _product(at, bt, n: int) -> Column:
    return F.array(*[sum((at(i, k) * bt(k, j) for k in range(1, n)), at(i, 0) * bt(0, j)) for i in range(n) for j in range(n)])


def matrix_product(a, b, n: int) -> Column:
    return _product(lambda i, k: F.get(_c(a), F.lit(i * n + k)), lambda k, j: F.get(_c(b), F.lit(k * n + j)), n)


def matrix_tproduct(a, b, n: int) -> Column:
    """A transposed times B; with b = a the Cauchy-Green tensor."""
    return _product(lambda i, k: F.get(_c(a), F.lit(k * n + i)), lambda k, j: F.get(_c(b), F.lit(k * n + j)), n)


def matrix_map(df: DataFrame, column: str, op: str, n: int) -> DataFrame:
    """`df` with inverse, singular values, or eigenvalues (real parts, descending) of row-major n x n arrays as column `op`.

    Batched numpy on Arrow batches. NULL for a NULL matrix, one of the wrong length or with NaN, and an exactly singular inverse.
    """
    if op not in ("inverse", "svd", "eigen"):
        raise ValueError(op)

    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
        ok = s.map(lambda x: x is not None and len(x) == n * n and all(v is not None and v == v for v in x)).astype(bool)
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if ok.any():
            m = np.stack([np.asarray(x, float).reshape(n, n) for x in s[ok]])
            good = np.ones(len(m), bool)
            if op == "inverse":
                good = np.linalg.matrix_rank(m) == n
                r = np.zeros((len(m), n * n))
                r[good] = np.linalg.inv(m[good]).reshape(-1, n * n)
            elif op == "svd":
                r = np.linalg.svd(m, compute_uv=False)
            else:
                r = -np.sort(-np.linalg.eigvals(m).real, axis=1)
            for i, x, g in zip(np.flatnonzero(ok), r, good):
                out.iat[i] = x.tolist() if g else None
        return out

    return df.withColumn(op, apply(F.col(column)))
