"""P-values of path counts: spread, gamma hurdle, empirical cases."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Fixed value: differences below it count as rounding.
TOLERANCE = 1e-5

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _away(z: np.ndarray) -> np.ndarray:
    """z, kept from zero."""
    return np.where(np.abs(z) < 1e-300, 1e-300, z)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0, x >= 0; NaN elsewhere.

    A series below x = a + 1, a continued fraction (Lentz) from there on; both run until every
    row has settled. They need about 5 sqrt(a) terms.
    """
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    fine = (a > 0) & (x >= 0) & np.isfinite(a)
    out[fine & (x == 0)] = 1.0
    out[fine & np.isinf(x)] = 0.0
    fine &= (x > 0) & np.isfinite(x)
    for part, low in ((fine & (x < a + 1), True), (fine & (x >= a + 1), False)):
        if not part.any():
            continue
        s, y = a[part], x[part]
        front = np.exp(s * np.log(y) - y - _lgamma(s))
        limit = int(200 + 20 * math.sqrt(s.max()))
        if low:
            term = total = 1 / s
            for k in range(1, limit):
                term = term * y / (s + k)
                total = total + term
                if (term < total * 1e-16).all():
                    break
            out[part] = 1 - front * total
        else:
            b = y + 1 - s
            c, d = np.full_like(b, 1e300), 1 / b
            h = d
            for k in range(1, limit):
                an = k * (s - k)
                b = b + 2
                d = 1 / _away(an * d + b)
                c = _away(b + an / c)
                h = h * d * c
                if (np.abs(d * c - 1) < 1e-15).all():
                    break
            out[part] = front * h
    return np.clip(out, 0.0, 1.0)


@pandas_udf(DoubleType())
def _upper_gamma(a: pd.Series, x: pd.Series) -> pd.Series:
    q = upper_gamma(a.to_numpy(float), x.to_numpy(float))
    return pd.Series(q).astype(object).where(~np.isnan(q), None)


def sd_nonzero(sum_of_squares: Column, total: Column, nnz: Column) -> Column:
    """Standard deviation of nnz values: null below two, 0 where the squares about the mean are rounding."""
    about = sum_of_squares - total * total / F.when(nnz > 0, nnz)
    return F.when(nnz >= 2, F.when(F.abs(about) < TOLERANCE, 0.0).otherwise(F.sqrt(about / F.when(nnz > 1, nnz - 1))))


def add_gamma_hurdle(groups: DataFrame) -> DataFrame:
    """mean_nz, sd_nz, beta, alpha from nnz, sum, sum_of_squares; null where undefined."""
    missing = {"nnz", "sum", "sum_of_squares"} - set(groups.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    out = groups.withColumn("mean_nz", F.try_divide("sum", "nnz"))
    out = out.withColumn("sd_nz", sd_nonzero(F.col("sum_of_squares"), F.col("sum"), F.col("nnz")))
    out = out.withColumn("beta", F.try_divide(F.col("mean_nz"), F.col("sd_nz") * F.col("sd_nz")))
    return out.withColumn("alpha", F.col("mean_nz") * F.col("beta"))


def _no_path(columns: list[str]) -> Column:
    return F.coalesce(F.col("path_count" if "path_count" in columns else "dwpc") == 0, F.lit(False))


def with_p_value(rows: DataFrame) -> DataFrame:
    """p_value from dwpc, nnz, n, mean_nz, sd_nz (and path_count, alpha and beta if there).

    No path: 1. No permuted path: 0. No spread: nnz / n up to the mean, 0 above it. Else the gamma
    hurdle nnz / n * Q(alpha, beta * dwpc). Only rows of the last case meet Python.
    """
    columns = rows.columns
    spread = F.coalesce(F.col("sd_nz") > 0, F.lit(False))
    share = F.try_divide("nnz", "n")
    beta = F.try_divide(F.col("mean_nz"), F.col("sd_nz") * F.col("sd_nz"))
    alpha = F.col("alpha") if "alpha" in columns else F.col("mean_nz") * beta
    beta = F.col("beta") if "beta" in columns else beta
    hurdle = ~_no_path(columns) & (F.col("nnz") != 0) & spread
    plain = (
        F.when(_no_path(columns), 1.0)
        .when(F.col("nnz") == 0, 0.0)
        .when(F.col("dwpc") <= F.col("mean_nz") + TOLERANCE, share)
        .otherwise(0.0)
    )
    tail = _upper_gamma(F.when(hurdle, alpha), F.when(hurdle, beta * F.col("dwpc")))
    return rows.withColumn("_tail", tail).withColumn("p_value", F.when(hurdle, share * F.col("_tail")).otherwise(plain)).drop("_tail")
