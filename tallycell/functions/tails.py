"""Student-t and beta tails as Arrow-batched column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def regularized_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
        if np.nanmax(np.abs(c * d - 1), initial=0.0) < 1e-14:
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out = np.full(len(t), np.nan)
    if ok.any():
        out[ok] = regularized_beta(df[ok] / 2, np.full(ok.sum(), 0.5), df[ok] / (df[ok] + t[ok] ** 2))
    return pd.Series(out).where(ok, None)


def student_two_sided_p(t: Column, df: Column) -> Column:
    """``2 * P(T_df > |t|)``; NULL where the statistic is undefined."""
    return _t_two_sided(t.cast("double"), df.cast("double"))
