"""Tail probabilities as Arrow batches: vectorised numpy, no scipy needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers: Stirling's series above 10, shifted up to there below."""
    x = np.asarray(x, float)
    # x (x+1) ... until 10 or more: at most ten factors
    steps = np.maximum(0, np.ceil(10.0 - x))
    product, y = np.ones_like(x), x
    for i in range(int(steps.max()) if steps.size and not np.isnan(steps).all() else 0):
        product = np.where(i < steps, product * (x + i), product)
    y = x + steps
    inverse = 1.0 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse * (1 / 1680 - inverse * (1 / 1188 - inverse * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def normal_upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2.0))


def reg_inc_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    inside = (xx > 0.0) & (xx < 1.0) & (aa > 0) & (bb > 0)
    safe_x = np.where(inside, xx, 0.5)
    safe_a, safe_b = np.where(inside, aa, 1.0), np.where(inside, bb, 1.0)
    front = np.exp(
        _lgamma(safe_a + safe_b) - _lgamma(safe_a) - _lgamma(safe_b)
        + safe_a * np.log(safe_x) + safe_b * np.log1p(-safe_x)
    ) / safe_a
    tiny = 1e-300
    c = np.ones_like(safe_x)
    d = 1.0 - (safe_a + safe_b) * safe_x / (safe_a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        even = m * (safe_b - m) * safe_x / ((safe_a + 2 * m - 1) * (safe_a + 2 * m))
        odd = -(safe_a + m) * (safe_a + safe_b + m) * safe_x / ((safe_a + 2 * m) * (safe_a + 2 * m + 1))
        for coef in (even, odd):
            d = 1.0 + coef * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    value = np.where(inside, front * h, np.where(xx >= 1.0, 1.0, 0.0))
    value = np.where(swap, 1.0 - value, value)
    return np.where(np.isnan(a) | np.isnan(b) | np.isnan(x), np.nan, value)


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        tail = 0.5 * reg_inc_beta(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, tail, 1.0 - tail)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper-side quantile, once per distinct degree of freedom: a bracket, then secant steps kept inside it."""
    df = np.asarray(df, float)
    degrees, where = np.unique(df, return_inverse=True)
    target = 1.0 - p
    lo, hi = np.zeros_like(degrees), np.ones_like(degrees)
    while (low := t_upper(hi, degrees) > target).any():
        lo, hi = np.where(low, hi, lo), np.where(low, hi * 2, hi)
        if hi.max() > 1e300:
            break
    flo, fhi = t_upper(lo, degrees) - target, t_upper(hi, degrees) - target
    for i in range(100):
        with np.errstate(all="ignore"):
            cut = hi - fhi * (hi - lo) / (fhi - flo)
        middle = 0.5 * (lo + hi)
        # a bisection every third step bounds the number of steps
        mid = np.where((i % 3 == 2) | ~(cut > lo) | ~(cut < hi), middle, cut)
        f = t_upper(mid, degrees) - target
        up = f > 0
        lo, flo, hi, fhi = np.where(up, mid, lo), np.where(up, f, flo), np.where(up, hi, mid), np.where(up, fhi, f)
        if np.all((hi - lo <= 1e-15 * np.maximum(1, hi)) | (f == 0) | np.isnan(degrees)):
            break
    best = np.where(np.abs(flo) < np.abs(fhi), lo, hi)
    return np.where(np.isnan(degrees), np.nan, best)[where].reshape(df.shape)


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        x = d2 / (d2 + d1 * np.maximum(f, 0.0))
    return reg_inc_beta(d2 / 2.0, d1 / 2.0, x)


def hypergeom_upper_ln(k: np.ndarray, white: np.ndarray, total: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for draws without replacement; terms follow a ratio recurrence."""
    k, white, total, drawn = (np.asarray(v, float) for v in (k, white, total, drawn))
    black = total - white
    low = np.maximum(k, np.maximum(0.0, drawn - black))
    high = np.minimum(white, drawn)
    valid = (low <= high) & ~np.isnan(k)
    k0 = np.where(valid, low, 0.0)
    w, b, n = np.where(valid, white, 1.0), np.where(valid, black, 1.0), np.where(valid, drawn, 1.0)
    k0 = np.where(valid, k0, 0.0)

    def choose(a: np.ndarray, c: np.ndarray) -> np.ndarray:
        return _lgamma(a + 1) - _lgamma(c + 1) - _lgamma(a - c + 1)

    first = choose(w, k0) + choose(b, n - k0) - choose(w + b, n)
    total_rel = np.ones_like(k0)
    # only rows whose terms still matter stay in the loop
    at = np.nonzero(valid & (k0 < high))[0]
    j, wa, na, slack, top = k0[at], w[at], n[at], (b - n)[at], high[at]
    term, part = np.ones_like(j), np.ones_like(j)
    while len(at):
        term = term * ((wa - j) * (na - j) / ((j + 1.0) * (slack + j + 1.0)))
        part = part + term
        j = j + 1.0
        more = (j < top) & (term > part * 1e-17)
        if not more.all():
            total_rel[at[~more]] = part[~more]
            at, j, wa, na, slack, top, term, part = (v[more] for v in (at, j, wa, na, slack, top, term, part))
    out = np.minimum(first + np.log(total_rel), 0.0)
    out = np.where(valid, out, -np.inf)
    return np.where(np.isnan(k) | np.isnan(white) | np.isnan(total) | np.isnan(drawn), np.nan, out)


def _series(values: np.ndarray) -> pd.Series:
    return pd.Series(values).where(~np.isnan(values))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    v = z.to_numpy(float)
    return _series(2.0 * normal_upper(np.abs(v)))


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_upper(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_inverse(p: pd.Series, df: pd.Series) -> pd.Series:
    given, out = p.to_numpy(float), np.full(len(p), np.nan)
    for q in np.unique(given[~np.isnan(given)]):
        out[given == q] = t_quantile(q, df.to_numpy(float)[given == q])
    return _series(out)


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_upper(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def hypergeom_log10(k: pd.Series, white: pd.Series, total: pd.Series, drawn: pd.Series) -> pd.Series:
    v = hypergeom_upper_ln(k.to_numpy(float), white.to_numpy(float), total.to_numpy(float), drawn.to_numpy(float))
    return _series(v / math.log(10.0))
