"""The numerical end of a least-squares fit: a few numbers in, one row out."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Ship these helpers with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A predictor whose variance is explained by earlier ones up to this share is aliased.
ALIAS_TOLERANCE = 1e-10


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    # Modified Lentz evaluation: d and c are the two running ratios.
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return math.exp(log_front) * value / a


def t_p_value(t: float, df: float) -> float:
    """Two-sided tail of Student's t distribution."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def f_p_value(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return incomplete_beta(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def independent_columns(corr: np.ndarray) -> list[int]:
    """Indices of predictors not explained by the ones before them."""
    left = corr.copy()
    kept = []
    for j in range(len(left)):
        if not left[j, j] > ALIAS_TOLERANCE:
            continue
        kept.append(j)
        left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
    return kept


def _number(v: float) -> float | None:
    return float(v) if v is not None and math.isfinite(v) else None


def solve(n: int, means: np.ndarray, covariances: np.ndarray) -> dict:
    """Fit from the moments of (y, x1, ..); covariances are the upper triangle."""
    size = len(means)
    cov = np.zeros((size, size))
    cov[np.triu_indices(size)] = covariances
    cov = cov + cov.T - np.diag(np.diag(cov))
    scale = np.sqrt(np.clip(np.diag(cov), 0.0, None))
    # A predictor whose spread is rounding noise around its mean is constant.
    scale[scale <= 1e-12 * np.abs(means)] = 0.0
    safe = np.where(scale > 0, scale, 1.0)
    corr = cov / np.outer(safe, safe)
    corr[scale == 0, :] = 0.0
    corr[:, scale == 0] = 0.0

    predictors = size - 1
    kept = independent_columns(corr[1:, 1:])
    used = [j + 1 for j in kept]
    rank = len(used)
    df = n - rank - 1
    none = [None] * predictors

    inverse = np.linalg.inv(corr[np.ix_(used, used)]) if used else np.zeros((0, 0))
    beta = inverse @ corr[used, 0]
    r2 = float(beta @ corr[used, 0]) if scale[0] > 0 else math.nan
    total = n * cov[0, 0]
    rss = max(total * (1.0 - r2), 0.0) if scale[0] > 0 else 0.0
    slopes = beta * scale[0] / scale[used]
    sigma2 = rss / df if df > 0 else math.nan

    centered = inverse / np.outer(scale[used], scale[used])
    intercept = float(means[0] - slopes @ means[used])
    at_zero = (1.0 + means[used] @ centered @ means[used]) / n
    errors = np.sqrt(np.append(at_zero, np.diag(centered) / n) * sigma2)

    def spread(values) -> list[float | None]:
        out = list(none)
        for j, v in zip(kept, values):
            out[j] = _number(v)
        return out

    estimates = [intercept, *spread(slopes)]
    std_errors = [_number(errors[0]), *spread(errors[1:])]
    t_values = [
        e / s if e is not None and s else None for e, s in zip(estimates, std_errors)
    ]
    p_values = [None if t is None else t_p_value(t, df) for t in t_values]
    f_value = (r2 / rank) / ((1.0 - r2) / df) if rank and df > 0 and r2 < 1.0 else math.nan
    return {
        "n": n,
        "df": df,
        "coefficients": estimates,
        "std_errors": std_errors,
        "t_values": t_values,
        "p_values": p_values,
        "vifs": spread(np.diag(inverse)),
        "r2": _number(r2),
        "adj_r2": _number(1.0 - (1.0 - r2) * (n - 1) / df) if df > 0 else None,
        "sigma": _number(math.sqrt(sigma2)) if df > 0 else None,
        "f_value": _number(f_value),
        "f_df": rank,
        "f_p_value": f_p_value(f_value, rank, df) if math.isfinite(f_value) else None,
    }


def moment_solver(keys: list[str]):
    """A mapInPandas function over moment rows: one fitted row per moment row."""

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                fit = solve(
                    int(row["n"]), np.asarray(row["means"]), np.asarray(row["covariances"])
                )
                rows.append({**{k: row[k] for k in keys}, **fit})
            if rows:
                yield pd.DataFrame(rows)

    return run
