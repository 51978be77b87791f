"""Power transforms with maximum-likelihood lambda (T8 Box-Cox, T9 Yeo-Johnson).

The profile log-likelihood of lambda needs, per lambda, the population
variance of the transformed column and one sum of logs.  A grid of
lambdas is evaluated in **one** pass, the grid is narrowed around the best
point, and this repeats; each round is one pass over one column.  Box-Cox
takes one logarithm per row and merges counts, means and squared deviations
per grid point over batches and tasks; Yeo-Johnson is one aggregate with a
``var_pop`` per grid point (its likelihood may be so flat that another order
of rounding moves the lambda).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 21
ROUNDS = 7


def boxcox_expr(x: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.log(x)
    return (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def yeojohnson_expr(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _powers(log: np.ndarray, lam: float) -> np.ndarray:
    """(e^log)^lam as a Box-Cox value."""
    return log if abs(lam) < 1e-12 else np.expm1(lam * log) / lam


def _merged(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple:
    """Counts, means and squared deviations of all parts together; a row per part, a column per lambda."""
    total = n.sum()
    whole = (n[:, None] * mean).sum(axis=0) / total
    return total, whole, (m2 + n[:, None] * (mean - whole) ** 2).sum(axis=0)


def _moments(lams: list[float]):
    """The moments of a task's rows under every lambda of Box-Cox, one row."""
    def run(batches):
        found, logs = [], 0.0
        with np.errstate(all="ignore"):
            for pdf in batches:
                if len(pdf):
                    log = np.log(pdf["x"].to_numpy(float))
                    logs += log.sum()
                    values = [(v.mean(), ((v - v.mean()) ** 2).sum()) for v in (_powers(log, l) for l in lams)]
                    found.append((len(log), [m for m, _ in values], [s for _, s in values]))
            if found:
                n, mean, m2 = _merged(*(np.array(c, dtype=float) for c in zip(*found)))
                yield pd.DataFrame({"n": [int(n)], "ls": [float(logs)], "mean": [mean.tolist()], "m2": [m2.tolist()]})

    return run


def _boxcox_round(data: DataFrame, lams: list[float]) -> tuple:
    """(rows, sum of logarithms, variance under every lambda)."""
    rows = data.mapInPandas(_moments(lams), "n long, ls double, mean array<double>, m2 array<double>").collect()  # one row per task
    if not rows:
        return 0, None, [None] * len(lams)
    with np.errstate(all="ignore"):
        n, _, m2 = _merged(*(np.array([r[c] for r in rows], dtype=float) for c in ("n", "mean", "m2")))
        return int(n), sum(math.nan if r["ls"] is None else r["ls"] for r in rows), (m2 / n).tolist()


def _yeojohnson_round(data: DataFrame, lams: list[float]) -> tuple:
    x = F.col("x")
    row = data.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("ls"),
                   *[F.var_pop(yeojohnson_expr(x, l)).alias(f"v{i}") for i, l in enumerate(lams)]).collect()[0]
    return row["n"], row["ls"], [row[f"v{i}"] for i in range(len(lams))]


def _llf_round(data: DataFrame, method: str, lams: list[float]):
    n, ls, variances = (_boxcox_round if method == "boxcox" else _yeojohnson_round)(data, lams)
    best, best_l = -math.inf, None
    for v, l in zip(variances, lams):
        if v is None or v <= 0 or math.isnan(v) or math.isinf(v):
            continue
        llf = (l - 1) * ls - n / 2.0 * math.log(v)
        if llf > best:
            best, best_l = llf, l
    return best_l, best


def fit_lambda(df: DataFrame, column: str, method: str = "yeojohnson", shift: float = 0.0,
               lo: float = -5.0, hi: float = 5.0) -> float:
    data = df.select((F.col(column).cast("double") + F.lit(shift)).alias("x")).where(F.col("x").isNotNull())
    if method == "boxcox":
        mn = data.agg(F.min("x")).collect()[0][0]
        if mn is None or mn <= 0:
            raise ValueError("Data must be positive.")
    step = (hi - lo) / (GRID - 1)
    center = None
    for _ in range(ROUNDS):
        lams = [lo + i * step for i in range(GRID)] if center is None else \
            [center + (i - GRID // 2) * step for i in range(GRID)]
        center, _ = _llf_round(data, method, lams)
        if center is None:
            raise ValueError("no finite likelihood on the lambda grid")
        step = step * 2 / (GRID - 1)
    return center


def power_transform(df: DataFrame, column: str, method: str = "yeojohnson",
                    lam: float | None = None) -> tuple[DataFrame, float]:
    """Transform ``column`` in place; Box-Cox is applied to x + 1 (as the
    reference).  Returns the frame and the lambda used."""
    shift = 1.0 if method == "boxcox" else 0.0
    if lam is None:
        lam = fit_lambda(df, column, method, shift)
    x = F.col(column).cast("double") + F.lit(shift)
    expr = boxcox_expr(x, lam) if method == "boxcox" else yeojohnson_expr(x, lam)
    return df.withColumn(column, expr), lam
