"""Fused fits.

Operators register the statistics they need (``need``) and ``run``
computes all of them with as few passes as possible: every simple
aggregate of every column in one ``agg``; quantiles reuse that pass's
count/min/max and then narrow (``kiln.functions.quantile``); modes are one
``groupBy`` per column.  The driver receives O(requests) numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.quantile import quantiles

_SIMPLE = {
    "count": lambda c: F.count(c),
    "rows": lambda c: F.count(F.lit(1)),
    "nulls": lambda c: F.count_if(F.col(c).isNull()),
    "avg": lambda c: F.avg(c),
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "stddev_samp": lambda c: F.stddev_samp(c),
    "stddev_pop": lambda c: F.stddev_pop(c),
    "var_pop": lambda c: F.var_pop(c),
    "var_samp": lambda c: F.var_samp(c),
    "skewness": lambda c: F.skewness(c),
    "kurtosis": lambda c: F.kurtosis(c),
    "count_distinct": lambda c: F.count_distinct(c),
}


class Fit:
    """Collects statistic requests and computes them together."""

    def __init__(self) -> None:
        self.simple: dict[tuple, None] = {}
        self.quant: dict[str, set[float]] = {}
        self.modes: set[str] = set()

    def need(self, kind: str, column: str | None = None, p: float | None = None) -> tuple:
        if kind == "quantile":
            self.quant.setdefault(column, set()).add(float(p))
            for k in ("count", "min", "max"):
                self.simple[(k, column)] = None
            return ("quantile", column, float(p))
        if kind == "mode":
            self.modes.add(column)
            return ("mode", column)
        if kind not in _SIMPLE:
            raise ValueError(f"unknown statistic {kind!r}")
        self.simple[(kind, column)] = None
        return (kind, column)

    def empty(self) -> bool:
        return not (self.simple or self.quant or self.modes)

    def run(self, df: DataFrame) -> dict:
        out: dict = {}
        keys = list(self.simple)
        if keys:
            exprs = []
            for i, (kind, col) in enumerate(keys):
                e = _SIMPLE[kind](col)
                if kind in ("min", "max"):
                    e = e.cast("double") if _is_numeric(df, col) else e
                exprs.append(e.alias(f"s{i}"))
            row = df.agg(*exprs).collect()[0]
            for i, k in enumerate(keys):
                out[k] = row[f"s{i}"]
        if self.quant:
            base = {c: (out[("count", c)], out[("min", c)], out[("max", c)]) for c in self.quant}
            req = {c: sorted(ps) for c, ps in self.quant.items()}
            res = quantiles(df, req, base=base)
            for c, ps in req.items():
                for p, v in zip(ps, res[c]):
                    out[("quantile", c, p)] = v
        for c in sorted(self.modes):
            out[("mode", c)] = mode_value(df, c)
        return out


def _is_numeric(df: DataFrame, col: str) -> bool:
    from kiln.functions.nulls import is_numeric
    return col in df.columns and is_numeric(df, col)


def mode_counts(df: DataFrame, column: str) -> DataFrame:
    """Value counts of non-NULL values (partial aggregation map-side)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def mode_value(df: DataFrame, column: str):
    """Smallest of the most frequent values (pandas ``mode()[0]``)."""
    top = mode_counts(df, column).orderBy(F.desc("n"), F.asc(column)).limit(1).collect()
    return top[0][column] if top else None


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most-frequent values, ascending (pandas ``mode()``), as a DataFrame."""
    vc = mode_counts(df, column)
    top = vc.agg(F.max("n").alias("m"))
    return vc.join(F.broadcast(top), vc["n"] == top["m"]).select(column).orderBy(column)


def sample_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population skewness."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population kurtosis."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
