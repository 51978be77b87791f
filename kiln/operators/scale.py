"""Scaling and mathematical transforms.

Three scalers differ from Spark ML defaults on purpose: ``standard`` uses
the population std (``ml.StandardScaler`` uses the sample std), ``minmax``
maps a constant column to the range minimum (``ml.MinMaxScaler`` gives
0.5), and ``robust`` divides by the exact IQR.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.nulls import nan_to_null_col
from kiln.functions.stats import Fit
from kiln.operators.base import Step, run_steps


def log1p(c: Column) -> Column:
    """Natural log(1 + x); x <= -1 gives NULL (numpy: -inf / NaN)."""
    return F.log1p(c)


def sqrt(c: Column) -> Column:
    """Square root; negative gives missing (numpy NaN)."""
    return nan_to_null_col(F.sqrt(c))


@dataclass
class Scale(Step):
    column: str
    method: str = "standard"
    feature_range: tuple = (0.0, 1.0)

    def reads(self):
        return {self.column}

    def writes(self):
        return {self.column}

    def request(self, fit: Fit) -> None:
        c, m = self.column, self.method
        if m in ("standard", "zscore"):
            self._k = (fit.need("avg", c), fit.need("stddev_pop", c))
        elif m == "minmax":
            self._k = (fit.need("min", c), fit.need("max", c))
        elif m == "robust":
            self._k = tuple(fit.need("quantile", c, p) for p in (0.25, 0.5, 0.75))
        elif m == "standardize":       # EDA: sample std
            self._k = (fit.need("avg", c), fit.need("stddev_samp", c))
        elif m == "normalize":         # EDA: constant column -> missing
            self._k = (fit.need("min", c), fit.need("max", c))
        else:
            raise ValueError(f"unknown scaling method {m!r}")

    def expr(self, stats: dict) -> Column:
        x = F.col(self.column).cast("double")
        v = [stats[k] for k in self._k]
        if any(s is None for s in v):
            return x
        m = self.method
        if m in ("standard", "zscore"):
            mean, sd = v
            return (x - F.lit(mean)) / F.lit(sd if sd != 0 else 1.0)
        if m == "minmax":
            lo, hi = v
            r0, r1 = (float(r) for r in self.feature_range)
            rng = hi - lo if hi != lo else 1.0
            scale = (r1 - r0) / rng
            return x * F.lit(scale) + F.lit(r0 - lo * scale)
        if m == "robust":
            q1, med, q3 = v
            iqr = q3 - q1 if q3 != q1 else 1.0
            return (x - F.lit(med)) / F.lit(iqr)
        if m == "standardize":
            mean, sd = v
            return F.when(F.lit(sd) != 0, (x - F.lit(mean)) / F.lit(sd if sd else 1.0))
        lo, hi = v
        return F.when(F.lit(hi - lo) != 0, (x - F.lit(lo)) / F.lit((hi - lo) or 1.0))

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        return df.withColumn(self.column, self.expr(stats))


def scale(df: DataFrame, columns: list[str], method: str = "standard", feature_range=(0, 1)) -> DataFrame:
    """Scale several columns; all statistics come from one fused pass."""
    return run_steps(df, [Scale(c, method, tuple(feature_range)) for c in columns])


def eda_transform(df: DataFrame, column: str, method: str, bins: int = 5) -> DataFrame:
    """EDA ``transform``: (original, transformed) over the non-missing rows."""
    data = df.select(F.col(column).alias("original")).where(F.col("original").isNotNull())
    if method == "log":
        return data.withColumn("transformed", log1p(F.col("original")))
    if method == "sqrt":
        return data.withColumn("transformed", sqrt(F.col("original")))
    if method in ("standardize", "normalize"):
        st = Scale("original", method)
        fit = Fit()
        st.request(fit)
        return data.withColumn("transformed", st.expr(fit.run(data)))
    if method == "bin":
        from kiln.operators.bins import bin_codes
        return bin_codes(data, "original", bins, out="transformed")
    raise ValueError(f"unknown transform {method!r}")


def interaction(df: DataFrame, col1: str, col2: str, new: str) -> DataFrame:
    """Product of two columns."""
    return df.withColumn(new, F.col(col1) * F.col(col2))


def polynomial(df: DataFrame, column: str, degree: int = 2, new: str | None = None) -> DataFrame:
    """Power of a column."""
    return df.withColumn(new or f"{column}_pow{degree}", F.pow(F.col(column), F.lit(degree)))


def transform(df: DataFrame, columns: list[str], method: str) -> DataFrame:
    """Feature-service ``transformation``: log / sqrt / boxcox / yeojohnson."""
    if method == "log":
        return df.withColumns({c: log1p(F.col(c)) for c in columns})
    if method == "sqrt":
        return df.withColumns({c: sqrt(F.col(c)) for c in columns})
    if method in ("boxcox", "yeojohnson"):
        from kiln.operators.power import power_transform
        for c in columns:
            df, _ = power_transform(df, c, method)
        return df
    raise ValueError(f"unknown transformation {method!r}")
