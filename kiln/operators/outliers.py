"""Outlier handling (O1-O4, O6-O8, O10-O13; O5/O9 in ``iforest``).

Four different z-scores exist in the reference: cleaning uses the sample
std (O1/O2), detection the population std (O10).  Spark's
``greatest/least`` skip NULLs, so every clamp is guarded to keep NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import count_within
from kiln.functions.stats import Fit
from kiln.operators.base import Step, run_steps


def clamp(c: Column, lower, upper) -> Column:
    """NULL-preserving clip (pandas ``clip`` keeps missing values)."""
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, F.lit(upper))
    return F.when(c.isNotNull(), out)


@dataclass
class ZScoreOutlier(Step):
    """O1 (remove: keep ``|z| < t``) and O2 (cap to mean +- t*std), sample std."""

    column: str
    action: str = "remove"
    threshold: float = 3.0

    @property
    def rows_changing(self):
        return self.action == "remove"

    def reads(self):
        return {self.column}

    def writes(self):
        return {self.column}

    def request(self, fit: Fit) -> None:
        self._m = fit.need("avg", self.column)
        self._s = fit.need("stddev_samp", self.column)

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        m, s = stats[self._m], stats[self._s]
        c = F.col(self.column)
        t = float(self.threshold)
        if self.action == "remove":
            if m is None or not s:
                return df.where(F.lit(False))  # z is undefined for every row
            return df.where(F.abs((c - F.lit(m)) / F.lit(s)) < F.lit(t))
        if m is None or s is None:
            return df
        return df.withColumn(self.column, clamp(c, m - t * s, m + t * s))


@dataclass
class IQROutlier(Step):
    """O3 (remove: keep lower <= x <= upper) and O4 (cap to the fences)."""

    column: str
    action: str = "remove"
    factor: float = 1.5

    @property
    def rows_changing(self):
        return self.action == "remove"

    def reads(self):
        return {self.column}

    def writes(self):
        return {self.column}

    def request(self, fit: Fit) -> None:
        self._q1 = fit.need("quantile", self.column, 0.25)
        self._q3 = fit.need("quantile", self.column, 0.75)

    def fences(self, stats: dict):
        q1, q3 = stats[self._q1], stats[self._q3]
        if q1 is None:
            return None, None
        iqr = q3 - q1
        return q1 - self.factor * iqr, q3 + self.factor * iqr

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        lo, hi = self.fences(stats)
        c = F.col(self.column)
        if self.action == "remove":
            if lo is None:
                return df.where(F.lit(False))
            return df.where((c >= F.lit(lo)) & (c <= F.lit(hi)))
        if lo is None:
            return df
        return df.withColumn(self.column, clamp(c, lo, hi))


@dataclass
class PercentileClip(Step):
    """Clip to given bounds, else to the 5th/95th percentile of each column."""

    column: str
    lower: float | None = None
    upper: float | None = None

    def reads(self):
        return {self.column}

    def writes(self):
        return {self.column}

    def request(self, fit: Fit) -> None:
        self._lo = fit.need("quantile", self.column, 0.05) if self.lower is None else None
        self._hi = fit.need("quantile", self.column, 0.95) if self.upper is None else None

    def bounds(self, stats):
        lo = self.lower if self._lo is None else stats[self._lo]
        hi = self.upper if self._hi is None else stats[self._hi]
        return lo, hi

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        lo, hi = self.bounds(stats)
        return df.withColumn(self.column, clamp(F.col(self.column), lo, hi))


@dataclass
class PercentileRemove(PercentileClip):
    """Inclusive filter to the bounds.  Several columns run in sequence:
    column 2's percentiles are computed on the rows left after column 1."""

    rows_changing = True

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        lo, hi = self.bounds(stats)
        if lo is None or hi is None:
            return df.where(F.lit(False))
        c = F.col(self.column)
        return df.where((c >= F.lit(lo)) & (c <= F.lit(hi)))


def outlier(df: DataFrame, column: str, method: str, action: str = "remove",
            threshold: float = 3.0, factor: float = 1.5, contamination: float = 0.1,
            seed: int = 0) -> DataFrame:
    """Cleaning-service ``outlier`` op."""
    if method == "zscore":
        return run_steps(df, [ZScoreOutlier(column, action, threshold)])
    if method == "iqr":
        return run_steps(df, [IQROutlier(column, action, factor)])
    if method == "isolation_forest":
        from kiln.operators.iforest import isolation_forest_clean
        return isolation_forest_clean(df, column, action, contamination, seed)
    raise ValueError(f"unknown outlier method {method!r}")


def outliers(df: DataFrame, columns: list[str], method: str, lower=None, upper=None) -> DataFrame:
    """Feature-service ``outliers`` op (clip / remove / transform)."""
    if method == "clip":
        return run_steps(df, [PercentileClip(c, lower, upper) for c in columns])
    if method == "remove":
        return run_steps(df, [PercentileRemove(c, lower, upper) for c in columns])
    if method == "transform":
        return df.withColumns({c: F.log1p(F.col(c)) for c in columns})
    raise ValueError(f"unknown outliers method {method!r}")


# ---------------------------------------------------------------- detection

def detect_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Values with ``|z| > t`` using the population std."""
    c = F.col(column)
    data = df.select(column).where(c.isNotNull())
    row = data.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).collect()[0]
    if row["m"] is None or not row["s"]:
        return data.where(F.lit(False))
    return data.where(F.abs((c - F.lit(row["m"])) / F.lit(row["s"])) > F.lit(float(threshold)))


def detect_iqr(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """Values strictly outside the 1.5 IQR fences."""
    c = F.col(column)
    data = df.select(column).where(c.isNotNull())
    fit = Fit()
    q1, q3 = fit.need("quantile", column, 0.25), fit.need("quantile", column, 0.75)
    st = fit.run(data)
    if st[q1] is None:
        return data.where(F.lit(False))
    iqr = st[q3] - st[q1]
    lo, hi = st[q1] - factor * iqr, st[q3] + factor * iqr
    return data.where((c < F.lit(lo)) | (c > F.lit(hi)))


def detect_dbscan(df: DataFrame, column: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN noise in one dimension, exactly.

    A point is core when at least ``min_samples`` points (itself included)
    lie within ``eps``; noise is a non-core point with no core point within
    ``eps``.  Duplicates collapse to (value, multiplicity) first; both
    neighbourhood counts are differences of two global running sums
    (``count_within``), so no task ever holds one dense value range.
    """
    c = F.col(column).cast("double")
    pts = (df.select(c.alias("x")).where(F.col("x").isNotNull())
           .groupBy("x").agg(F.count(F.lit(1)).alias("w")))
    deg = count_within(pts, "x", "w", eps, "degree")
    core = pts.join(deg, "x").withColumn("is_core", (F.col("degree") >= min_samples).cast("double"))
    near = count_within(core.select("x", "is_core"), "x", "is_core", eps, "near_core")
    noise = (core.where(F.col("is_core") == 0).join(near, "x")
             .where(F.col("near_core") == 0).select("x", "w"))
    # one output row per original value, as in the reference's list
    return (noise.select(F.col("x").alias(column),
                         F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("_i"))
            .drop("_i"))


def detection_summary(outliers_df: DataFrame, data: DataFrame, column: str) -> DataFrame:
    """Outlier count and percentage of non-missing values (one row)."""
    n = data.agg(F.count(column).alias("n"), F.lit(1).alias("_k"))
    k = outliers_df.agg(F.count(F.lit(1)).alias("count"), F.lit(1).alias("_k"))
    return k.join(n, "_k").select(
        F.col("count").cast("long").alias("count"),
        F.when(F.col("n") > 0, F.col("count") / F.col("n") * 100.0).alias("percentage"))


def detect(df: DataFrame, column: str, method: str, **kw) -> DataFrame:
    if method == "zscore":
        return detect_zscore(df, column, kw.get("threshold", 3.0))
    if method == "iqr":
        return detect_iqr(df, column)
    if method == "dbscan":
        return detect_dbscan(df, column, kw.get("eps", 0.5), kw.get("min_samples", 5))
    if method == "isolation_forest":
        from kiln.operators.iforest import detect_isolation_forest
        return detect_isolation_forest(df, column, kw.get("contamination", 0.05), kw.get("seed", 0))
    raise ValueError(f"unknown detection method {method!r}")
