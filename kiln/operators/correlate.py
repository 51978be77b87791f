"""Correlation and dependence (K1-K5).

Coefficients are one distributed aggregate; p-values are O(1) functions
of the aggregate, evaluated once on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import lookup, prefix_sum
from kiln.functions.nulls import numeric_columns
from kiln.functions.special import chi2_sf, r_p_value
from kiln.operators.clean import pairwise_valid


def _result(df: DataFrame, method: str, r, p, n) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(method, None if r is None else float(r), None if p is None else float(p), int(n))],
        "method string, correlation double, p_value double, n long")


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """K1: Pearson r on pairwise-complete rows, two-sided p (t, n-2 df)."""
    row = pairwise_valid(df, a, b).agg(F.corr(a, b).alias("r"), F.count(F.lit(1)).alias("n")).collect()[0]
    return _result(df, "pearson", row["r"], r_p_value(row["r"], row["n"]), row["n"])


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average (mid) rank of each distinct value, 1-based, distributed.

    Ranks come from a running count over the distinct values in value
    order (range-partitioned prefix sum), never a one-task sort."""
    vc = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    cum = prefix_sum(vc, [column], "_n", "_cum")
    return cum.select(column, (F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """K2: Pearson correlation of average ranks."""
    data = pairwise_valid(df, a, b).select(a, b)
    ra, rb = average_ranks(data, a, "_ra"), average_ranks(data, b, "_rb")
    ranked = lookup(lookup(data, ra, [a], "inner"), rb, [b], "inner")
    row = ranked.agg(F.corr("_ra", "_rb").alias("r"), F.count(F.lit(1)).alias("n")).collect()[0]
    return _result(df, "spearman", row["r"], r_p_value(row["r"], row["n"]), row["n"])


def pointbiserial(df: DataFrame, a: str, b: str) -> DataFrame:
    """K3: Pearson r when one side has exactly two distinct values (``a``
    is tested first); otherwise an error."""
    data = pairwise_valid(df, a, b)
    d = data.agg(F.count_distinct(a).alias("da"), F.count_distinct(b).alias("db")).collect()[0]
    if d["da"] == 2:
        binary, other = a, b
    elif d["db"] == 2:
        binary, other = b, a
    else:
        raise ValueError("Point-biserial requires one binary variable")
    # the binary side is coded 0/1 by its sorted values (sign as scipy)
    lo = data.agg(F.min(binary)).collect()[0][0]
    coded = data.select((F.col(binary) != F.lit(lo)).cast("double").alias("_bin"), F.col(other).cast("double").alias("_x"))
    row = coded.agg(F.corr("_bin", "_x").alias("r"), F.count(F.lit(1)).alias("n")).collect()[0]
    return _result(df, "pointbiserial", row["r"], r_p_value(row["r"], row["n"]), row["n"])


def chi2_contingency(df: DataFrame, a: str, b: str):
    """Pearson chi-square of the a x b table (zero cells included).

    Sum over cells of (O - E)^2 / E equals sum over non-zero cells of
    O^2 / E minus n, so zero cells never need to be enumerated; only the
    2 x 2 case (Yates correction) lists its four cells."""
    data = pairwise_valid(df, a, b)
    cells = data.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = cells.groupBy(b).agg(F.sum("o").alias("cb"))
    shape = cells.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("k"),
                      F.sum("o").alias("n")).collect()[0]
    r, k, n = shape["r"], shape["k"], shape["n"]
    if not n:
        return None, r, k, 0, None
    dof = (r - 1) * (k - 1)
    joined = lookup(lookup(cells, ra, [a]), cb, [b])
    if dof == 1:
        # 2 x 2 (four cells, bounded): Yates moves each observed count 0.5
        # toward its expectation, so zero cells matter and are listed
        obs = {(c[a], c[b]): c["o"] for c in cells.collect()}
        rows_ = {v: sum(o for (x, _), o in obs.items() if x == v) for v in {x for x, _ in obs}}
        cols_ = {v: sum(o for (_, y), o in obs.items() if y == v) for v in {y for _, y in obs}}
        chi2 = 0.0
        for x, rx in rows_.items():
            for y, cy in cols_.items():
                e = rx * cy / n
                o = obs.get((x, y), 0.0)
                o = o + min(0.5, abs(e - o)) * math.copysign(1.0, e - o) if e != o else o
                chi2 += (o - e) ** 2 / e
    else:
        e = F.col("ra") * F.col("cb") / F.lit(n)
        chi2 = joined.agg(F.sum(F.col("o") * F.col("o") / e)).collect()[0][0] - n
    return chi2, r, k, n, dof


def cramersv(df: DataFrame, a: str, b: str) -> DataFrame:
    """K4: sqrt(chi2 / n / min(r-1, k-1)); p from chi-square with (r-1)(k-1) df."""
    chi2, r, k, n, dof = chi2_contingency(df, a, b)
    m = min(r - 1, k - 1) if r and k else 0
    v = math.sqrt(chi2 / n / m) if chi2 is not None and m > 0 else None
    p = chi2_sf(chi2, dof) if chi2 is not None and dof else None
    return _result(df, "cramersv", v, p, n or 0)


def correlation(df: DataFrame, a: str, b: str, method: str = "pearson") -> DataFrame:
    fn = {"pearson": pearson, "spearman": spearman, "pointbiserial": pointbiserial, "cramersv": cramersv}
    if method not in fn:
        raise ValueError("Invalid correlation method")
    return fn[method](df, a, b)


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K5: pairwise-complete Pearson r of all numeric pairs, long form, one pass."""
    cols = columns or numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols))]
    row = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") if i != j
                   else F.when(F.count(cols[i]) > 1, F.lit(1.0)).alias(f"r{i}_{j}") for i, j in pairs]).collect()[0]
    rows = [(cols[i], cols[j], row[f"r{i}_{j}"]) for i, j in pairs]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")
