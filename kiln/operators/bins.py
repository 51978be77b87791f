"""Binning (B1-B4).

pandas bins are right-closed ``(e_i, e_i+1]``.  ``equal_width`` lowers the
first edge by 0.1% of the range so the minimum is inside; ``equal_freq``
includes the lowest value in the first bin; ``custom`` leaves a value
equal to the first edge outside.  Spark's ``Bucketizer`` and
``width_bucket`` are left-closed, so codes come from an edge search
(a short ``CASE`` chain, one comparison per edge, in codegen).
Output: ``{col}_binned`` = 0-based code, plus ``_lower``/``_upper``
edges, plus the label when labels are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.quantile import quantiles


def width_edges(mn: float, mx: float, bins: int) -> list[float]:
    """Edges of ``pd.cut(x, bins)`` for an integer bin count."""
    if mn == mx:
        mn = mn - (0.001 * abs(mn) if mn != 0 else 0.001)
        mx = mx + (0.001 * abs(mx) if mx != 0 else 0.001)
        step = (mx - mn) / bins
        edges = [i * step + mn for i in range(bins + 1)]
        edges[-1] = mx
        return edges
    step = (mx - mn) / bins
    edges = [i * step + mn for i in range(bins + 1)]
    edges[-1] = mx
    edges[0] = edges[0] - (mx - mn) * 0.001
    return edges


def _search(x: Column, edges: list[float], values: list, include_lowest: bool) -> Column:
    """Right-closed edge search mapping bin i to ``values[i]``; outside -> NULL."""
    expr = None
    for i in range(1, len(edges)):
        cond = x <= F.lit(float(edges[i]))
        expr = F.when(cond, F.lit(values[i - 1])) if expr is None else expr.when(cond, F.lit(values[i - 1]))
    lower_ok = (x >= F.lit(float(edges[0]))) if include_lowest else (x > F.lit(float(edges[0])))
    return F.when(x.isNotNull() & lower_ok & (x <= F.lit(float(edges[-1]))), expr)


def code_expr(x: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """0-based right-closed bin code; outside -> NULL."""
    return _search(x, edges, list(range(len(edges) - 1)), include_lowest)


def _attach(df: DataFrame, column: str, edges: list[float], out: str, labels, include_lowest: bool):
    # each output is its own edge search: plain CASE chains stay in codegen
    x = F.col(column).cast("double")
    cols = {out: code_expr(x, edges, include_lowest),
            f"{out}_lower": _search(x, edges, [float(e) for e in edges[:-1]], include_lowest),
            f"{out}_upper": _search(x, edges, [float(e) for e in edges[1:]], include_lowest)}
    if labels is not None:
        if len(labels) != len(edges) - 1:
            raise ValueError("labels must be one fewer than bin edges")
        cols[f"{out}_label"] = _search(x, edges, [str(l) for l in labels], include_lowest)
    return df.withColumns(cols)


def equal_width(df: DataFrame, column: str, bins: int = 5, labels=None, out: str | None = None) -> DataFrame:
    row = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).collect()[0]
    if row["a"] is None:
        raise ValueError(f"column {column!r} has no values to bin")
    edges = width_edges(row["a"], row["b"], int(bins))
    return _attach(df, column, edges, out or f"{column}_binned", labels, False)


def equal_freq(df: DataFrame, column: str, bins: int = 4, labels=None, out: str | None = None) -> DataFrame:
    probs = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, {column: probs})[column]
    if edges[0] is None:
        raise ValueError(f"column {column!r} has no values to bin")
    if len(set(edges)) != len(edges):
        raise ValueError(f"Bin edges must be unique: {edges}")
    return _attach(df, column, edges, out or f"{column}_binned", labels, True)


def custom(df: DataFrame, column: str, bin_edges: list[float], labels=None, out: str | None = None) -> DataFrame:
    edges = [float(e) for e in bin_edges]
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("bins must increase monotonically")
    return _attach(df, column, edges, out or f"{column}_binned", labels, False)


def bin_codes(df: DataFrame, column: str, bins: int = 5, out: str = "transformed") -> DataFrame:
    """EDA equal-width codes only (``labels=False``)."""
    return equal_width(df, column, bins, out=out).drop(f"{out}_lower", f"{out}_upper")


def binning(df: DataFrame, column: str, method: str, bins: int = 5, labels=None,
            bin_edges=None, new_feature: str | None = None) -> DataFrame:
    if method == "equal_width":
        return equal_width(df, column, bins, labels, new_feature)
    if method == "equal_freq":
        return equal_freq(df, column, bins, labels, new_feature)
    if method == "custom":
        return custom(df, column, bin_edges, labels, new_feature)
    raise ValueError(f"unknown binning method {method!r}")
