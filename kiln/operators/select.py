"""Feature selection.

Scores are one grouped aggregate each (per class count, mean, variance and
sum), reduced again over the classes on the cluster: the driver receives
a few numbers per feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.nulls import numeric_columns
from kiln.functions.special import f_sf


def variance_threshold(df: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, dict]:
    """Keep numeric columns whose population variance exceeds the
    threshold (text columns are not kept, as the reference's selector)."""
    cols = numeric_columns(df)
    row = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).collect()[0]
    keep = [c for i, c in enumerate(cols) if row[f"v{i}"] is not None and row[f"v{i}"] > threshold]
    return df.select(*keep), {"selected_features": keep,
                             "variances": {c: row[f"v{i}"] for i, c in enumerate(cols)}}


def correlation_filter(df: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, dict]:
    """Drop a numeric column when |r| with any earlier column exceeds the
    threshold (earlier columns count even when dropped themselves).  Text
    columns are kept (the reference raises on them)."""
    cols = numeric_columns(df)
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    if not pairs:
        return df, {"dropped_features": []}
    row = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).collect()[0]
    drop = [cols[j] for j in range(len(cols))
            if any(row[f"r{i}_{j}"] is not None and abs(row[f"r{i}_{j}"]) > threshold for i in range(j))]
    return df.drop(*drop), {"dropped_features": drop}


def class_moments(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Per class: count, mean, population variance and sum of every feature
    over its own non-missing rows (one groupBy, partially aggregated
    map-side, so a dominant class costs nothing).  Rows without a class are
    left out."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.sum(x).alias(f"s{i}")]
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(*aggs)


def f_classif_scores(df: DataFrame, target: str, features: list[str]) -> dict[str, tuple[float, float]]:
    """One-way ANOVA F (and p) of each feature across target classes, however many.

    Sums of squares come from class means and central moments, so large
    means do not cancel; the per-class rows are reduced on the cluster."""
    known = df.where(F.col(target).isNotNull())
    mean = known.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    aggs = []
    for i in range(len(features)):
        m = mean[f"m{i}"]
        d = F.col(f"m{i}") - F.lit(m)
        aggs += [F.sum(F.col(f"n{i}") * d * d).alias(f"b{i}"), F.sum(F.col(f"n{i}") * F.col(f"v{i}")).alias(f"w{i}"),
                 F.sum(f"n{i}").alias(f"n{i}"), F.count_if(F.col(f"n{i}") > 0).alias(f"k{i}")]
    r = class_moments(df, target, features).agg(*aggs).first()
    out = {}
    for i, c in enumerate(features):
        n, k, ss_b, ss_w = r[f"n{i}"] or 0, r[f"k{i}"], r[f"b{i}"], r[f"w{i}"]
        dfb, dfw = k - 1, n - k
        f = (ss_b / dfb) / (ss_w / dfw) if dfb > 0 and dfw > 0 and ss_w else float("nan")
        out[c] = (f, f_sf(f, dfb, dfw))
    return out


def chi2_scores(df: DataFrame, target: str, features: list[str]) -> dict[str, tuple[float, float]]:
    """chi2 of class-wise feature sums against class shares (features >= 0), over all classes."""
    from kiln.functions.special import chi2_sf
    tot = df.where(F.col(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"a{i}") for i, c in enumerate(features)],
        *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)]).first()
    if any(tot[f"a{i}"] is not None and tot[f"a{i}"] < 0 for i in range(len(features))):
        raise ValueError("Input X must be non-negative")
    n, aggs = tot["n"], [F.count(F.lit(1)).alias("k")]
    for i in range(len(features)):
        e = F.col("_n") / F.lit(float(n or 1)) * F.lit(float(tot[f"s{i}"] or 0.0))
        o = F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        aggs.append(F.sum(F.when(e != 0, (o - e) * (o - e) / e).otherwise(0.0)).alias(f"x{i}"))
    r = class_moments(df, target, features).agg(*aggs).first()
    return {c: (r[f"x{i}"] or 0.0, chi2_sf(r[f"x{i}"] or 0.0, r["k"] - 1)) for i, c in enumerate(features)}


def select_k_best(df: DataFrame, target: str, k: int = 5, score_func: str = "f_classif") -> tuple[DataFrame, dict]:
    """Keep the k best numeric features plus the target."""
    feats = [c for c in numeric_columns(df) if c != target]
    if score_func == "f_classif":
        scores = f_classif_scores(df, target, feats)
    elif score_func == "chi2":
        scores = chi2_scores(df, target, feats)
    elif score_func == "mutual_info":
        from kiln.operators.mutual_info import mutual_info_scores
        scores = {c: (s, None) for c, s in mutual_info_scores(df, target, feats).items()}
    else:
        raise ValueError(f"unknown score function {score_func!r}")
    ranked = sorted(feats, key=lambda c: (-_nan_low(scores[c][0]), feats.index(c)))
    keep = [c for c in feats if c in set(ranked[:k])]
    return df.select(*keep, target), {"selected_features": keep,
                                      "scores": {c: scores[c][0] for c in feats}}


def _nan_low(v):
    return float("-inf") if v is None or v != v else v


def scores_frame(df: DataFrame, scores: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([(c, float(s)) for c, s in scores.items()], "feature string, score double")


def feature_selection(df: DataFrame, op: dict) -> tuple[DataFrame, dict]:
    m = op["method"]
    if m == "variance":
        return variance_threshold(df, op.get("threshold", 0.0))
    if m == "correlation":
        return correlation_filter(df, op.get("threshold", 0.8))
    if not op.get("target"):
        raise ValueError("Target column required")
    if m == "kbest":
        return select_k_best(df, op["target"], op.get("k", 5), op.get("score_func", "f_classif"))
    if m == "rfe":
        from kiln.operators.models import rfe
        return rfe(df, op["target"], op.get("k", 5))
    raise ValueError(f"unknown feature selection method {m!r}")
