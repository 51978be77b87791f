"""Dimensionality reduction (N7-N8): PCA on centred, unscaled columns.

Spark's ``PCA.transform`` does not centre, so the mean is subtracted
first (one aggregate).  Component signs are fixed so that the largest
absolute loading of each component is positive.  The covariance is a
distributed d x d aggregate; only d x d numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.nulls import numeric_columns


def pca(df: DataFrame, columns: list[str], n_components: int = 2, prefix: str = "PC",
        keep: list[str] | None = None) -> tuple[DataFrame, dict]:
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).collect()[0]
    centred = df.select(*(keep or []), *[(F.col(c).cast("double") - F.lit(means[c])).alias(c) for c in columns])
    vec = VectorAssembler(inputCols=columns, outputCol="_v").transform(centred)
    model = PCA(k=n_components, inputCol="_v", outputCol="_pc").fit(vec)
    comps = model.pc.toArray()                     # d x k
    flip = np.sign(comps[np.abs(comps).argmax(axis=0), range(comps.shape[1])])
    flip[flip == 0] = 1
    proj = model.transform(vec).select(*(keep or []), vector_to_array("_pc").alias("_a"))
    names = [f"{prefix}{i + 1}" for i in range(n_components)]
    out = proj.select(*(keep or []), *[(F.col("_a")[i] * F.lit(float(flip[i]))).alias(n) for i, n in enumerate(names)])
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    return out, {"explained_variance": dict(zip(names, ratio)),
                 "components": (comps * flip).tolist()}


def pca_feature(df: DataFrame, n_components: int = 2, target: str | None = None) -> tuple[DataFrame, dict]:
    """PCA of all numeric columns except the target; other columns are
    dropped, the target is kept."""
    cols = [c for c in numeric_columns(df) if c != target]
    data = df.na.drop(subset=cols)
    return pca(data, cols, n_components, "PC", [target] if target else None)


def pca_explore(df: DataFrame, columns: list[str], n_components: int = 2) -> tuple[DataFrame, dict]:
    """PCA of the listed numeric columns over complete rows, named
    ``Component i``."""
    cols = [c for c in columns if c in numeric_columns(df)]
    data = df.select(*cols).na.drop()
    return pca(data, cols, n_components, "Component ")
