"""Heavy work next to few bytes is dealt to all cores; Box-Cox rounds without a power per row and lambda."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.functions.frames import dealt_evenly
from kiln.operators import models, power


def test_small_rows_are_dealt_to_several_tasks_per_core(spark):
    cores = spark.sparkContext.defaultParallelism
    groups = dealt_evenly(spark.range(2000, numPartitions=1), "id").groupBy("id").count()
    used = groups.groupBy(F.spark_partition_id()).count().count()
    assert used > 2 * cores  # an aggregation alone puts these rows into one


def test_boxcox_round_equals_plain_likelihoods(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(size=500)) + 0.1
    data = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    lams = [-1.0, -0.3, 0.0, 0.2, 1.0, 2.5]
    n, logs, variances = power._boxcox_round(data, lams)
    want = [np.var(np.log(x) if l == 0 else (x ** l - 1) / l) for l in lams]
    assert n == 500 and math.isclose(logs, np.log(x).sum(), rel_tol=1e-12) and np.allclose(variances, want, rtol=1e-9)


def test_boxcox_of_no_finite_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        power.fit_lambda(spark.createDataFrame([(float("nan"),)], "x double"), "x", "boxcox")


def test_only_fits_that_scan_rows_often_hold_them():
    often = {name for name in models.MODELS["classification"] if models.reads_rows_often("classification", name, {})}
    assert often == {"K-Nearest Neighbors", "Random Forest", "Gradient Boosting", "SVM"}
    assert not models.reads_rows_often("classification", "SVM", {"kernel": "linear"})
    assert models.reads_rows_often("regression", "Ridge Regression", {}) and not models.reads_rows_often("regression", "Lasso Regression", {})
