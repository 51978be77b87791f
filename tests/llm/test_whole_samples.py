"""Training samples reach the driver whole."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kiln.llm import hashed, language, pu_quality, quality_rules
from kiln.llm.textcore import Words, string_array


def test_sample_bounds_and_byte_grams():
    assert pu_quality.CHAR_SIZES == quality_rules.CHAR_SIZES == language.CHAR_SIZES == (3, 4)
    assert (pu_quality.POSITIVES, pu_quality.UNLABELLED, pu_quality.CALIBRATION) == (2500, 4000, 2000)
    assert quality_rules.SAMPLE_ROWS == 6000 and language.SAMPLE_ROWS == 4000


def test_collected_features_equal_local_ones(documents):
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got, x = hashed.collect_features(rows, ["doc_id"], 17, (3, 4), True)
    want = sorted((r[0], r[1]) for r in rows.collect())
    assert got["doc_id"].tolist() == [i for i, _ in want]
    words = Words(string_array(pa.array([t for _, t in want])))
    assert np.array_equal(x.shape, hashed.shape(words))
    for k, (idx, val) in enumerate(hashed.sparse_rows(words, 17, (3, 4), True)):
        _, i, s = x.rows(np.array([k]))
        assert np.array_equal(i, idx) and np.array_equal(s, val)


def test_prior_is_the_share_of_all_training_labels(spark, monkeypatch):
    from kiln.llm.common import fold
    docs = spark.createDataFrame([(i, f"text number {i} of some words") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("quality"))
    seen = labels.where(fold("doc_id", 5) != 0).agg(F.sum("quality"), F.count("quality")).first()
    monkeypatch.setattr(pu_quality, "CALIBRATION", 3)
    priors, fit = [], pu_quality.fit_pu
    monkeypatch.setattr(pu_quality, "fit_pu", lambda x, positive, prior: priors.append(prior) or fit(x, positive, prior, epochs=1))
    pu_quality.train(docs, labels)
    assert np.isclose(priors[0], (seen[0] + 1) / (seen[1] + 2))
