"""Training samples stay at their bounds and hold every language; the PU gradient is that of its risk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import hashed, language, pu_quality, quality_rules


@pytest.fixture
def collected(monkeypatch):
    """The numbers of rows that reach the driver."""
    sizes, real = [], hashed.collect_features

    def seen(*a, **b):
        out = real(*a, **b)
        sizes.append(len(out[0]))
        return out

    monkeypatch.setattr(hashed, "collect_features", seen)
    return sizes


def test_a_repeated_id_stays_at_the_bound(spark, collected):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"),
                                    F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"),
                                    F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    quality_rules.train(docs, labels, sample_rows=300)
    pu_quality.train(docs, labels, positives=50, unlabelled=60, calibration=40)
    language.train(docs, held_out=-1, sample_rows=500)
    assert collected[0] == 300 and collected[1] <= 150 and 400 < collected[2] <= 500


def test_a_rare_language_is_learned(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["the", "and", "of", "in"], "bb": ["der", "und", "von", "das"], "zz": ["qqx", "zzy", "xqz", "yyq"]}
    rows = [(i, " ".join(rng.choice(words[g], 20)), g) for i, g in enumerate(["aa", "bb"] * 3000 + ["zz"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample_rows=600)
    assert "zz" in model.languages
    out = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.where("lang = 'zz'"), model).collect()}
    assert set(out.values()) == {"zz"}


@pytest.mark.parametrize("shift", [0.0, 4.0])
def test_pu_slope_is_the_derivative_of_the_risk(shift):
    rng = np.random.default_rng(1)
    pos = rng.random(40) < 0.4
    z = rng.normal(size=40) + np.where(pos, shift, -shift)
    prior = 0.5
    plain = [sum(np.log1p(np.exp(-v)) for v, p in zip(z, pos) if p) * prior / pos.sum(),
             sum(np.log1p(np.exp(v)) for v, p in zip(z, pos) if not p) / (~pos).sum() - prior * sum(np.log1p(np.exp(v)) for v, p in zip(z, pos) if p) / pos.sum()]
    assert np.allclose(pu_quality.risk_parts(z, pos, prior), plain)
    slope = pu_quality.risk_slope(z, pos, prior)

    def objective(v):
        up, bracket = pu_quality.risk_parts(v, pos, prior)
        return -bracket if plain[1] < 0 else up + bracket

    for i in range(40):
        e = np.zeros(40)
        e[i] = 1e-6
        assert abs((objective(z + e) - objective(z - e)) / 2e-6 - slope[i]) < 1e-6
    assert (plain[1] < 0) == (shift > 0)
