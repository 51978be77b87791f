"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; the unlabelled class is web
text whose label is not looked at.  The model minimises the non-negative
unbiased risk of Kiryo et al. (2017) with the logistic loss:

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

and when the bracket turns negative, steps up its gradient instead, as
the paper does.  The class prior is the share of good ones among all
labelled training rows.  Both samples are bounded and drawn by a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import hashed
from kiln.llm.common import fold
from kiln.llm.hashed import LinearModel, Sparse, sigmoid
from kiln.llm.textcore import Words, batch_slices

BITS, CHAR_SIZES = 17, (3, 4)
POSITIVES, UNLABELLED, CALIBRATION = 2500, 4000, 2000
THRESHOLD = 0.3


def risk_parts(z: np.ndarray, pos: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * E_p[loss(+)], E_u[loss(-)] - prior * E_p[loss(-)]) of margins ``z``."""
    n_p, n_u = max(int(pos.sum()), 1), max(int((~pos).sum()), 1)
    return prior * np.logaddexp(0, -z)[pos].sum() / n_p, np.logaddexp(0, z)[~pos].sum() / n_u - prior * np.logaddexp(0, z)[pos].sum() / n_p


def risk_slope(z: np.ndarray, pos: np.ndarray, prior: float) -> np.ndarray:
    """The derivative of the risk for each margin; where the bracket is negative, that of the bracket turned round."""
    n_p, n_u = max(int(pos.sum()), 1), max(int((~pos).sum()), 1)
    up = sigmoid(z)  # derivative of the loss of calling a row negative
    if risk_parts(z, pos, prior)[1] < 0:
        return np.where(pos, prior * up / n_p, -up / n_u)
    return np.where(pos, prior * (up - 1) / n_p - prior * up / n_p, up / n_u)


def fit_pu(x: Sparse, positive: np.ndarray, prior: float, epochs: int = 12, batch: int = 256, rate: float = 0.3) -> LinearModel:
    """Non-negative risk over minibatches that hold positives and unlabelled rows in their shares."""
    model = LinearModel(BITS, CHAR_SIZES, True)

    def slope(rows: np.ndarray, z: np.ndarray) -> np.ndarray:
        return risk_slope(z, positive[rows], prior)

    model.descend(x, slope, epochs, batch, rate)
    return model


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> LinearModel:
    """Fit on rows whose fold is not ``held_out`` only.

    At most ``positives`` positives, ``unlabelled`` unlabelled texts and
    ``calibration`` labelled rows (for the final probability curve), one
    row per id; the prior is taken from all labelled rows.  With no positive row the model gives every text the estimated prior.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col, parts) != held_out)) \
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    good_rows, all_rows = known.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("_y")).first()
    prior = float((good_rows + 1) / (all_rows + 2))
    good = hashed.sample_of(known.where("_y = 1"), id_col, positives).withColumn("_role", F.lit(0))
    curve = known.orderBy(F.xxhash64(F.concat(F.col(id_col).cast("string"), F.lit("/c"))), id_col).limit(calibration).withColumn("_role", F.lit(1))
    web = hashed.sample_of(docs.select(id_col).where(fold(id_col, parts) != held_out).distinct(), id_col, unlabelled) \
        .select(id_col, F.lit(-1).alias("_y"), F.lit(2).alias("_role"))
    picked = good.unionByName(curve).unionByName(web)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    rows = hashed.one_row_each(rows, [id_col, "_role", "_y"])
    got, x = hashed.collect_features(rows, [id_col, "_role", "_y"], BITS, CHAR_SIZES, True)
    role, y = got["_role"].to_numpy(), got["_y"].to_numpy()
    seen = y[role == 1]
    if not (role == 0).any() or not (role == 2).any():
        model = LinearModel(BITS, CHAR_SIZES, True)
        model.shift = float(np.log(prior / (1 - prior)))
        return model
    use = role != 1
    model = fit_pu(x.take(use), (role == 0)[use], min(max(prior, 0.01), 0.99))
    if len(set(seen.tolist())) == 2:
        model.calibrate(model.of_rows(x.take(role == 1)), seen)
    return model


def score(docs: DataFrame, model: LinearModel, parts: int = 5, held_out: int = 0, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null text is scored as an empty one; repeated rows and null ids are
    kept (a null id's fold is null: held_out is false); other columns are
    not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches):
        for rows, texts in batch_slices(batches):
            p = shared.value.scores(Words(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, F.coalesce(fold(id_col, parts) == held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text")).mapInArrow(run, schema)
