"""Q1: run an ordered list of operation specs over one table.

Two spec shapes are accepted, as in the reference's services:
cleaning ops ``{"type": ..., "params": {...}}`` and feature ops with flat
keys ``{"type": ..., "method"/"strategy"/"operation": ..., ...}``.
Specs are validated up front (an unknown type or method raises before any
Spark job runs), consecutive independent fits are fused into one pass,
and each op's side result (selected features, scores, explained
variance) is collected per position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from kiln.functions import text as tx
from kiln.operators import bins, clean, dedup, encode, outliers, profile, scale
from kiln.operators.base import Step, run_steps


class SpecError(ValueError):
    def __init__(self, position: int, spec: dict, msg: str):
        super().__init__(f"op #{position} {spec!r}: {msg}")
        self.position, self.spec = position, spec


@dataclass
class Result:
    df: DataFrame
    metrics: list[dict] = field(default_factory=list)


_CLEAN_METHODS = {
    "drop_na": None,
    "impute": {"mean", "median", "mode", "knn", "mice"},
    "outlier": {"zscore", "iqr", "isolation_forest"},
    "normalize": {"minmax", "zscore"},
    "binning": {"equal_width", "equal_freq", "custom"},
    "text_clean": {"lowercase", "remove_punct", "remove_stopwords", "correct_spelling"},
    "deduplicate": {"exact", "fuzzy"},
    "type_conversion": {"numeric", "datetime", "category", "string"},
}

_FEATURE_METHODS = {
    "missing": ("strategy", {"mean", "median", "mode", "constant", "knn", "drop", "flag"}),
    "encoding": ("method", {"onehot", "label", "target", "frequency", "binary"}),
    "scaling": ("method", {"standard", "minmax", "robust"}),
    "transformation": ("method", {"log", "sqrt", "boxcox", "yeojohnson"}),
    "feature_selection": ("method", {"variance", "correlation", "kbest", "rfe"}),
    "outliers": ("method", {"clip", "remove", "transform"}),
    "dimensionality": ("method", {"pca"}),
    "feature_creation": ("operation", {"interaction", "polynomial", "aggregation", "datetime"}),
}


def validate(ops: list[dict]) -> None:
    for i, op in enumerate(ops):
        t = op.get("type")
        if "params" in op:
            p = op["params"]
            if t in ("delete_columns", "regex_extract"):
                continue
            if t not in _CLEAN_METHODS:
                raise SpecError(i, op, f"unknown op type {t!r}")
            allowed = _CLEAN_METHODS[t]
            key = "type" if t == "type_conversion" else ("action" if t == "text_clean" else "method")
            if allowed is not None and p.get(key) not in allowed:
                raise SpecError(i, op, f"unknown {key} {p.get(key)!r}")
        elif t == "binning":
            if op.get("method") not in _CLEAN_METHODS["binning"]:
                raise SpecError(i, op, f"unknown method {op.get('method')!r}")
        elif t in _FEATURE_METHODS:
            key, allowed = _FEATURE_METHODS[t]
            if op.get(key) not in allowed:
                raise SpecError(i, op, f"unknown {key} {op.get(key)!r}")
        else:
            raise SpecError(i, op, f"unknown op type {t!r}")


def _clean_op(df: DataFrame, op: dict, order_by) -> tuple[DataFrame, dict]:
    t, p = op["type"], op.get("params", {})
    if t == "delete_columns":
        return clean.delete_columns(df, p["columns"]), {}
    if t == "drop_na":
        return clean.drop_na(df, p["method"], p.get("threshold")), {}
    if t == "impute":
        if p.get("on") and p["method"] == "knn":
            return clean.impute_knn(df, p["column"], p["on"], p.get("neighbors", 5)), {}
        if p.get("on") and p["method"] == "mice":
            return clean.impute_iterative(df, [p["column"], *p["on"]], p.get("max_iter", 10)), {}
        return clean.impute(df, p["column"], p["method"]), {}
    if t == "outlier":
        return outliers.outlier(df, p["column"], p["method"], p.get("action", "remove"),
                                p.get("threshold", 3.0), p.get("factor", 1.5), p.get("contamination", 0.1)), {}
    if t == "normalize":
        return scale.scale(df, [p["column"]], "minmax" if p["method"] == "minmax" else "standard"), {}
    if t == "binning":
        return bins.binning(df, p["column"], p["method"], p.get("bins", 5), p.get("labels"), p.get("bin_edges")), {}
    if t == "text_clean":
        return tx.text_clean(df, p["column"], p["action"]), {}
    if t == "deduplicate":
        return dedup.deduplicate(df, p["method"], p.get("columns"), p.get("column"), p.get("threshold", 80),
                                 p.get("order_by", order_by)), {}
    if t == "type_conversion":
        return tx.type_conversion(df, p["column"], p["type"]), {}
    if t == "regex_extract":
        return tx.extract(df, p["column"], p["pattern"], p.get("new_column")), {}
    raise ValueError(t)


def _feature_op(df: DataFrame, op: dict) -> tuple[DataFrame, dict]:
    t = op["type"]
    if t == "missing":
        return clean.impute_columns(df, op["columns"], op["strategy"], op.get("value", 0)), {}
    if t == "encoding":
        return encode.encode(df, op["columns"], op["method"], op.get("target"), op.get("drop", "first")), {}
    if t == "scaling":
        return scale.scale(df, op["columns"], op["method"], op.get("range", (0, 1))), {}
    if t == "transformation":
        return scale.transform(df, op["columns"], op["method"]), {}
    if t == "outliers":
        return outliers.outliers(df, op["columns"], op["method"], op.get("lower"), op.get("upper")), {}
    if t == "feature_selection":
        from kiln.operators import select
        return select.feature_selection(df, op)
    if t == "dimensionality":
        from kiln.operators import reduce
        return reduce.pca_feature(df, op.get("n_components", 2), op.get("target"))
    if t == "feature_creation":
        o = op["operation"]
        if o == "interaction":
            c1, c2 = op["columns"]
            return scale.interaction(df, c1, c2, op["new_feature"]), {}
        if o == "polynomial":
            return scale.polynomial(df, op["column"], op.get("degree", 2), op["new_feature"]), {}
        if o == "aggregation":
            return profile.aggregation_feature(df, op["group_column"], op["aggregation_column"],
                                               op["aggregation_function"], op["new_feature"]), {}
        return tx.datetime_part(df, op["column"], op["part"], op["new_feature"]), {}
    if t == "binning":
        return bins.binning(df, op["column"], op["method"], op.get("bins", 5), op.get("labels"),
                            op.get("bin_edges"), op.get("new_feature")), {}
    raise ValueError(t)


def _as_step(op: dict) -> Step | None:
    """Ops whose fit is a plain aggregate become fusable steps."""
    if "params" not in op:
        return None
    t, p = op.get("type"), op["params"]
    if t == "impute" and p.get("method") in ("mean", "median", "mode", "knn", "mice") and not p.get("on"):
        return clean.Impute(p["column"], p["method"])
    if t == "normalize":
        return scale.Scale(p["column"], "minmax" if p["method"] == "minmax" else "standard")
    if t == "outlier" and p.get("method") == "zscore":
        return outliers.ZScoreOutlier(p["column"], p.get("action", "remove"), p.get("threshold", 3.0))
    if t == "outlier" and p.get("method") == "iqr":
        return outliers.IQROutlier(p["column"], p.get("action", "remove"), p.get("factor", 1.5))
    return None


def run_pipeline(df: DataFrame, ops: list[dict], order_by: list[str] | None = None) -> Result:
    """Validate, then fold the ops over ``df``; fits of consecutive
    independent aggregate-fit ops share one pass."""
    validate(ops)
    metrics: list[dict] = []
    i = 0
    while i < len(ops):
        step = _as_step(ops[i])
        if step is not None:
            group = [step]
            j = i + 1
            while j < len(ops) and (nxt := _as_step(ops[j])) is not None:
                group.append(nxt)
                j += 1
            try:
                df = run_steps(df, group)
            except Exception as e:  # report with the failing spec
                raise SpecError(i, ops[i], str(e)) from e
            metrics += [{"position": k, "type": ops[k]["type"]} for k in range(i, j)]
            i = j
            continue
        op = ops[i]
        try:
            if "params" in op:
                df, m = _clean_op(df, op, order_by)
            else:
                df, m = _feature_op(df, op)
        except SpecError:
            raise
        except Exception as e:
            raise SpecError(i, op, str(e)) from e
        metrics.append({"position": i, "type": op["type"], **m})
        i += 1
    return Result(df, metrics)
