import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from kiln.operators import models, neighbours, reduce
from kiln.operators.cluster import ward_merge


def test_split_size_and_stability(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    tr, te = models.train_test_split(df, ["k"], 0.2)
    assert te.count() == 200 and tr.count() == 800
    tr2, te2 = models.train_test_split(df.repartition(7), ["k"], 0.2)
    assert sorted(r[0] for r in te.collect()) == sorted(r[0] for r in te2.collect())


def test_ridge_mapping_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    alpha = 10.0
    est = models._estimator("regression", "Ridge Regression", 200, float(np.std(y)), {"alpha": alpha})
    m = est.fit(vec)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-6)


def test_pca_centres_and_fixes_sign(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]]) + 50
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    out, m = reduce.pca(df, ["a", "b", "c"], 2)
    xc = x - x.mean(0)
    evals, evecs = np.linalg.eigh(np.cov(xc.T))
    ratio = evals[::-1][:2] / evals.sum()
    assert np.allclose(list(m["explained_variance"].values()), ratio)
    pc = out.toPandas().to_numpy()
    assert abs(pc[:, 0].mean()) < 1e-9


def test_ward_merge_small():
    counts = np.ones(4)
    means = np.array([[0.0], [0.1], [5.0], [5.2]])
    assert ward_merge(counts, means, 2).tolist() == [0, 0, 1, 1]


def test_classification_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    m = models.classification_metrics(df)
    assert m["accuracy"] == 0.5
    f1 = {"a": 2 / 3, "b": 2 / 3 * 2 * 1 / (2 / 3 + 1) * 0 + 0.8 * 0 + 2 * 1 / 4, "c": 0.0}
    assert abs(m["f1_weighted"] - (2 * f1["a"] + 1 * 0.5 + 0) / 4) < 1e-12


def test_xlsx_roundtrip(spark, tmp_path):
    from kiln.sources.xlsx import parse_first_sheet, read_xlsx, write_xlsx
    df = spark.createDataFrame([(1, "a&b", 2.5), (2, None, None), (3, "x", -1.0)], "id long, s string, v double")
    write_xlsx(df.repartition(2), str(tmp_path / "wb"))
    back = read_xlsx(spark, str(tmp_path / "wb"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    del parse_first_sheet


def test_chained_imputation_recovers_linear_relation(spark):
    from kiln.operators.clean import impute_iterative
    rows = [(float(i), 2.0 * i + 1.0 if i % 5 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "a double, b double")
    out = {r["a"]: r["b"] for r in impute_iterative(df, ["a", "b"]).collect()}
    assert abs(out[10.0] - 21.0) < 1e-6


def test_svr_close_to_least_squares_for_large_c(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = x @ np.array([2.0, -1.0]) + 0.5 + rng.normal(scale=0.01, size=300)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df)
    m = models.fit_svr(vec, "f", "y", c=100.0, epsilon=0.0)
    import json
    spec = json.loads(m.getOrDefault(m.spec))
    assert np.allclose(spec["w"], [2.0, -1.0], atol=1e-2) and abs(spec["b"] - 0.5) < 1e-2


def test_power_lambda_matches_grid_mle(spark):
    from kiln.operators.power import fit_lambda
    rng = np.random.default_rng(1)
    x = rng.lognormal(0.0, 0.5, 400)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = fit_lambda(df, "x", "boxcox")
    grid = np.linspace(-2, 2, 40001)
    llf = [(l - 1) * np.log(x).sum() - len(x) / 2 * np.log(np.var(np.log(x) if abs(l) < 1e-12 else (x ** l - 1) / l))
           for l in grid]
    assert abs(lam - grid[int(np.argmax(llf))]) < 2e-4


def test_isolation_forest_ranks_planted_outliers(spark):
    from kiln.operators.iforest import isolation_scores
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), [15.0, -12.0, 20.0]])
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(x)], "id long, x double")
    scored, thr = isolation_scores(df, ["x"], contamination=0.01, trees=50)
    top = [r["id"] for r in scored.orderBy("anomaly_score", ascending=False).limit(3).collect()]
    assert sorted(top) == [500, 501, 502]


def _knn_frames(spark, X, y, Q):
    tr = spark.createDataFrame([(i, list(map(float, x)), float(v)) for i, (x, v) in enumerate(zip(X, y))],
                               "tid long, x array<double>, label double")
    return tr, spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(Q)], "qid long, x array<double>")


@pytest.mark.parametrize("block", [40, 4096])
def test_knn_exact_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    rng = np.random.default_rng(0)
    X = rng.normal(size=(800, 3))
    X[:250] = 0.5  # a hot cell of equal points: ties go to the smaller id
    y = rng.normal(size=800)
    Q = np.concatenate([rng.normal(size=(60, 3)), np.full((20, 3), 0.5), rng.normal(size=(5, 3)) * 50])
    tr, qq = _knn_frames(spark, X, y, Q)
    got = {r["qid"]: r["prediction"] for r in neighbours.knn_predict(tr, qq, 5, "uniform", False).collect()}
    for i, q in enumerate(Q):
        d = ((X - q) ** 2).sum(1)
        assert abs(got[i] - y[np.lexsort((np.arange(len(X)), d))[:5]].mean()) < 1e-9


def test_knn_small_and_empty(spark):
    tr, qq = _knn_frames(spark, np.array([[0.0], [1.0], [5.0]]), [1, 2, 3], np.array([[0.2]]))
    assert neighbours.knn_predict(tr, qq, 5, "uniform", False).first()["prediction"] == 2.0
    assert abs(neighbours.knn_predict(tr, qq, 2, "distance", False).first()["prediction"] - (1 / 0.2 + 2 / 0.8) / (1 / 0.2 + 1 / 0.8)) < 1e-12
    assert neighbours.knn_predict(tr.limit(0), qq, 2).collect() == [] and neighbours.knn_predict(tr, qq.limit(0), 2).collect() == []


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=300), rng.normal(size=300)
    c = [["u", "v", "w"][i % 3] for i in range(300)]
    y = 2 * a - b + np.array([{"u": 0, "v": 1, "w": -1}[x] for x in c])
    k = ["lo" if v < -1 else "hi" if v > 1 else "mid" for v in y]
    data = [(i, None if i % 17 == 0 else float(p), float(q), s, float(t + 0.05 * e), None if i % 50 == 0 else z, 10 * (["lo", "mid", "hi"].index(z) + 1))
            for i, (p, q, s, t, e, z) in enumerate(zip(a, b, c, y, rng.normal(size=300), k))]
    return spark.createDataFrame(data, "id long, a double, b double, c string, y double, k string, n int").cache()


CASES = [("classification", m, p) for m, p in [
    ("Random Forest", {"n_estimators": 20}), ("Logistic Regression", {}), ("Gradient Boosting", {"n_estimators": 10, "learning_rate": 0.5}),
    ("SVM", {"kernel": "linear"}), ("SVM", {"kernel": "rbf"}), ("K-Nearest Neighbors", {})]] + [("regression", m, p) for m, p in [
        ("Random Forest", {"n_estimators": 20}), ("Linear Regression", {}), ("Ridge Regression", {}), ("Lasso Regression", {"alpha": 0.1}),
        ("Gradient Boosting", {"n_estimators": 20}), ("SVM", {"kernel": "linear"}), ("SVM", {"kernel": "rbf"}), ("K-Nearest Neighbors", {"weights": "distance"})]]


@pytest.mark.parametrize("kind,name,params", CASES)
def test_saved_model_scores_rows_without_target(spark, rows, tmp_path, kind, name, params):
    target = "k" if kind == "classification" else "y"
    tr = models.train(rows, target, ["a", "b", "c"], name, kind, ["id"], params=params)
    assert tr.metrics["accuracy"] > 0.8 if kind == "classification" else tr.metrics["r2"] > 0.7
    models.save_model(tr, str(tmp_path / "m"))
    blank = rows.drop("y", "k", "n")
    out = models.score(models.load_model(str(tmp_path / "m")), blank)
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 300
    if kind == "classification":
        assert out.columns == [*blank.columns, "prediction", "predicted_class"]
        assert {r["predicted_class"] for r in got.values()} <= {"hi", "lo", "mid"}
    test = {r["id"]: r["prediction"] for r in tr.predictions.collect()}
    assert all(abs(got[i]["prediction"] - p) < 1e-9 for i, p in test.items())


def test_no_phantom_class(rows):
    tr = models.train(rows, "k", ["a", "b"], "Logistic Regression", "classification", ["id"])
    assert tr.classes == ["hi", "lo", "mid"] and tr.model.stages[-2].numClasses == 3
    tr = models.train(rows, "n", ["a", "b"], "Logistic Regression", "classification", ["id"])
    assert tr.classes == ["10", "20", "30"]
    assert {r["predicted_class"] for r in models.score(tr.model, rows.drop("n")).collect()} <= {"10", "20", "30"}


def test_folds_are_stratified(rows):
    dealt = models.with_folds(models.with_label(rows, "k", ["hi", "lo", "mid"]), ["id"], 5, True)
    for r in dealt.groupBy("label").pivot("fold").count().collect():
        sizes = [r[str(f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert dealt.count() == rows.where("k IS NOT NULL").count()


def test_grid_search_equals_numpy(rows):
    tr = models.train(rows, "y", ["a", "b"], "Ridge Regression", "regression", ["id"], use_grid_search=True)
    part, _ = models.train_test_split(models.with_label(rows, "y", None), ["id"])
    pdf = models.with_folds(part, ["id"], 5, False).toPandas()
    want = []
    for alpha in (0.1, 1, 10):
        scores = []
        for f in range(5):
            tra, val = pdf[pdf.fold != f], pdf[pdf.fold == f]
            mean = tra[["a", "b"]].mean()
            x, v = tra[["a", "b"]].fillna(mean), val[["a", "b"]].fillna(mean)
            mu, sd = x.mean(), x.std()
            x, v = ((x - mu) / sd).to_numpy(), ((v - mu) / sd).to_numpy()
            w = np.linalg.solve(x.T @ x + alpha * np.eye(2), x.T @ (tra.y - tra.y.mean()).to_numpy())
            r = val.y.to_numpy() - (v @ w + tra.y.mean())
            scores.append(1 - (r ** 2).sum() / ((val.y - val.y.mean()) ** 2).sum())
        want.append(np.mean(scores))
    assert [g["alpha"] for g, _ in tr.grid] == [0.1, 1, 10]
    assert np.allclose([s for _, s in tr.grid], want, atol=1e-6)
    assert tr.best_params["alpha"] == (0.1, 1, 10)[int(np.argmax(want))]


@pytest.mark.parametrize("kind,name,cut", [
    ("classification", "K-Nearest Neighbors", {}), ("classification", "SVM", {"C": [1], "kernel": ["linear", "rbf"]}),
    ("classification", "Gradient Boosting", {"n_estimators": [3], "learning_rate": [0.1], "max_depth": [2, 3]}),
    ("classification", "Random Forest", {"n_estimators": [5], "max_depth": [None, 3], "min_samples_split": [2]}),
    ("regression", "SVM", {"C": [1], "kernel": ["linear", "rbf"]})])
def test_grid_covers_every_model(rows, monkeypatch, kind, name, cut):
    monkeypatch.setitem(models.MODELS[kind], name, {**models.MODELS[kind][name], **cut})
    tr = models.train(rows, "k" if kind == "classification" else "y", ["a", "b"], name, kind, ["id"], use_grid_search=True)
    assert len(tr.grid) == len(models.settings(kind, name)) > 1
    assert max(s for _, s in tr.grid) == dict((tuple(g.items()), s) for g, s in tr.grid)[
        tuple((k, tr.best_params[k]) for k in models.MODELS[kind][name])]


def test_svr_reaches_the_linear_loss_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 1))
    y = 1.5 * x[:, 0] + 0.3 + rng.standard_t(2, size=120)
    vec = VectorAssembler(inputCols=["a"], outputCol="f").transform(
        spark.createDataFrame([(float(p), float(t)) for p, t in zip(x[:, 0], y)], "a double, y double"))
    import json
    m = models.fit_svr(vec, "f", "y", c=1.0, epsilon=0.1)
    spec = json.loads(m.getOrDefault(m.spec))

    def loss(w, b):
        return 0.5 * w * w + np.maximum(np.abs(y - w * x[:, 0] - b) - 0.1, 0).sum()

    best = min(loss(w, b) for w in np.linspace(0.5, 2.5, 201) for b in np.linspace(-1, 1.5, 251))
    assert loss(spec["w"][0], spec["b"]) <= best * 1.001


def test_logistic_grid_fits_distinct_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, size=(600, 2)).astype(float)
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(size=600) > 0, "b", "a")
    df = spark.createDataFrame([(i, float(a), float(b), t) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, t string")
    seen, fit = [], models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda data, *a: seen.append(data.count()) or fit(data, *a))
    got = models.train(df, "t", ["a", "b"], "Logistic Regression", "classification", ["id"], use_grid_search=True)
    assert len(seen) == 5 * 3 + 1 and max(seen) <= 32  # 16 places, two classes
    monkeypatch.setattr(models, "counted", lambda data: data)
    plain = models.train(df, "t", ["a", "b"], "Logistic Regression", "classification", ["id"], use_grid_search=True)
    assert got.best_params == plain.best_params and got.metrics["n"] == 120
    assert np.allclose([v for _, v in got.grid], [v for _, v in plain.grid], atol=0.01)
    a, b = (next(s for s in t.model.stages if hasattr(s, "coefficientMatrix")).coefficientMatrix.toArray() for t in (got, plain))
    assert np.allclose(a, b, rtol=1e-2, atol=1e-3)
