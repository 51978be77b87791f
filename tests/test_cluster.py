import numpy as np
import pytest

from kiln.operators import cluster, neighbours


def brute(x, eps, least):
    near = [np.flatnonzero(((x - p) ** 2).sum(1) <= eps * eps) for p in x]
    core = np.array([len(n) >= least for n in near])
    label = np.full(len(x), -1)
    for i in np.lexsort(x.T[::-1]):
        if core[i] and label[i] < 0:
            k = label.max() + 1
            label[i], stack = k, [i]
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = k
                        stack.append(j)
    for i in np.flatnonzero(~core):
        j = [label[k] for k in near[i] if core[k]]
        label[i] = min(j) if j else -1
    return label


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_dbscan_equals_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    rng = np.random.default_rng(dims)
    centres = rng.uniform(-6, 6, (4, dims))
    x = np.concatenate([c + rng.normal(scale=0.5, size=(60, dims)) for c in centres] + [rng.uniform(-8, 8, (30, dims)), np.zeros((20, dims))])
    x = np.round(x, 3)
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["id long", *(f"{n} double" for n in names)]))
    df = df.unionByName(spark.createDataFrame([(999, *[None] * dims)], df.schema))
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, names, 0.7, 5).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, 0.7, 5).tolist() and 999 not in got
    n = cluster.cluster_summary(cluster.dbscan(df, names, 0.7, 5)).first()
    want = brute(x, 0.7, 5)
    assert n["n_clusters"] == want.max() + 1 and n["n_noise"] == (want < 0).sum()


def test_summary_has_the_size_of_each_cluster(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0] * 5 + [1] * 3 + [-1] * 2 + [7])], "id long, cluster long")
    got = {r["cluster"]: (r["size"], r["n_clusters"], r["n_noise"]) for r in cluster.cluster_summary(df).collect()}
    assert got == {0: (5, 3, 2), 1: (3, 3, 2), 7: (1, 3, 2), -1: (2, 3, 2)}
    none = cluster.cluster_summary(df.where("id < 0")).collect()
    assert len(none) == 1 and none[0]["n_clusters"] == 0 and none[0]["size"] is None


def test_hierarchical_separates_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in cluster.hierarchical(df, ["a", "b"], 3).collect()}
    assert [len({got[i] for i in range(k, k + 40)}) for k in (0, 40, 80)] == [1, 1, 1] and len(set(got.values())) == 3


def test_kmeans_rows_are_at_their_nearest_centre(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    lab = np.array([r["cluster"] for r in cluster.kmeans(df, ["a", "b"], 4).orderBy("id").collect()])
    centres = np.array([x[lab == k].mean(0) for k in range(4)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == lab).mean() > 0.97
