import math
import random

from kiln.operators.clean import impute_knn


def test_impute_knn_with_missing_coordinates(spark):
    rnd = random.Random(4)
    rows = [(i, *(None if rnd.random() < 0.25 else rnd.random() * 10 for _ in range(3))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v double, a double, b double")
    got = {r["id"]: r["v"] for r in impute_knn(df, "v", ["a", "b"], 3, ["id"]).collect()}
    donors = [r for r in rows if r[1] is not None]
    mean = sum(r[1] for r in donors) / len(donors)
    assert any(r[1] is None and (r[2] is None) != (r[3] is None) for r in rows)
    for i, v, *x in rows:
        if v is None:
            near = []
            for j, w, *y in donors:
                both = [(p - q) ** 2 for p, q in zip(x, y) if p is not None and q is not None]
                if both:
                    near.append((math.sqrt(sum(both) * 2 / len(both)), j, w))
            best = sorted(near)[:3]
            v = sum(w for *_, w in best) / len(best) if best else mean
        assert math.isclose(got[i], v), i
