"""Row cleaning, projections and missing-value imputation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.nulls import numeric_columns
from kiln.functions.stats import Fit
from kiln.operators.base import Step, check_columns, run_steps


# ---------------------------------------------------------------- C1-C7, S4

def delete_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; an unknown name is an error (Spark's drop ignores it)."""
    check_columns(df, columns)
    return df.drop(*columns)


def drop_na(df: DataFrame, method: str = "any", threshold: int | None = None) -> DataFrame:
    """``all``: drop rows missing everywhere; ``any``: drop rows missing
    anywhere; anything else: keep rows with >= ``threshold`` present values."""
    if method == "all":
        return df.na.drop(how="all")
    if method == "any":
        return df.na.drop(how="any")
    if threshold is None:
        raise ValueError("drop_na needs a threshold unless method is 'all' or 'any'")
    return df.na.drop(thresh=int(threshold))


def drop_missing_in(df: DataFrame, columns: list[str]) -> DataFrame:
    """Feature-service ``missing(strategy=drop)``: rows missing in a listed column go."""
    check_columns(df, columns)
    return df.na.drop(how="any", subset=list(columns))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def pairwise_valid(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull())


def tidy_on_load(df: DataFrame) -> DataFrame:
    """Drop all-missing rows and index columns a CSV writer left behind."""
    unnamed = [c for c in df.columns if c.startswith("Unnamed")]
    return df.na.drop(how="all").drop(*unnamed)


# ---------------------------------------------------------------- I1-I8

_FILL = {"mean": "avg", "knn": "avg", "mice": "avg", "median": "median"}


@dataclass
class Impute(Step):
    """Fill missing values of one column.

    ``knn`` and ``mice`` called on a single column have no other coordinate
    to use: the nearest-neighbour mean and the chained-equation initial fill
    are both the column mean.  A pipeline op with ``on: [...]`` runs
    ``impute_knn`` or ``impute_iterative`` over those columns instead.
    """

    column: str
    method: str = "mean"
    value: object = 0
    flag: bool = False

    def reads(self):
        return {self.column}

    def writes(self):
        return {self.column} | ({f"{self.column}_missing"} if self.flag else set())

    def request(self, fit: Fit) -> None:
        m = self.method
        if m in ("mean", "knn", "mice"):
            self._key = fit.need("avg", self.column)
        elif m in ("median", "flag"):
            self._key = fit.need("quantile", self.column, 0.5)
        elif m == "mode":
            self._key = fit.need("mode", self.column)
        elif m == "constant":
            self._key = None
        else:
            raise ValueError(f"unknown imputation method {m!r}")

    def apply(self, df: DataFrame, stats: dict) -> DataFrame:
        c = F.col(self.column)
        fill = F.lit(self.value) if self._key is None else F.lit(stats[self._key])
        out = {}
        if self.flag or self.method == "flag":
            out[f"{self.column}_missing"] = c.isNull().cast("int")
        out[self.column] = F.coalesce(c, fill) if fill is not None else c
        return df.withColumns(out)


def impute(df: DataFrame, column: str, method: str = "mean", value=0) -> DataFrame:
    return run_steps(df, [Impute(column, method, value)])


def impute_columns(df: DataFrame, columns: list[str], strategy: str, value=0) -> DataFrame:
    """Feature-service ``missing``: one strategy over several columns, fused."""
    if strategy == "drop":
        return drop_missing_in(df, columns)
    if strategy == "flag":
        return run_steps(df, [Impute(c, "median", flag=True) for c in columns])
    return run_steps(df, [Impute(c, strategy, value) for c in columns])


MAX_PATTERNS = 4096  # combinations of missing columns whose co-moments the driver holds


def bayesian_ridge(xx, xy, yy: float, n: int, rounds: int = 300, tol: float = 1e-3):
    """Coefficients of Bayesian ridge regression from centred co-moments: the precisions of noise and coefficients are raised to
    the evidence (MacKay, 1992) under gamma priors of 1e-6, until the coefficients change by less than ``tol`` in sum."""
    import numpy as np
    prior = 1e-6
    eigen, v = np.linalg.eigh(xx)
    eigen = np.maximum(eigen, 0.0)
    turned = v.T @ xy
    noise, width = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    old = None

    def solve():
        return v @ (turned / (eigen + width / noise))

    for _ in range(rounds):
        beta = solve()
        rss = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 0.0)
        used = float((noise * eigen / (width + noise * eigen)).sum())
        width = (used + 2 * prior) / (float(beta @ beta) + 2 * prior)
        noise = (n - used + 2 * prior) / (rss + 2 * prior)
        if old is not None and np.abs(beta - old).sum() < tol:
            break
        old = beta
    return solve()


def impute_iterative(df: DataFrame, columns: list[str], max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """I7 over several columns: chained equations with Bayesian ridge.

    Missing cells start at the column mean; a round takes the incomplete
    columns, fewest missing first, regresses each on the others over the
    rows that have it and refills its missing cells.  It stops after
    ``max_iter`` rounds, or when no row's cells change by more than ``tol``
    times the largest absolute value in sum.

    All imputed cells of rows that miss the same columns are one affine
    function of the cells they have.  So the co-moments of each such
    pattern, summed in one pass, are all that the regressions need: rounds
    work on small matrices, only the stopping rule looks at the incomplete
    rows again, and the table is filled by one projection at the end.
    Columns without any value stay empty.  With more than
    ``MAX_PATTERNS`` patterns, which the driver would not hold, the rows
    themselves are filled in each round, to the same result.
    """
    import numpy as np

    from kiln.functions.frames import lookup
    from kiln.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    first = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.max(F.abs(F.col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(columns)],
                   *[F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    places = [i for i in range(len(columns)) if first[f"m{i}"] is not None]
    cols, mean = [columns[i] for i in places], [first[f"m{i}"] for i in places]
    missing, d = [first[f"n{i}"] for i in places], len(places)
    if not any(missing):
        return df.withColumns({c: F.col(c).cast("double") for c in columns})
    scale = max(first[f"x{i}"] for i in places)
    centred = [F.col(c).cast("double") - F.lit(m) for c, m in zip(cols, mean)]
    pattern = sum((F.when(F.col(c).isNull(), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols)), F.lit(0).cast("long"))
    base = df.select(pattern.alias("p"), *[x.alias(f"c{i}") for i, x in enumerate(centred)])
    if base.select("p").distinct().limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        return _impute_by_rounds(df, columns, cols, mean, sorted((i for i in range(d) if missing[i]), key=lambda i: missing[i]), tol * scale, max_iter)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = base.groupBy("p").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"s{i}") for i in range(d)],
                                 *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"q{i}_{j}") for i, j in pairs]).collect()
    moments, filled = {}, {}
    for r in sums:
        m = np.zeros((d + 1, d + 1))
        m[0, 0] = r["n"]
        for i in range(d):
            m[0, i + 1] = m[i + 1, 0] = r[f"s{i}"] or 0.0
        for i, j in pairs:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"q{i}_{j}"] or 0.0
        moments[r["p"]] = m
        a = np.eye(d + 1)  # the row's cells, after a leading 1, from the cells it has; a missing one starts at the mean, 0
        for i in range(d):
            if r["p"] >> i & 1:
                a[i + 1, i + 1] = 0.0
        filled[r["p"]] = a
    order = sorted((i for i in range(d) if missing[i]), key=lambda i: missing[i])
    had = [F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(d)]
    partial = base.where("p > 0").select("p", F.array(F.lit(1.0), *had).alias("x")).checkpoint(eager=True)

    def by_pattern(tables: dict):
        rows = [(p, [[float(v) for v in a[i + 1]] for i in range(d) if p >> i & 1]) for p, a in tables.items() if p]
        return spark.createDataFrame(rows, "p long, a array<array<double>>")

    def times(a, x):
        return F.aggregate(F.zip_with(a, x, lambda u, w: u * w), F.lit(0.0), lambda s, v: s + v)

    for _ in range(max_iter):
        before = {p: a.copy() for p, a in filled.items()}
        for c in order:
            others = [i + 1 for i in range(d) if i != c]
            total = sum(a @ moments[p] @ a.T for p, a in filled.items() if not p >> c & 1)
            n, middle = total[0, 0], total[0] / total[0, 0]
            spread = total - n * np.outer(middle, middle)
            beta = bayesian_ridge(spread[np.ix_(others, others)], spread[others, c + 1], float(spread[c + 1, c + 1]), n) if others else np.zeros(0)
            for p, a in filled.items():
                if p >> c & 1:
                    a[c + 1] = beta @ a[others]
                    a[c + 1, 0] += middle[c + 1] - beta @ middle[others]
        step = by_pattern({p: filled[p] - before[p] for p in filled})
        moved = F.aggregate(F.transform("a", lambda r: F.abs(times(r, F.col("x")))), F.lit(0.0), lambda s, v: s + v)
        change = partial.join(F.broadcast(step), "p").agg(F.max(moved)).first()[0] or 0.0  # at most MAX_PATTERNS rows
        if change < tol * scale:
            break
    named = by_pattern(filled).select(F.col("p").alias("_missing"), F.col("a").alias("_fill"))
    out = lookup(df.withColumn("_missing", pattern), named, ["_missing"])
    row = F.array(F.lit(1.0), *[F.coalesce(x, F.lit(0.0)) for x in centred])
    below = [F.bit_count(F.col("_missing").bitwiseAND(F.lit((1 << i) - 1))) for i in range(d)]
    new = {c: F.coalesce(F.col(c).cast("double"), times(F.get("_fill", below[i]), row) + F.lit(m)) for i, (c, m) in enumerate(zip(cols, mean)) if missing[i]}
    kept = {c: F.col(c).cast("double") for c in columns if c not in new}
    return out.withColumns({**new, **kept}).select(*df.columns)


def _impute_by_rounds(df: DataFrame, columns: list[str], cols: list[str], mean: list[float], order: list[int], limit: float, max_iter: int) -> DataFrame:
    """The rounds of ``impute_iterative`` on the rows: co-moments of the rows that have a column, then its other rows are refilled."""
    import numpy as np
    d = len(cols)
    cur = df.withColumns({**{f"_v{i}": F.coalesce(F.col(c).cast("double") - F.lit(m), F.lit(0.0)) for i, (c, m) in enumerate(zip(cols, mean))},
                          **{f"_m{i}": F.col(c).isNull() for i, c in enumerate(cols)}}).checkpoint(eager=True)
    for _ in range(max_iter):
        new = cur.withColumns({f"_o{i}": F.col(f"_v{i}") for i in order})
        for c in order:
            others = [i for i in range(d) if i != c]
            r = new.where(~F.col(f"_m{c}")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_v{i}").alias(f"s{i}") for i in range(d)],
                                                *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]).first()
            middle = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
            spread = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - r["n"] * np.outer(middle, middle)
            beta = bayesian_ridge(spread[np.ix_(others, others)], spread[others, c], float(spread[c, c]), r["n"]) if others else np.zeros(0)
            base = float(middle[c] - beta @ middle[others])
            guess = sum((F.col(f"_v{j}") * F.lit(float(b)) for j, b in zip(others, beta)), F.lit(base))
            new = new.withColumn(f"_v{c}", F.when(F.col(f"_m{c}"), guess).otherwise(F.col(f"_v{c}")))
        new = new.checkpoint(eager=True)
        change = new.agg(F.max(sum((F.abs(F.col(f"_v{i}") - F.col(f"_o{i}")) for i in order), F.lit(0.0)))).first()[0] or 0.0
        cur = new
        if change < limit:
            break
    done = {cols[i]: F.coalesce(F.col(cols[i]).cast("double"), F.col(f"_v{i}") + F.lit(mean[i])) for i in range(d)}
    return cur.withColumns({**{c: F.col(c).cast("double") for c in columns}, **done}).select(*df.columns)


def impute_knn(df: DataFrame, column: str, on: list[str], n_neighbors: int = 5, key: list[str] | None = None) -> DataFrame:
    """I6 with other coordinates: a missing ``column`` gets the mean of its
    ``n_neighbors`` nearest donor rows (rows that have ``column``).  Distances
    are nan-euclidean: over the ``on`` coordinates that both rows have, the
    square scaled by their share of all.  The exact neighbour search of the
    kNN models runs for each pair of patterns of present coordinates that
    occurs; rows that share no coordinate with any donor get the column mean."""
    from pyspark.sql import Window

    from kiln.functions.frames import with_global_index
    from kiln.operators.neighbours import nearest, vote
    keys = key or list(df.columns)
    idx = with_global_index(df, keys, "_kid")
    has = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(on)), F.lit(0))
    seen = idx.groupBy(has.alias("has"), F.col(column).isNull().alias("needy")).count().collect()
    donor_has = [r["has"] for r in seen if not r["needy"]]
    found = None
    for q in sorted(r["has"] for r in seen if r["needy"]):
        for shared in sorted({q & d for d in donor_has} - {0}):
            dims = [c for i, c in enumerate(on) if shared >> i & 1]
            coords = F.array(*[F.col(c).cast("double") for c in dims])
            donors = idx.where(F.col(column).isNotNull() & (has.bitwiseAND(F.lit(q)) == shared)).select(
                F.col("_kid").alias("tid"), coords.alias("x"), F.col(column).cast("double").alias("label"))
            needy = idx.where(F.col(column).isNull() & (has == q)).select(F.col("_kid").alias("qid"), coords.alias("x"))
            part = nearest(donors, needy, n_neighbors).select(
                "qid", (F.col("d") * F.lit((len(on) / len(dims)) ** 0.5)).alias("d"), "tid", "label")
            found = part if found is None else found.unionByName(part)
    mean = df.agg(F.avg(column)).collect()[0][0]
    if found is None:
        return idx.withColumn(column, F.coalesce(F.col(column), F.lit(mean))).drop("_kid")
    w = Window.partitionBy("qid").orderBy("d", "tid")  # n_neighbors rows per set of shared coordinates
    found = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_neighbors).drop("_r")
    pred = vote(found, "uniform", classification=False)
    out = idx.join(pred.withColumnRenamed("qid", "_kid"), "_kid", "left")
    return out.withColumn(column, F.coalesce(F.col(column), F.col("prediction"), F.lit(mean))) \
        .drop("prediction", "_kid")
