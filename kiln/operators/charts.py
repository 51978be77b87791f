"""The aggregated table behind each chart.

Rendering is not built: each function returns the kilobytes a plot needs
(bins, quartiles, grid densities, lags), computed on the cluster.
Order-dependent charts (QQ, ACF, PACF, seasonal decomposition) use a
distributed global order (``with_global_index`` / ``ordered_blocks``),
never an unpartitioned window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.frames import dealt_evenly, lookup, ordered_blocks, with_global_index
from kiln.functions.quantile import grouped_quantiles, quantiles
from kiln.functions.special import norm_ppf_col
from kiln.functions.text import ENGLISH_STOP_WORDS



# ---------------------------------------------------------------- V1 histogram

def auto_bins(n: int, mn: float, mx: float, q1: float, q3: float) -> tuple[int, float, float]:
    """numpy ``bins='auto'``: the smaller of the Freedman-Diaconis and
    Sturges widths; returns (bins, first edge, last edge)."""
    first, last = float(mn), float(mx)
    if first == last:
        first, last = first - 0.5, last + 0.5
    width = 0.0
    if n > 0 and mx > mn:
        sturges = (mx - mn) / (math.log2(n) + 1.0)
        fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
        width = min(fd, sturges) if fd else sturges
    bins = int(math.ceil((last - first) / width)) if width else 1
    return max(bins, 1), first, last


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """V1: (bin, lower, upper, count); bins are half-open, the last closed."""
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull())
    row = data.agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()[0]
    if not row["n"]:
        return df.sparkSession.createDataFrame([], "bin long, lower double, upper double, count long")
    if bins is None:
        q1, q3 = quantiles(data, {"x": [0.25, 0.75]}, base={"x": (row["n"], row["a"], row["b"])})["x"]
        nb, first, last = auto_bins(row["n"], row["a"], row["b"], q1, q3)
    else:
        nb, first, last = int(bins), row["a"], row["b"]
        if first == last:
            first, last = first - 0.5, last + 0.5
    step = (last - first) / nb

    def edge(i):
        return F.when(i >= nb, F.lit(last)).otherwise(i.cast("double") * F.lit(step) + F.lit(first))

    guess = F.floor((F.col("x") - F.lit(first)) / F.lit(last - first) * F.lit(nb))
    guess = F.least(guess, F.lit(nb - 1))
    down = guess - F.when(F.col("x") < edge(guess), 1).otherwise(0)
    up = down + F.when((F.col("x") >= edge(down + 1)) & (down != nb - 1), 1).otherwise(0)
    counts = data.select(up.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(nb).withColumnRenamed("id", "bin")
    return (grid.join(counts, "bin", "left")
            .select("bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ---------------------------------------------------------------- V2 boxplot

def boxplot(df: DataFrame, y: str, x: str | None = None, whis: float = 1.5) -> DataFrame:
    """V2: per group q1, median, q3, whiskers (furthest data inside
    whis*IQR of the box) and the number of points beyond them."""
    groups = [x] if x else []
    data = df.select(*groups, F.col(y).cast("double").alias("y")).where(F.col("y").isNotNull())
    q = grouped_quantiles(data, {"y": [0.25, 0.5, 0.75]}, groups)
    rows = [(*(k if groups else ()), *v["y"]) for k, v in q.items()]
    schema = ", ".join([f"`{x}` {df.schema[x].dataType.simpleString()}"] if x else []) + \
        (", " if x else "") + "q1 double, median double, q3 double"
    stats = df.sparkSession.createDataFrame(rows, schema)
    key = groups or None
    if key:
        joined = lookup(data, stats, key, "inner")
    else:
        s = stats.collect()[0]
        joined = data.withColumns({"q1": F.lit(s["q1"]), "median": F.lit(s["median"]), "q3": F.lit(s["q3"])})
    lo = F.col("q1") - whis * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + whis * (F.col("q3") - F.col("q1"))
    inside = (F.col("y") >= lo) & (F.col("y") <= hi)
    return (joined.groupBy(*groups, "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("y"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers"),
                 F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- V3 scatter, V6 pairplot

def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, key: list[str] | None = None,
            cap: int | None = None) -> DataFrame:
    """V3: the points of all rows.  With ``cap`` (a display budget), that many, first by a stable hash of ``key``."""
    cols = [x, y] + ([hue] if hue else [])
    if cap is None:
        return df.select(*cols)
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key or cols]))
    return df.select(*cols, h.alias("_h")).orderBy("_h").limit(cap).drop("_h")


def pairplot(df: DataFrame, columns: list[str], cap: int | None = None) -> dict:
    """V6: a histogram per column (diagonal) and scatter points per pair."""
    out = {"hist": {c: histogram(df, c) for c in columns}, "scatter": {}}
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            out["scatter"][(a, b)] = scatter(df, a, b, cap=cap)
    return out


# ---------------------------------------------------------------- V7 qq

def qq(df: DataFrame, column: str, tie_break: list[str] | None = None, max_points: int | None = None):
    """V7: ordered values against normal quantiles of Filliben positions;
    returns (summary row DataFrame with slope/intercept/r, points: of all
    rows, or about ``max_points`` evenly spaced ones)."""
    data = df.select(F.col(column).cast("double").alias("y"), *(tie_break or [])).where(F.col("y").isNotNull())
    n = data.count()
    if n == 0:
        raise ValueError("no values")
    ranked = with_global_index(data, ["y", *(tie_break or [])], "_i")
    i = F.col("_i") + 1
    m = (i - 0.3175) / (n + 0.365)
    last = 0.5 ** (1.0 / n)
    m = F.when(i == n, F.lit(last)).when(i == 1, F.lit(1 - last)).otherwise(m)
    pts = ranked.select(F.col("_i"), norm_ppf_col(m).alias("osm"), F.col("y").alias("osr"))
    fit = pts.agg(F.regr_slope("osr", "osm").alias("slope"), F.regr_intercept("osr", "osm").alias("intercept"),
                  F.corr("osr", "osm").alias("r"), F.count(F.lit(1)).alias("n"))
    if max_points is None:
        return fit, pts.drop("_i")
    step = max(1, n // max_points)
    return fit, pts.where((F.col("_i") % step == 0) | (F.col("_i") == n - 1)).drop("_i")


# ---------------------------------------------------------------- V8/V9 bar, line

def bar(df: DataFrame, x: str, y: str | None = None, hue: str | None = None, z: float = 1.959963984540054) -> DataFrame:
    """V8: mean of y per x (and hue) with a 95% normal-approximation
    interval; without y, the count per x."""
    groups = [x] + ([hue] if hue else [])
    if y is None:
        return df.where(F.col(x).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("count"))
    yy = F.col(y).cast("double")
    g = df.where(F.col(x).isNotNull() & yy.isNotNull()).groupBy(*groups).agg(
        F.avg(yy).alias("mean"), F.stddev_samp(yy).alias("_sd"), F.count(F.lit(1)).alias("n"))
    se = F.col("_sd") / F.sqrt(F.col("n"))
    return g.select(*groups, "mean", "n", (F.col("mean") - z * se).alias("ci_low"),
                    (F.col("mean") + z * se).alias("ci_high"))


def bar_bootstrap(df: DataFrame, x: str, y: str, key: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """V8 interval by Poisson bootstrap over (x, value, count): a value on n rows gets one Poisson(n) weight per replicate, so
    the work follows the distinct values.  Draws come from a hash of (x, value), so the answer is repeatable under any
    partitioning (``key`` is not needed for that); tasks reduce their values to two sums per (x, replicate), and the 2.5/97.5%
    percentiles of the replicate means are taken per x."""
    import numpy as np
    import pandas as pd
    yy = F.col(y).cast("double")
    data = df.where(F.col(x).isNotNull() & yy.isNotNull()).groupBy(F.col(x).alias("_x"), yy.alias("_y")).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_id", F.xxhash64("_x", "_y", F.lit(seed)))

    def partial(batches):
        draw = np.random.Philox(0)
        start, gen = draw.state, np.random.Generator(draw)
        sums: dict = {}
        for pdf in batches:
            for h, part in pdf.groupby("_x", sort=False):
                acc = sums.setdefault(h, np.zeros((2, replicates)))
                for v, n, i in zip(part["_y"].to_numpy(), part["_n"].to_numpy(), part["_id"].to_numpy().astype(np.uint64)):
                    start["state"]["key"][0] = i  # a stream of its own for each value
                    draw.state = start
                    w = gen.poisson(n, replicates)
                    acc[0] += v * w
                    acc[1] += w
            if len(sums) > 200:
                yield from packed(sums)
                sums = {}
        yield from packed(sums)

    def packed(sums):
        for h, acc in sums.items():
            yield pd.DataFrame({"_x": [h] * replicates, "_b": np.arange(replicates, dtype="int32"), "s": acc[0], "w": acc[1]})

    parts = dealt_evenly(data, "_id").mapInPandas(partial, f"_x {df.schema[x].dataType.simpleString()}, _b int, s double, w double")
    means = parts.groupBy("_x", "_b").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("_m"))
    return means.groupBy(F.col("_x").alias(x)).agg(F.percentile("_m", [0.025, 0.975]).alias("_ci")).select(
        x, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))


def line(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """V9: as V8, ordered by x."""
    return bar(df, x, y, hue).orderBy(x, *([hue] if hue else []))


# ---------------------------------------------------------------- V10 kde, V5 violin

def kde(df: DataFrame, column: str, gridsize: int = 200, cut: float = 3.0, bw_adjust: float = 1.0,
        hue: str | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on a ``gridsize`` grid spanning
    min - cut*bw .. max + cut*bw.  With ``hue``, one curve per level (rows
    without a level are left out), each scaled by the level's share of rows.

    All levels are computed in one pass: duplicates collapse to (level,
    value, multiplicity), each task adds the kernels of its values to the
    grids of its levels with numpy, and the partial sums are added per
    (level, grid point)."""
    import numpy as np
    import pandas as pd
    x = F.col(column).cast("double")
    level = F.col(hue) if hue else F.lit(0)
    data = df.select(level.alias("_h"), x.alias("x")).where(F.col("x").isNotNull() & F.col("_h").isNotNull())
    st = data.groupBy("_h").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("a"), F.max("x").alias("b"))
    total = data.count()
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.lit(bw_adjust)
    st = st.where((F.col("n") >= 2) & (F.col("sd") > 0)).select("_h", "n", bw.alias("bw"), (F.col("a") - cut * bw).alias("lo"),
                                                                (F.col("b") + cut * bw).alias("hi"))
    values = data.groupBy("_h", "x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    joined = lookup(values, st, ["_h"], "inner")
    kind = df.schema[hue].dataType.simpleString() if hue else "int"

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for h, part in pdf.groupby("_h", sort=False):
                b, lo, hi = (float(part[c].iloc[0]) for c in ("bw", "lo", "hi"))
                grid = lo + np.arange(gridsize) * ((hi - lo) / (gridsize - 1))
                grid[-1] = hi
                acc = sums.setdefault(h, np.zeros(gridsize))
                xs, ws = part["x"].to_numpy(), part["w"].to_numpy()
                for k in range(0, len(xs), 4096):
                    z = (grid[:, None] - xs[None, k:k + 4096]) / b
                    acc += np.exp(-0.5 * z * z) @ ws[k:k + 4096]
            if len(sums) > 1000:  # levels held by a task at once
                yield from packed(sums)
                sums = {}
        yield from packed(sums)

    def packed(sums):
        for h, acc in sums.items():
            yield pd.DataFrame({"_h": [h] * gridsize, "i": np.arange(gridsize, dtype="int32"), "s": acc})

    parts = joined.select("_h", "x", "w", "bw", "lo", "hi").mapInPandas(partial, f"_h {kind}, i int, s double")
    curve = lookup(parts.groupBy("_h", "i").agg(F.sum("s").alias("s")), st, ["_h"], "inner")
    step = (F.col("hi") - F.col("lo")) / F.lit(float(gridsize - 1))
    grid = F.when(F.col("i") == gridsize - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * step)
    share = (F.col("n") / F.lit(float(total or 1))) if hue else F.lit(1.0)
    density = F.col("s") * (1.0 / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)) * share)
    out = curve.select("i", grid.alias("x"), density.alias("density"), *([F.col("_h").alias(hue)] if hue else []))
    return out


def violin(df: DataFrame, y: str, x: str | None = None) -> dict:
    """V5: per-group quartiles (V2) and density curve."""
    return {"box": boxplot(df, y, x), "density": kde(df, y, hue=x)}


# ---------------------------------------------------------------- V11 pie, V12 words

def pie(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Share of each slice in percent (counts per x, or raw y per row)."""
    if y is None:
        vc = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("value"))
    else:
        vc = df.select(x, F.col(y).cast("double").alias("value"))
    total = vc.agg(F.sum("value")).collect()[0][0] or 1
    return vc.withColumn("percent", F.col("value") / F.lit(float(total)) * 100.0)


WORD_PATTERN = r"\w[\w']+"


def word_frequencies(df: DataFrame, column: str, top: int = 200, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Lower-cased words of 2+ characters, stop words and pure numbers
    out, the ``top`` most frequent (the cloud's budget)."""
    # ``isin`` over many literals becomes a hash-set lookup (InSet)
    words = (df.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(WORD_PATTERN), 0)).alias("word"))
             .where(~F.col("word").isin(*stop_words) & ~F.col("word").rlike(r"^[0-9]+$")))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("word")).limit(top))


# ---------------------------------------------------------------- V13-V15 series

def default_nlags(n: int) -> int:
    return min(int(10 * math.log10(n)), n // 2) if n > 1 else 0


def acf(df: DataFrame, column: str, order_by: list[str], nlags: int | None = None,
        block_rows: int = 1 << 20) -> DataFrame:
    """Autocorrelation at lags 0..K (denominator n), with Bartlett's
    95% band.  Lag products come from lead() inside bounded blocks of the
    global order (``ordered_blocks``), all lags summed in one aggregate."""
    data = df.select(F.col(column).cast("double").alias("x"), *order_by).where(F.col("x").isNotNull())
    st = data.agg(F.count("x").alias("n"), F.avg("x").alias("m")).collect()[0]
    n, m = st["n"], st["m"]
    k = default_nlags(n) if nlags is None else min(nlags, n - 1)
    blocks = ordered_blocks(data, order_by, 0, k, block_rows)
    w = Window.partitionBy("_blk").orderBy("_rn")
    d = F.col("x") - F.lit(m)
    prods = blocks.select("_home", "x", *[(d * (F.lead("x", j).over(w) - F.lit(m))).alias(f"p{j}")
                                          for j in range(1, k + 1)])
    row = prods.where("_home").agg(F.sum(d * d).alias("c0"), *[F.sum(f"p{j}").alias(f"c{j}")
                                                                 for j in range(1, k + 1)]).collect()[0]
    c0 = row["c0"]
    vals = [1.0] + [(row[f"c{j}"] or 0.0) / c0 for j in range(1, k + 1)]
    rows, cum = [], 0.0
    z = 1.959963984540054
    for j, v in enumerate(vals):
        var = 0.0 if j == 0 else (1.0 + 2.0 * cum) / n
        half = z * math.sqrt(var)
        rows.append((j, v, v - half, v + half))
        if j >= 1:
            cum += v * v
    return df.sparkSession.createDataFrame(rows, "lag int, acf double, ci_low double, ci_high double")


def pacf(df: DataFrame, column: str, order_by: list[str], nlags: int | None = None) -> DataFrame:
    """Partial autocorrelation by Yule-Walker (Levinson-Durbin on the
    V13 autocorrelations, a few dozen numbers on the driver)."""
    n = df.where(F.col(column).isNotNull()).count()
    k = nlags if nlags is not None else min(int(10 * math.log10(n)), n // 2 - 1)
    r = [row["acf"] for row in acf(df, column, order_by, k).orderBy("lag").collect()]
    out = [1.0]
    phi_prev: list[float] = []
    err = r[0]
    for j in range(1, k + 1):
        acc = r[j] - sum(phi_prev[i] * r[j - 1 - i] for i in range(len(phi_prev)))
        kj = acc / err
        phi = [phi_prev[i] - kj * phi_prev[j - 2 - i] for i in range(len(phi_prev))] + [kj]
        err *= (1 - kj * kj)
        phi_prev = phi
        out.append(kj)
    half = 1.959963984540054 / math.sqrt(n)
    return df.sparkSession.createDataFrame([(j, v, v - half, v + half) for j, v in enumerate(out)],
                                           "lag int, pacf double, ci_low double, ci_high double")


def seasonal_decompose(df: DataFrame, column: str, order_by: list[str], period: int = 12,
                       block_rows: int = 1 << 20) -> DataFrame:
    """Additive decomposition.  Trend is the centred moving average
    (2 x period for even periods: half weights at the ends), missing at the
    ends; seasonal is the per-phase mean of the detrended series, centred;
    residual is what remains.  Phase = position mod period."""
    data = df.select(F.col(column).cast("double").alias("x"), *order_by)
    h = period // 2
    if period % 2 == 0:
        weights = [0.5] + [1.0] * (period - 1) + [0.5]
    else:
        weights = [1.0] * period
    weights = [wt / period for wt in weights]
    blocks = ordered_blocks(data, order_by, h, h, block_rows)
    w = Window.partitionBy("_blk").orderBy("_rn")
    terms = []
    for i, wt in enumerate(weights):
        off = i - h
        v = F.lag("x", -off).over(w) if off < 0 else (F.lead("x", off).over(w) if off > 0 else F.col("x"))
        terms.append(v * F.lit(wt))
    trend = terms[0]
    for t in terms[1:]:
        trend = trend + t
    parts = blocks.select("_rn", "_home", *order_by, F.col("x").alias("observed"), trend.alias("trend"))
    parts = parts.where("_home").drop("_home").withColumn("phase", (F.col("_rn") % period).cast("int"))
    means = (parts.groupBy("phase").agg(F.avg(F.col("observed") - F.col("trend")).alias("m"))
             .collect())
    pm = {r["phase"]: r["m"] for r in means}
    vals = [pm.get(p) for p in range(period)]
    known = [v for v in vals if v is not None]
    centre = sum(known) / len(known) if known else 0.0
    seas = F.element_at(F.array(*[F.lit(None if v is None else v - centre).cast("double") for v in vals]),
                        F.col("phase") + 1)
    return (parts.withColumn("seasonal", seas)
            .withColumn("resid", F.col("observed") - F.col("trend") - F.col("seasonal"))
            .withColumnRenamed("_rn", "position"))

