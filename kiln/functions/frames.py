"""Frame-level helpers shared by operators: checked broadcast lookups,
skew-safe keep-first, and a global row index without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes a statistic table may have to be broadcast; above it the join shuffles.
BROADCAST_MAX_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: text, binary and nested values by their length, anything else by 8 bytes."""
    out = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        else:
            out = out + 8
    return out


def lookup(df: DataFrame, stats: DataFrame, on: list[str], how: str = "left",
           max_broadcast_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join a per-key statistic table (one row per key) back onto ``df``.

    The statistic is evaluated once, into the shared checkpoint folder, and
    broadcast if its measured bytes allow it.  Otherwise it is a shuffle
    join with a unique side, whose hot keys adaptive execution splits: only
    the skewed partitions of the data are dealt anew.
    """
    from kiln.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    stats = stats.checkpoint(eager=True)
    size = stats.agg(F.sum(_row_bytes(stats)).alias("b")).first()["b"] or 0
    return df.join(F.broadcast(stats) if size <= max_broadcast_bytes else stats, on=on, how=how)


def _slices(df: DataFrame, bytes_each: int = 128 << 20, rows_each: int = 20_000) -> int:
    """Range slices for a materialised ``df``, from its rows and bytes: the session's shuffle partitions, more where a slice
    would exceed ``bytes_each``, fewer where there are not ``rows_each`` rows for each."""
    conf = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return max(1, min(max(conf, -(-int(size["b"] or 0) // bytes_each)), -(-size["n"] // rows_each)))


def dealt_evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to several tasks per core, for work that is heavy next to the rows' bytes: a number that is asked
    for is kept, while adaptive execution puts the partitions of an aggregation together until they hold 64 MB."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def keep_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row of each key in ``order_by`` order.

    ``min(struct(order..., row...))`` is partially aggregated map-side, so a
    key holding a third of all rows costs one row per map task in the
    shuffle, unlike ``row_number()`` over a window, which sorts the whole
    key in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)],
                      *[F.col(c) for c in others]).alias("_r")
    best = df.groupBy(*keys).agg(F.min(packed).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def _ranged(df: DataFrame, order_by: list[str], num_partitions: int | None) -> DataFrame:
    """Range-partition on the order, sort inside each slice, tag each row
    with its slice (``_pid``) and position in it (``_local``), and
    materialise that once to the shared checkpoint folder.

    The materialisation is what makes the slices usable twice (once for
    per-slice counts, once for the rows): the range bounds come from a
    sample, and two evaluations of an un-materialised plan may sample
    differently.  A reliable checkpoint also survives executor loss."""
    from kiln.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions
    if n is None:  # evaluated once: the range bounds are sampled from the same rows that are dealt
        df = df.checkpoint(eager=True)
        n = _slices(df)
    ranged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_pid").cast("long"), 33)))
    return tagged.checkpoint(eager=True)


def _offsets(tagged: DataFrame, weight: Column) -> DataFrame:
    """Total of ``weight`` in all earlier slices, one row per slice; the
    window runs over one row per slice (bounded by the slice count)."""
    totals = tagged.groupBy("_pid").agg(F.sum(weight).alias("_tot"))
    return totals.select("_pid", F.coalesce(
        F.sum("_tot").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))


def with_global_index(df: DataFrame, order_by: list[str], name: str = "_rn",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in ``order_by`` order (must be a total order).

    An unpartitioned ``row_number()`` window runs in one task.  Instead the
    rows are range-partitioned on the order, numbered inside each slice,
    and shifted by the row count of all earlier slices."""
    tagged = _ranged(df, list(order_by), num_partitions)
    offsets = _offsets(tagged, F.lit(1))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def distinct_capped(df: DataFrame, column: str, cap: int | None = None, order: bool = True) -> list:
    """Distinct non-NULL values of a column; with ``cap``, more than that is an error."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = (d if cap is None else d.limit(cap + 1)).collect()
    if cap is not None and len(rows) > cap:
        raise ValueError(f"column {column!r} has more than {cap} distinct values")
    vals = [r[0] for r in rows]
    return sorted(vals) if order else vals


def prefix_sum(df: DataFrame, order_by: list[str], weight: str, name: str = "_cum",
               num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order_by`` order, distributed.

    Each range slice is summed locally (a window over that slice only) and
    shifted by the totals of all earlier slices.  ``order_by`` should be
    (close to) unique so that slices are balanced."""
    tagged = _ranged(df, list(order_by), num_partitions)
    w = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_lcum", F.sum(weight).over(w))
    offsets = _offsets(tagged, F.col(weight))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + F.col("_lcum"))
            .drop("_pid", "_local", "_lcum", "_off"))


def count_within(points: DataFrame, x: str, weight: str, radius: float, name: str = "within") -> DataFrame:
    """For each distinct ``x`` of ``points`` (x, weight), the total weight of
    points with value in [x - radius, x + radius], by two global ranks.

    Each point emits two probes (x - r, x + r).  In one global order of
    points and probes (lower probes before points at equal value, upper
    probes after), the running weight at the upper probe minus that at the
    lower probe is the weight in the closed interval.  No window is ever
    partitioned by value, so a dense value range does not land in one task.
    """
    r = float(radius)
    base = points.select(F.col(x).cast("double").alias("_x"), F.col(weight).cast("double").alias("_w"))
    events = base.select(
        F.explode(F.array(
            F.struct(F.col("_x").alias("v"), F.lit(0).alias("kind"), F.col("_w").alias("dw"), F.col("_x").alias("q")),
            F.struct((F.col("_x") - F.lit(r)).alias("v"), F.lit(-1).alias("kind"), F.lit(0.0).alias("dw"), F.col("_x").alias("q")),
            F.struct((F.col("_x") + F.lit(r)).alias("v"), F.lit(1).alias("kind"), F.lit(0.0).alias("dw"), F.col("_x").alias("q")),
        )).alias("e")).select("e.*")
    cum = prefix_sum(events, ["v", "kind", "q"], "dw", "_c")
    probes = cum.where(F.col("kind") != 0)
    return (probes.groupBy(F.col("q").alias(x))
            .agg((F.sum(F.when(F.col("kind") == 1, F.col("_c")))
                  - F.sum(F.when(F.col("kind") == -1, F.col("_c")))).alias(name)))


def ordered_blocks(df: DataFrame, order_by: list[str], before: int, after: int,
                   block_rows: int = 1 << 20, index: str = "_rn") -> DataFrame:
    """Prepare lag/lead windows over a global order without one task.

    Rows get their global position (``index``) and a block number
    ``_blk = index div block_rows``; the first ``after`` rows of each block
    are copied into the previous block and the last ``before`` rows into
    the next one (``_home`` = False on copies).  A window partitioned by
    ``_blk`` and ordered by ``index`` then sees every neighbour within
    ``before``/``after`` positions of each home row, and each task holds at
    most ``block_rows + before + after`` rows.
    """
    idx = with_global_index(df, order_by, index)
    b = F.floor(F.col(index) / F.lit(block_rows))
    off = F.col(index) - b * F.lit(block_rows)
    copies = F.array(
        F.struct(b.alias("_blk"), F.lit(True).alias("_home")),
        F.when(off < F.lit(after), F.struct((b - 1).alias("_blk"), F.lit(False).alias("_home"))),
        F.when(off >= F.lit(block_rows - before), F.struct((b + 1).alias("_blk"), F.lit(False).alias("_home"))),
    )
    return (idx.withColumn("_c", F.explode(F.array_compact(copies)))
            .select("*", "_c._blk", "_c._home").drop("_c"))
