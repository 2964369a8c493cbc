"""Ordered-series operators that do not put a whole group into one task.

A plain `Window.partitionBy(clip).orderBy(t)` sorts every row of a clip in one task. One clip
may hold a large share of all rows, so ordered work is split into blocks of consecutive
positions. Inside a block a window does the work; what a block needs from the others (a running
total, the last row before it) is one small row per block, carried over and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackframe.functions.scalar import col, deg180
from trackframe.session import checkpoint

BLOCK = 4096
#: Parts of a hot group; how much larger rows may be in memory than a table's estimate, which is that of its files.
SALTS, PACKED = 32, 4


def salted_join(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Sequence[str | Column],
                how: str = "inner", salts: int = SALTS, keep_salt: bool = False) -> DataFrame:
    """Join group-level rows onto a large table without sending a hot group to one task.

    `small` holds one row per group. Where its estimate is well under the broadcast threshold (files are packed, so rows
    take more), Spark sends it to all tasks as it is. Else it is repeated once per salt, and `big` picks its salt from
    `spread`, so a hot group is cut into `salts` parts; Spark measures a side before it is repeated, so the copies of a
    side that it takes for small are merged, not gathered in the driver. With `keep_salt` the `_salt` column stays, so
    later grouping on it needs no new shuffle.
    """
    on = list(on)
    salt = F.pmod(F.xxhash64(*[col(c) for c in spread]), F.lit(salts)).cast("int")
    size, most = _estimate(small), small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if size * PACKED <= most:
        return (big.withColumn("_salt", salt) if keep_salt else big).join(small, on, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = big.withColumn("_salt", salt).join(copies.hint("merge") if size <= most else copies, on + ["_salt"], how)
    return joined if keep_salt else joined.drop("_salt")


def _estimate(df: DataFrame) -> int:
    """Bytes that Spark takes a table for before it runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def blocks(order: str | Column, block: int = BLOCK) -> Column:
    return F.floor(col(order) / F.lit(block)).cast("long")


def halo(df: DataFrame, order: str, block: int, before: int, after: int) -> DataFrame:
    """Cut a densely numbered series into blocks that overlap by `before` and `after` rows.

    Adds `_blk` and `_own`; a row is owned by exactly one block, the copies only feed its
    neighbours' windows. Needs consecutive integers in `order`, block > before, after.
    """
    b = blocks(order, block)
    r = F.pmod(F.col(order), F.lit(block))
    spots = F.array(
        b,
        F.when((r < after) & (b > 0), b - 1) if after else F.lit(None).cast("long"),
        F.when(r >= block - before, b + 1) if before else F.lit(None).cast("long"),
    )
    # a row near a block's start follows the end of the block before it, and the other way round
    return (df.withColumn("_blk", F.explode(F.array_compact(spots)))
            .withColumn("_own", F.col("_blk") == b))


def _carried(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], carry: Mapping[str, Column]) -> DataFrame:
    """One row per (by, _blk) from `aggs`, then `carry` windows over the blocks."""
    per_block = df.groupBy(*by, "_blk").agg(*aggs)
    return per_block.select(*by, "_blk", *[c.alias(name) for name, c in carry.items()])


def dense_index(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], position: Column,
                name: str = "t", block: int = BLOCK) -> DataFrame:
    """Number the rows of each group 0.. in `order`.

    `position` is any integer that never falls along `order` (an id, a second); blocks are cut on it.
    """
    by = list(by)
    d = df.withColumn("_blk", blocks(position, block))
    over = W.partitionBy(*by).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    base = _carried(d, by, [F.count(F.lit(1)).alias("_n")],
                    {"_base": F.coalesce(F.sum("_n").over(over), F.lit(0))})
    rank = F.row_number().over(W.partitionBy(*by, "_blk").orderBy(*[col(c) for c in order]))
    return (d.join(base, by + ["_blk"]).withColumn(name, (F.col("_base") + rank - 1).cast("long"))
            .drop("_blk", "_base"))


def prefix_sums(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, Column | str],
                block: int = BLOCK) -> DataFrame:
    """Running totals (this row included) of each expression in `sums`, along an integer `order`."""
    by = list(by)
    d = df.withColumn("_blk", blocks(order, block))
    over = W.partitionBy(*by).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    before = _carried(d, by, [F.sum(col(c)).alias(f"_s_{n}") for n, c in sums.items()],
                      {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(over), F.lit(0.0)) for n in sums})
    inside = W.partitionBy(*by, "_blk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = d.join(before, by + ["_blk"])
    for n, c in sums.items():
        joined = joined.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(col(c)).over(inside), F.lit(0.0)))
    return joined.drop("_blk", *[f"_b_{n}" for n in sums])


def neighbours(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], position: Column | None = None,
               block: int = BLOCK) -> DataFrame:
    """Add prev_<c> and next_<c>, the values in the row before and after along `order`.

    The order need not be dense; a block takes its first and last neighbours from the carry rows.
    """
    by = list(by)
    d = df.withColumn("_blk", blocks(order if position is None else position, block))
    rec = F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"v_{c}") for c in cols])
    over = W.partitionBy(*by).orderBy("_blk")
    edge = _carried(d, by, [F.min(rec).alias("_first"), F.max(rec).alias("_last")],
                    {"_before": F.lag("_last").over(over), "_after": F.lead("_first").over(over)})
    inside = W.partitionBy(*by, "_blk").orderBy(order)
    out = d.join(edge, by + ["_blk"])
    first = F.row_number().over(inside) == 1
    last = F.lead(F.lit(1)).over(inside).isNull()
    out = out.withColumn("_isf", first).withColumn("_isl", last)
    for c in cols:
        out = (out.withColumn(f"prev_{c}", F.when(F.col("_isf"), F.col(f"_before.v_{c}")).otherwise(F.lag(c).over(inside)))
               .withColumn(f"next_{c}", F.when(F.col("_isl"), F.col(f"_after.v_{c}")).otherwise(F.lead(c).over(inside))))
    return out.drop("_blk", "_before", "_after", "_isf", "_isl")


def known_around(df: DataFrame, by: Sequence[str], order: str, present: Column, cols: Sequence[str],
                 block: int = BLOCK) -> DataFrame:
    """Add `_left` and `_right`, the nearest known record at or before, and at or after, each row.

    A record is a struct of the order value (`o`) and `cols`; null where there is none.
    """
    return _known_in_blocks(df.withColumn("_blk", blocks(order, block)), by, order, present, cols)


def known_in_ranges(df: DataFrame, by: Sequence[str], order: str, present: Column, cols: Sequence[str]) -> DataFrame:
    """The same along an `order` of any scale: blocks are ranges of (by, order) that Spark samples from the rows.

    Rows that share an order value are told apart by a hash, so that no value makes a range of its own.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *[F.col(c) for c in by], F.col(order), F.xxhash64(*df.columns))
    return _known_in_blocks(checkpoint(laid.withColumn("_blk", F.spark_partition_id())), by, order, present, cols)


def _known_in_blocks(d: DataFrame, by: Sequence[str], order: str, present: Column, cols: Sequence[str]) -> DataFrame:
    by = list(by)
    d = d.withColumn("_rec", F.when(present, F.struct(F.col(order).alias("o"), *[F.col(c) for c in cols])))
    back = W.partitionBy(*by).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*by).orderBy("_blk").rowsBetween(1, W.unboundedFollowing)
    edge = _carried(d, by, [F.min("_rec").alias("_f"), F.max("_rec").alias("_l")],
                    {"_kb": F.last("_l", ignorenulls=True).over(back), "_ka": F.first("_f", ignorenulls=True).over(ahead)})
    inside, here = W.partitionBy(*by, "_blk"), F.col("_rec").isNull()  # of equal order values, known rows come first
    left = F.last("_rec", ignorenulls=True).over(inside.orderBy(order, here).rowsBetween(W.unboundedPreceding, 0))
    # running backward: a frame that shrinks from the front would be read anew for every row
    right = F.last("_rec", ignorenulls=True).over(inside.orderBy(F.desc(order), here).rowsBetween(W.unboundedPreceding, 0))
    return (d.join(edge, by + ["_blk"])
            .withColumn("_left", F.coalesce(left, F.col("_kb")))
            .withColumn("_right", F.coalesce(right, F.col("_ka")))
            .drop("_blk", "_rec", "_kb", "_ka"))


def group_stats(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], spread: Sequence[str | Column]) -> DataFrame:
    """Attach whole-group aggregates to every row: aggregate with map-side combine, then a salted join."""
    return salted_join(df, df.groupBy(*by).agg(*aggs), by, spread)


# ---------------------------------------------------------------- order-based repairs

def fill_gaps(series: DataFrame, by: Sequence[str], cols: Sequence[str], t: str = "t", k: int = 5) -> DataFrame:
    """Linear fill of null runs of at most k between two known rows; adds flag ok / interp / gap.

    The series is a spine (one row per integer t); a row is missing when its first column is null.
    """
    present = F.col(cols[0]).isNotNull()
    d = known_around(series, by, t, present, cols)
    gap = F.col("_right.o") - F.col("_left.o") - 1
    usable = ~present & F.col("_left").isNotNull() & F.col("_right").isNotNull() & (gap <= k)
    f = F.try_divide(F.col(t) - F.col("_left.o"), gap + 1)
    out = d.withColumn("flag", F.when(present, "ok").when(usable, "interp").otherwise("gap"))
    filled = {c: F.when(F.col("flag") == "interp", F.col(f"_left.{c}") + f * (F.col(f"_right.{c}") - F.col(f"_left.{c}")))
              .otherwise(F.col(c)) for c in cols}
    return out.withColumns(filled).drop("_left", "_right")


def hold_last(series: DataFrame, by: Sequence[str], cols: Sequence[str], t: str = "t", initial: float = 0.0,
              present: Column | None = None) -> DataFrame:
    """Carry the last known value forward; rows before the first known value take `initial`."""
    ok = F.col(cols[0]).isNotNull() if present is None else present
    d = known_around(series, by, t, ok, cols)
    for c in cols:
        d = d.withColumn(c, F.coalesce(F.col(f"_left.{c}"), F.lit(initial)))
    return d.drop("_left", "_right")


def interp_time(series: DataFrame, by: Sequence[str], v: str, t: str = "t") -> DataFrame:
    """Interpolate nulls along time; ends take the nearest known value; an all-null series becomes 0."""
    d = known_around(series, by, t, F.col(v).isNotNull(), [v])
    f = F.try_divide(F.col(t) - F.col("_left.o"), F.col("_right.o") - F.col("_left.o"))
    between = F.col(f"_left.{v}") + f * (F.col(f"_right.{v}") - F.col(f"_left.{v}"))
    filled = F.coalesce(F.col(v), between, F.col(f"_left.{v}"), F.col(f"_right.{v}"), F.lit(0.0))
    return (d.withColumn("filled", F.col(v).isNull()).withColumn(v, filled).drop("_left", "_right"))


def densify(track: DataFrame, by: Sequence[str], cols: Sequence[str], t: str = "t") -> DataFrame:
    """One row per integer t between consecutive rows, linear in `cols`; measured rows keep duplicates.

    The fill never needs more than a row and its successor, so a long gap is expanded where the row is.
    """
    d = neighbours(track, by, t, [t, *cols])
    gap = F.col(f"next_{t}") - F.col(t)
    steps = F.when(gap > 1, F.sequence(F.lit(0).cast("long"), gap - 1)).otherwise(F.array(F.lit(0).cast("long")))
    d = d.withColumn("_k", F.explode(steps))
    f = F.when(F.col("_k") > 0, F.col("_k") / gap).otherwise(F.lit(0.0))
    out = d.withColumn("filled", F.col("_k") > 0)
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_k") > 0, F.col(c) + (F.col(f"next_{c}") - F.col(c)) * f).otherwise(F.col(c)))
    drop = ["_k"] + [f"{p}_{c}" for c in [t, *cols] for p in ("prev", "next")]
    return out.withColumn(t, F.col(t) + F.col("_k")).drop(*drop)


def smooth_pinned(series: DataFrame, by: Sequence[str], cols: Sequence[str], i: str = "i", n: str = "n",
                  block: int = BLOCK) -> DataFrame:
    """Centred five-point mean whose radius shrinks to min(2, i, n-1-i), so both ends stay exact.

    `i` numbers the rows 0 .. n-1; n <= 2 is left alone.
    """
    d = halo(series, i, block, 2, 2)
    w = W.partitionBy(*by, "_blk").orderBy(i)
    r = F.least(F.lit(2), F.col(i), F.col(n) - 1 - F.col(i))
    for c in cols:
        one, two = F.avg(c).over(w.rowsBetween(-1, 1)), F.avg(c).over(w.rowsBetween(-2, 2))
        d = d.withColumn(f"_sm_{c}", F.when((F.col(n) <= 2) | (r <= 0), F.col(c)).when(r == 1, one).otherwise(two))
    d = d.filter("_own")
    for c in cols:
        d = d.withColumn(c, F.col(f"_sm_{c}"))
    return d.drop("_blk", "_own", *[f"_sm_{c}" for c in cols])


def unwrap_degrees(series: DataFrame, by: Sequence[str], v: str, t: str = "t", period: float = 360.0) -> DataFrame:
    """Remove whole-turn jumps: the first value plus the running sum of wrapped steps."""
    half = period / 2
    d = neighbours(series, by, t, [v])
    step = F.pmod(F.col(v) - F.col(f"prev_{v}") + half, F.lit(period)) - half
    d = d.withColumn("_step", F.when(F.col(f"prev_{v}").isNull(), F.col(v)).otherwise(step))
    return prefix_sums(d, by, t, {v + "_u": "_step"}).withColumn(v, F.col(v + "_u")).drop(
        v + "_u", "_step", f"prev_{v}", f"next_{v}")


def _ends(series: DataFrame, by: Sequence[str], v: str, t: str) -> DataFrame:
    return series.groupBy(*by).agg(F.min_by(v, t).alias("_first"), F.max_by(v, t).alias("_last"),
                                   F.avg(v).alias("_mean"), F.count(v).alias("_n"))


def detrend_ends(series: DataFrame, by: Sequence[str], v: str, t: str = "t") -> DataFrame:
    """Subtract the line from the first to the last value (t runs 0 .. n-1) and add the mean back."""
    d = salted_join(series, _ends(series, by, v, t), by, [t])
    line = F.col("_first") + (F.col("_last") - F.col("_first")) * F.col(t) / F.greatest(F.col("_n") - 1, F.lit(1))
    return d.withColumn(v, F.col(v) - line + F.col("_mean")).drop("_first", "_last", "_mean", "_n")


def close_loop(series: DataFrame, by: Sequence[str], v: str, t: str = "t") -> DataFrame:
    """Spread a track's net drift over the clip about its midpoint; fewer than four rows are left alone."""
    d = salted_join(series, _ends(series, by, v, t), by, [t])
    drift = deg180(F.col("_last") - F.col("_first")) / F.col("_n")
    out = F.col(v) - drift * (F.col(t) - (F.col("_n") - 1) / 2)
    return d.withColumn(v, F.when(F.col("_n") < 4, F.col(v)).otherwise(out)).drop("_first", "_last", "_mean", "_n")


def runs(series: DataFrame, by: Sequence[str], on: Column, t: str = "t", min_len: int = 1) -> DataFrame:
    """Maximal runs of consecutive integers t where `on` holds: (by, start, stop, length), stop exclusive."""
    hit = series.filter(on).select(*by, t)
    near = neighbours(hit, by, t, [t])
    starts = near.withColumn("_new", F.when(F.coalesce(F.col(f"prev_{t}") == F.col(t) - 1, F.lit(False)), 0).otherwise(1))
    numbered = prefix_sums(starts, by, t, {"_run": F.col("_new").cast("double")})
    out = numbered.groupBy(*by, "_run").agg(F.min(t).alias("start"), (F.max(t) + 1).alias("stop"))
    out = out.withColumn("length", F.col("stop") - F.col("start")).drop("_run")
    return out.filter(F.col("length") >= min_len)


def longest_run(series: DataFrame, by: Sequence[str], on: Column, t: str = "t") -> DataFrame:
    """The longest run per group; the first one on ties."""
    r = runs(series, by, on, t)
    top = r.groupBy(*by).agg(F.max(F.struct("length", (-F.col("start")).alias("neg"), "stop")).alias("_b"))
    return top.select(*by, (-F.col("_b.neg")).alias("start"), F.col("_b.stop").alias("stop"), F.col("_b.length").alias("length"))


def circular_mean(df: DataFrame, by: Sequence[str], angle: Column) -> DataFrame:
    """atan2 of summed sines and cosines, with the resultant length; null angles are left out."""
    return df.groupBy(*by).agg(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))).alias("mean_angle"),
                               (F.hypot(F.sum(F.sin(angle)), F.sum(F.cos(angle))) / F.count(angle)).alias("resultant"))


# ---------------------------------------------------------------- ranking

def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first k rows of each group in `order`, numbered from 1. `order` must be a total order.

    Ranked twice: inside salted parts first, so at most salts * k rows of a group meet in one task.
    """
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    part = df.withColumn("_salt", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(salts)))
    part = part.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    out = part.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.filter(F.col(rank) <= k).drop("_salt", "_r")


def sorted_index(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of each group from 1 in any total `order`, without a window over a whole group.

    The table is range-partitioned on (by, order), so a hot group spans many partitions; each
    partition counts its rows per group and the running counts give every row its rank.
    """
    by = list(by)
    laid = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id())
    laid = checkpoint(laid)
    over = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = laid.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_p", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(*by, "_p").orderBy(*order))
    return laid.join(base, by + ["_p"]).withColumn(name, (F.col("_base") + inside).cast("long")).drop("_p", "_base")


def quantiles(df: DataFrame, by: Sequence[str], cols: Mapping[str, Column | str], p: float = 0.5, upper: bool = False) -> DataFrame:
    """Exact quantile of each expression per group, nulls left out: (by, one column per expression).

    Interpolated between the two middle ranks, or with `upper` the value at rank n // 2 itself. The
    built-in exact percentiles hold a group's values in one task's memory; here the values are ranked
    across range partitions and only the rows at the wanted ranks are kept.
    """
    by = list(by)
    rec = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), col(c).cast("double").alias("_val")) for n, c in cols.items()]))
    long = df.select(*by, rec.alias("_r")).select(*by, "_r.*").filter(F.col("_val").isNotNull()).withColumn("_tie", F.monotonically_increasing_id())
    key = by + ["_name"]
    ranked = sorted_index(long, key, [F.col("_val"), F.col("_tie")], "_rank")
    n = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    d = salted_join(ranked, n, key, ["_tie"])
    h = (F.col("_n") - 1) * p
    at = F.col("_rank") - 1
    if upper:
        d = d.filter(at == F.floor(F.col("_n") / 2)).withColumn("_w", F.lit(1.0))
    else:
        d = d.filter((at == F.floor(h)) | (at == F.ceil(h))).withColumn("_w", F.when(F.floor(h) == F.ceil(h), 1.0).otherwise(1 - F.abs(h - at)))
    val = d.groupBy(*key).agg(F.sum(F.col("_w") * F.col("_val")).alias("_q"))
    return val.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c) for c in cols])
