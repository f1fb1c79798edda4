"""Ranks, running totals, quantiles and p-value adjustment without one-task sorts.

A window over a group that holds a third of all rows would sort that group in a
single task. Everything here first reduces rows to one per (group, value) with a
map-side combine. When that table is still large, the value range is cut into
buckets at sampled bounds, the window runs inside (group, bucket) and the bucket
totals, which are few, are added.

Inputs are written once to the checkpoint folder: results are joined back on the
value, and a value that comes from floating sums may differ when computed twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from spectraloom.functions.columns import first_row
from spectraloom.functions.session import attach, cut, shuffle_width

# distinct (group, value) rows up to which one window task is no burden
SMALL = 250_000
#: groups whose one row each is sent to all tasks, so that a group with a share of all rows is not one task's
FEW_GROUPS = 20_000


def _bucketed(df: DataFrame, value: str, buckets: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``_v`` and its bucket ``_b``; False when one bucket is enough."""
    d = df.withColumn("_v", F.col(value).cast("double"))
    if buckets is None and (rows := d.count()) <= SMALL:
        return d.withColumn("_b", F.lit(0.0)), False
    n = buckets or max(4, 2 * shuffle_width(df.sparkSession), 2 * rows // SMALL)
    splits = sorted(set(d.select(F.percentile_approx("_v", [i / n for i in range(1, n)], 20 * n)).first()[0] or []))
    if not splits:
        return d.withColumn("_b", F.lit(0.0)), False
    return Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_v", outputCol="_b").transform(d), True


def _running(d: DataFrame, split: bool, keys: list[str], aggs: dict[str, tuple[str, str]], descending: bool) -> DataFrame:
    """Add running aggregates ``{out: (function, column)}`` over bucketed rows."""
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    order = F.col("_v").desc() if descending else F.col("_v").asc()
    local = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if not split:
        return d.select("*", *[kinds[k](c).over(local).alias(o) for o, (k, c) in aggs.items()])
    border = F.col("_b").desc() if descending else F.col("_b").asc()
    before = Window.partitionBy(*keys).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_b").agg(*[kinds[k](c).alias(o) for o, (k, c) in aggs.items()])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"), *[kinds[k](o).over(before).alias(f"_off_{o}") for o, (k, _) in aggs.items()]
    )
    d = d.select("*", *[kinds[k](c).over(local).alias(o) for o, (k, c) in aggs.items()])
    cond = F.col("_b") == F.col("_bb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    d = d.join(offsets, cond, "inner")
    join = {"sum": lambda o: F.col(o) + F.coalesce(f"_off_{o}", F.lit(0)), "max": lambda o: F.greatest(o, f"_off_{o}"), "min": lambda o: F.least(o, f"_off_{o}")}
    d = d.withColumns({o: join[k](o) for o, (k, _) in aggs.items()})
    return d.drop("_bb", *[f"_k_{k}" for k in keys], *[f"_off_{o}" for o in aggs])


def running_totals(
    df: DataFrame, keys: list[str], value: str, sums: list[str] | None = None, maxima: list[str] | None = None, mins: list[str] | None = None,
    descending: bool = False, buckets: int | None = None,
) -> DataFrame:
    """Running sums / maxima / minima by ``value`` inside ``keys``.

    ``df`` holds one row per (keys, value), value not null. Each ``x`` named
    gains ``x_run`` (inclusive).
    """
    named = [("sum", c) for c in sums or []] + [("max", c) for c in maxima or []] + [("min", c) for c in mins or []]
    d, split = _bucketed(df, value, buckets)
    d = _running(d, split, keys, {f"{c}_run": (k, c) for k, c in named}, descending)
    return d.select(*df.columns, *[f"{c}_run" for _, c in named])


def _ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))


def rank_table(df: DataFrame, keys: list[str], value: str, descending: bool = False) -> DataFrame:
    """One row per (keys, value): ``ties``, ``rank_min``, ``rank_max``, ``rank_avg``."""
    run = running_totals(_ties(df, keys, value), keys, value, sums=["ties"], descending=descending)
    return run.select(
        *keys, value, "ties", (F.col("ties_run") - F.col("ties") + 1).alias("rank_min"), F.col("ties_run").alias("rank_max"),
        (F.col("ties_run") - (F.col("ties") - 1) / 2).alias("rank_avg"),
    )


def _join_back(df: DataFrame, table: DataFrame, keys: list[str], value: str, outs: list[str]) -> DataFrame:
    t = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_w"), *outs)
    cond = F.col(value) == F.col("_w")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(t, cond, "left").drop("_w", *[f"_k_{k}" for k in keys])


def add_rank(df: DataFrame, keys: list[str], value: str, out: str, method: str = "min", descending: bool = False) -> DataFrame:
    """Rank with ties min, max or average; null and NaN values get a null rank."""
    df = cut(df)
    return _join_back(df, rank_table(df, keys, value, descending).withColumnRenamed(f"rank_{method}", out), keys, value, [out])


def p_adjust_bh(df: DataFrame, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg inside each ``by`` group; null p stays null and is not counted."""
    by = by or []
    df = cut(df)
    n = df.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    ties = _ties(df, by, p)
    d, split = _bucketed(ties.join(n, by) if by else attach(ties, n), p)
    d = _running(d, split, by, {"_rank": ("sum", "ties")}, False).withColumn("_q", F.col("_v") * F.col("_n") / F.col("_rank"))
    d = _running(d, split, by, {"_adj": ("min", "_q")}, True)
    return _join_back(df, d.withColumn(out, F.least("_adj", F.lit(1.0))), by, p, [out])


#: bits of the values that a round of the radix selection looks at
RADIX_BITS = 12


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, prob: float, out: str, accuracy: int = 10_000, stable: bool = False
) -> DataFrame:
    """Exact interpolated quantile (type 7) per group, safe for a huge group.

    A mergeable sketch brackets the quantile; one more pass counts the rows
    below the bracket and sorts only the distinct values inside it, about
    4/accuracy of the group. Groups whose rank falls outside the bracket are
    selected by radix instead. ``stable`` says the values read the same twice
    (no floating sums behind them), so they need not be written first.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    d = d if stable else cut(d)
    pad = 2.0 / accuracy
    low, high = max(0.0, prob - pad), min(1.0, prob + pad)
    sketch = d.groupBy(*keys).agg(
        F.percentile_approx("_v", [low, high], accuracy).alias("_q"), F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    sketch = sketch.select(
        # a group whose padding spans under four ranks is small enough to sort whole
        *keys, "_n", F.when((F.lit(low) * F.col("_n") <= 2) | (F.col("_n") * pad < 4), F.col("_min")).otherwise(F.col("_q")[0]).alias("_lo"),
        F.when((F.lit(1.0 - high) * F.col("_n") <= 2) | (F.col("_n") * pad < 4), F.col("_max")).otherwise(F.col("_q")[1]).alias("_hi"),
    )
    joined = _beside(d, sketch, keys)
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counted = joined.where(F.col("_v") <= F.col("_hi")).groupBy(*keys, inside.alias("_x")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    seen = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    target = (F.col("_n") - 1) * F.lit(prob)
    ranked = counted.withColumn("_seen", F.sum("_c").over(seen))
    picked = ranked.groupBy(*keys).agg(
        F.first("_n").alias("_n"),
        F.max(F.when(F.col("_x").isNull(), F.col("_seen"))).alias("_below"),
        F.min(F.when(F.col("_seen") > F.floor(target), F.col("_x"))).alias("_a"),
        F.min(F.when(F.col("_seen") > F.ceil(target), F.col("_x"))).alias("_z"),
    )
    ok = (F.coalesce("_below", F.lit(0)) <= F.floor(target)) & F.col("_z").isNotNull()
    picked = cut(picked.withColumn("_ok", ok))
    frac = target - F.floor(target)
    done = picked.where("_ok").select(*keys, (F.col("_a") + frac * (F.col("_z") - F.col("_a"))).alias(out))
    if picked.where("not _ok").isEmpty():
        return done
    rest = d.join(picked.where("not _ok").select(*keys), keys, "left_semi") if keys else d
    return done.unionByName(radix_quantile(rest, keys, "_v", prob, out))


def _beside(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` with the one row of their group; up to ``FEW_GROUPS`` groups go to the rows, which stay where they are."""
    if not keys:
        return attach(df, per_group)
    per_group = cut(per_group)
    return df.join(F.broadcast(per_group) if per_group.count() <= FEW_GROUPS else per_group, keys)


@F.pandas_udf(LongType())
def _sortable(v: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles: their bits, turned round below zero."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def radix_quantile(df: DataFrame, keys: list[str], value: str, prob: float, out: str) -> DataFrame:
    """Exact quantile (type 7) by radix selection on the bits of the values.

    The values behind the two ranks around the quantile are selected each. A
    round counts the values of the prefix that holds the rank by their next
    ``RADIX_BITS`` bits, one aggregate of at most 2^RADIX_BITS rows a group, so
    any distribution ends after six rounds, or when a prefix has one value.
    """
    d = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    d = cut(d.withColumn("_u", _sortable("_v")))
    total = cut(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    target = (F.col("_n") - 1) * F.lit(prob)
    ids = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(i) for k, i in zip(keys, ids, strict=True)]
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor(target).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(target).alias("rank")))).alias("w")
    want = total.where("_n > 0").select(*named, sides).select(*ids, "w.side", "w.rank", F.lit(0).cast("long").alias("_prefix"))
    found, shift = None, 64
    while shift:
        before, shift = shift, max(0, shift - RADIX_BITS)
        same = F.lit(0).cast("long") == F.col("_prefix") if before == 64 else F.shiftright("_u", before) == F.col("_prefix")
        for k, i in zip(keys, ids, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(i))
        hist = d.join(want, same).groupBy(*ids, "side", "rank", F.shiftright("_u", shift).alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*ids, "side", "rank").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_upto", F.sum("_c").over(upto))
        inside = cut(hist.where((F.col("_upto") > F.col("rank")) & (F.col("_upto") - F.col("_c") <= F.col("rank"))))
        settled = inside.where("_lo = _hi").select(*ids, "side", F.col("_lo").alias("_x"))
        found = settled if found is None else found.unionByName(settled)
        want = inside.where("_lo < _hi").select(*ids, "side", (F.col("rank") - (F.col("_upto") - F.col("_c"))).alias("rank"), F.col("_p").alias("_prefix"))
        if want.isEmpty():
            break
    pair = found.groupBy(*ids).agg(F.max(F.when(F.col("side") == 0, F.col("_x"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_x"))).alias("_z"))
    cond = F.lit(True)
    for k, i in zip(keys, ids, strict=True):
        cond = cond & F.col(k).eqNullSafe(F.col(i))
    whole = total.join(pair, cond) if keys else attach(total, pair)
    frac = target - F.floor(target)
    return whole.select(*keys, F.when(frac == 0, F.col("_a")).otherwise(F.col("_a") + frac * (F.col("_z") - F.col("_a"))).alias(out))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, stable: bool = False) -> DataFrame:
    return exact_quantile(df, keys, value, 0.5, out, stable=stable)


def mad(df: DataFrame, keys: list[str], value: str, out: str, center: str = "median", stable: bool = False) -> DataFrame:
    """``1.4826 * median(abs(x - median))`` together with the median."""
    d = df.select(*keys, value)
    d = d if stable else cut(d)
    med = cut(exact_median(d, keys, value, center, stable=True))
    joined = _beside(d, med, keys)
    dev = joined.select(*keys, F.abs(F.col(value) - F.col(center)).alias("_d"))
    spread = exact_quantile(dev, keys, "_d", 0.5, "_m", stable=True)
    out_df = spread.join(med, keys) if keys else attach(spread, med)
    return out_df.select(*keys, center, (F.col("_m") * 1.4826).alias(out))


def ecdf_table(control: DataFrame, queries: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Share of control values <= each value of either side, one row per (keys, value); ``queries`` read the same twice."""
    control = cut(control.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")))
    asked = queries.where(F.col(value).isNotNull()).select(*keys, value, F.lit(0).cast("bigint").alias("c"))
    # read several times by the running totals
    both = cut(control.unionByName(asked).groupBy(*keys, value).agg(F.sum("c").alias("c")))
    run = running_totals(both, keys, value, sums=["c"])
    total = control.groupBy(*keys).agg(F.sum("c").alias("_n"))
    run = run.join(total, keys) if keys else attach(run, total)
    return run.select(*keys, value, (F.col("c_run") / F.col("_n")).alias(out))


def ecdf(control: DataFrame, queries: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Share of control values <= each query value."""
    queries = cut(queries)
    return _join_back(queries, ecdf_table(control, queries, keys, value, out), keys, value, [out])


def best_per_group(df: DataFrame, keys: list[str], score: Column, ties: list[Column], largest: bool = True) -> DataFrame:
    """Row with the best score; ties broken by the given columns ascending."""
    return first_row(df, keys, [(-score if largest else score), *ties])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark's window group limit prunes on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def add_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number rows 1.. in a total order: range partitions, numbered inside, plus the rows of the partitions before."""
    t = cut(df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    ahead = t.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    ahead = ahead.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return t.withColumn("_at", inside).join(ahead, "_part").select(*df.columns, (F.col("_ahead") + F.col("_at")).alias(out))
