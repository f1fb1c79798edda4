"""Joins, grids and pair kernels that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spectraloom.functions.session import attach, cut, shuffle_width, spread


#: levels up to which a row key carries all its cells in one record
FEW_LEVELS = 2_000


def complete_grid(df: DataFrame, row_keys: list[str], column: str, value: str, fill=None) -> DataFrame:
    """Every row key at every level of ``column``, missing cells null or ``fill``.

    Rows with a null level are left out; a null row key is a key like any other.
    A repeated (row, level) cell fails. The input is read once, into one row per
    cell. With up to ``FEW_LEVELS`` levels the cells of a row key are gathered
    and the levels it lacks added, in one exchange; with more, keys meet levels
    through a salt, so both sides stay hash-partitioned whatever their number.
    """
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"repeated cell of {column}")).cast(df.schema[value].dataType)).otherwise(F.first(value))
    cells = cut(df.where(F.col(column).isNotNull()).groupBy(*row_keys, column).agg(once.alias(value)))
    levels = cut(cells.select(column).distinct())
    count = levels.count()
    filled = lambda v: v if fill is None else F.coalesce(v, F.lit(fill))
    if 0 < count <= FEW_LEVELS:
        every = levels.agg(F.collect_list(column).alias("_every"))
        # at full width, so that what follows by the row keys finds the rows dealt out
        own = (spread(cells, *row_keys) if row_keys else cells).groupBy(*row_keys).agg(F.collect_list(F.struct(F.col(column).alias("level"), F.col(value).alias("value"))).alias("_own"))
        absent = F.array_except("_every", F.col("_own.level"))
        none = F.lit(None).cast(df.schema[value].dataType)
        whole = F.concat("_own", F.transform(absent, lambda x: F.struct(x.alias("level"), none.alias("value"))))
        rows = attach(own, every).select(*row_keys, F.explode(whole).alias("_cell"))
        return rows.select(*row_keys, F.col("_cell.level").alias(column), filled(F.col("_cell.value")).alias(value))
    salts = max(1, min(shuffle_width(df.sparkSession), count))
    left = cells.select(*row_keys).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = levels.withColumn("_salt", F.pmod(F.xxhash64(column), F.lit(salts)).cast("int"))
    grid = left.join(right, "_salt").drop("_salt")
    have = cells.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(row_keys)], F.col(column).alias("_level"), F.col(value).alias("_value"))
    same = F.col(column) == F.col("_level")
    for i, k in enumerate(row_keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return grid.join(have, same, "left").select(*row_keys, column, filled(F.col("_value")).alias(value))


def level_pairs(df: DataFrame, column: str, a: str = "a", b: str = "b", ordered: bool = False, groups: list[str] | None = None) -> DataFrame:
    """Pairs of levels (inside ``groups``): ``a < b``, or every ordered pair ``a != b``; levels meet through a salt, in any number."""
    groups = groups or []
    levels = cut(df.select(*groups, column).where(F.col(column).isNotNull()).distinct())
    pairs = meeting(levels.withColumnRenamed(column, a), levels.withColumnRenamed(column, b), a, b, groups)
    return pairs.where(F.col(a) != F.col(b) if ordered else F.col(a) < F.col(b))


def meeting(left: DataFrame, right: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """Every level ``a`` of ``left`` with every level ``b`` of ``right`` (inside ``groups``), through a salt."""
    groups = groups or []
    salts = max(1, min(shuffle_width(left.sparkSession), left.count()))
    one = left.select(*groups, a, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    two = right.select(*groups, b, F.pmod(F.xxhash64(b), F.lit(salts)).cast("int").alias("_salt"))
    return one.join(two, [*groups, "_salt"]).select(*groups, a, b)


def range_join(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None,
    inclusive: bool = True, how: str = "inner",
) -> DataFrame:
    """Points inside intervals, by bucketed equi-join then an exact test.

    Each interval is copied to the buckets it covers; each point lives in one
    bucket, so no pair is found twice.
    """
    on = on or []
    p = points.withColumn("_bucket", F.floor(F.col(point) / width))
    i = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    )
    for k in on:
        i = i.withColumnRenamed(k, f"_j_{k}")
    cond = p["_bucket"] == i["_bucket"]
    for k in on:
        cond = cond & (p[k] == i[f"_j_{k}"])
    inside = (p[point] >= i[low]) & (p[point] <= i[high]) if inclusive else (p[point] > i[low]) & (p[point] < i[high])
    out = p.join(i, cond & inside, how)
    return out.drop(p["_bucket"]).drop(i["_bucket"]).drop(*[f"_j_{k}" for k in on])


def nearest_join(
    left: DataFrame, right: DataFrame, on: list[str], at: str, right_cols: list[str], bucket: float, tie: str | None = None
) -> DataFrame:
    """Nearest right row for each left row on an ordered axis, per key.

    The axis is cut into buckets. Inside (key, bucket) a window finds the last
    right row before and the first after; the edge rows of other buckets are
    carried by a window over per-bucket summaries, so no key is sorted whole.
    Ties go to the smaller position, then to the smallest ``tie`` column.
    """
    lcols = left.columns
    payload = F.struct(F.col(at).cast("double").alias("_at"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(c).alias(c) for c in right_cols])
    r = right.where(F.col(at).isNotNull()).groupBy(*on, F.col(at).cast("double").alias("_pos")).agg(F.min(payload).alias("_fwd"))
    r = r.withColumn("_b", F.floor(F.col("_pos") / bucket))
    edges = r.groupBy(*on, "_b").agg(F.min("_fwd").alias("_first"), F.max_by("_fwd", "_pos").alias("_last"))
    lb = left.select(*on, F.floor(F.col(at).cast("double") / bucket).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    span = edges.join(lb, [*on, "_b"], "full")
    before = Window.partitionBy(*on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*on).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carry = span.select(
        *on, "_b", F.last("_last", ignorenulls=True).over(before).alias("_prev"), F.first("_first", ignorenulls=True).over(after).alias("_next")
    )
    both = left.select(
        *on, F.col(at).cast("double").alias("_pos"), F.floor(F.col(at).cast("double") / bucket).alias("_b"), F.lit(None).cast(r.schema["_fwd"].dataType).alias("_fwd"),
        F.struct(*lcols).alias("_l"),
    ).unionByName(r.select(*on, "_pos", "_b", "_fwd").withColumn("_l", F.lit(None).cast(left.select(F.struct(*lcols).alias("_l")).schema["_l"].dataType)))
    w = Window.partitionBy(*on, "_b").orderBy("_pos")
    near = both.select(
        *on, "_b", "_pos", "_l",
        F.last("_fwd", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("_lo"),
        F.first("_fwd", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("_hi"),
    ).where(F.col("_l").isNotNull())
    near = near.join(carry, [*on, "_b"], "left")
    lo, hi = F.coalesce("_lo", "_prev"), F.coalesce("_hi", "_next")
    dl, dh = F.abs(F.col("_pos") - lo["_at"]), F.abs(F.col("_pos") - hi["_at"])
    pick = F.when(hi["_at"].isNull() | (dl <= dh), lo).otherwise(hi)
    out = near.withColumn("_n", pick)
    return out.select(*[F.col("_l")[c].alias(c) for c in lcols], F.col("_n")["_at"].alias("nearest_at"), *[F.col("_n")[c].alias(c) for c in right_cols])


def distance_join(a: DataFrame, b: DataFrame, coords: list[str], radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs within ``radius``: grid cells, neighbour cells, exact filter.

    Both sides are dealt out by cell: a side that is small on disk may be large
    in rows, and broadcast it would pass through the driver and leave the pairs
    to as many tasks as the other side has files.

    Columns of ``b`` must already differ in name from those of ``a`` except the
    coordinates and ``on`` keys, which are suffixed ``_2``.
    """
    on = on or []
    cell = [F.floor(F.col(c) / radius) for c in coords]
    left = a.select("*", *[x.alias(f"_c{i}") for i, x in enumerate(cell)])
    right = b.select(*[F.col(c).alias(f"{c}_2") if c in coords or c in on else F.col(c) for c in b.columns])
    for i, c in enumerate(coords):
        base = F.floor(F.col(f"{c}_2") / radius)
        right = right.withColumn(f"_d{i}", F.explode(F.array(base - 1, base, base + 1)))
    cond = F.lit(True)
    for i in range(len(coords)):
        cond = cond & (F.col(f"_c{i}") == F.col(f"_d{i}"))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"{k}_2"))
    sq = sum(((F.col(c) - F.col(f"{c}_2")) * (F.col(c) - F.col(f"{c}_2")) for c in coords), F.lit(0.0))
    out = left.hint("merge").join(right, cond).withColumn("distance", F.sqrt(sq)).where(F.col("distance") <= radius)
    return out.drop(*[f"_c{i}" for i in range(len(coords))], *[f"_d{i}" for i in range(len(coords))], *[f"{k}_2" for k in on])


# --- column-by-column sums ------------------------------------------------------

#: columns up to which their numbers are sent to all tasks
FEW_NAMES = 20_000
#: columns of a tile: a task holds four square blocks of this size
TILE = 512
#: rows whose cells are added up into one block of sums before they are shuffled
TILE_ROWS = 200_000
GRAM_SCHEMA = "ia long, ib long, n double, sa double, sb double, saa double, sbb double, sab double"


def column_gram(df: DataFrame, row_keys: list[str], column: str, value: str, levels: list | None = None) -> DataFrame:
    """Pairwise-complete sums for every pair of columns.

    Returns ``a, b, n, sa, sb, saa, sbb, sab`` (``a <= b``) over the rows where
    both columns have a value. Columns are numbered and cut into tiles; a task
    multiplies the cells that some rows have in two tiles as dense matrices and
    emits one block of sums, so its memory is set by ``TILE`` whatever the
    number of columns. With a single tile the rows stay where they are. Given
    ``levels`` restrict the columns.
    """
    spark = df.sparkSession
    cells = df.where(F.col(value).isNotNull() & F.col(column).isNotNull())
    if levels is not None:
        names = spark.createDataFrame(list(enumerate(levels)), T.StructType([T.StructField("_i", T.LongType()), T.StructField("_name", df.schema[column].dataType)]))
    else:
        names = cut(dense_index(cells.select(F.col(column).alias("_name")).distinct(), "_name", "_i"))
    count = names.count()
    tiles = max(1, -(-count // TILE))
    if count <= FEW_NAMES:
        # a column may hold a share of all cells: by a shuffle on the column they would be one task's
        names = F.broadcast(names)
    numbered = cells.join(names, F.col(column) == F.col("_name"))
    keyed = numbered.groupBy(*row_keys, F.expr(f"cast(_i div {TILE} as int)").alias("_tile")).agg(
        F.collect_list((F.col("_i") % TILE).cast("int")).alias("i"), F.collect_list(F.col(value).cast("double")).alias("v")
    )
    if tiles == 1:
        sums = keyed.select(F.lit(0).alias("p"), F.lit(0).alias("q"), F.col("i").alias("ip"), F.col("v").alias("vp"), F.col("i").alias("iq"), F.col("v").alias("vq"))
    else:
        rows = keyed.groupBy(*row_keys).agg(F.array_sort(F.collect_list(F.struct("_tile", "i", "v"))).alias("t"))
        pair = F.explode(F.expr("flatten(transform(t, x -> transform(filter(t, y -> y._tile >= x._tile), y -> struct(x, y))))")).alias("z")
        parts = max(1, -(-keyed.count() // TILE_ROWS))
        sums = rows.select(pair, F.pmod(F.xxhash64(*row_keys), F.lit(parts)).alias("part"))
        sums = sums.select(F.col("z.x._tile").alias("p"), F.col("z.y._tile").alias("q"), "part", *[F.col(f"z.{s}.{c}").alias(f"{c}{t}") for s, t in (("x", "p"), ("y", "q")) for c in ("i", "v")])
        sums = sums.repartition(shuffle_width(spark), "p", "q", "part").sortWithinPartitions("p", "q").drop("part")
    sums = sums.mapInArrow(_tile_sums, GRAM_SCHEMA).groupBy("ia", "ib").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    na, nb = names.select(F.col("_i").alias("ia"), F.col("_name").alias("a")), names.select(F.col("_i").alias("ib"), F.col("_name").alias("b"))
    named = sums.join(na, "ia").join(nb, "ib")
    turned = F.col("a") > F.col("b")
    either = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    return named.select(
        either("a", "b").alias("a"), either("b", "a").alias("b"), "n", either("sa", "sb").alias("sa"), either("sb", "sa").alias("sb"),
        either("saa", "sbb").alias("saa"), either("sbb", "saa").alias("sbb"), "sab",
    )


def _dense(index: pa.Array, value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, m = np.zeros((len(index), TILE)), np.zeros((len(index), TILE))
    row = np.repeat(np.arange(len(index)), index.value_lengths().to_numpy(zero_copy_only=False))
    at = index.flatten().to_numpy(zero_copy_only=False)
    x[row, at] = value.flatten().to_numpy(zero_copy_only=False)
    m[row, at] = 1.0
    return x, m


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sums of runs of rows of one pair of tiles."""
    total, now = None, None

    def block() -> pa.RecordBatch:
        n, s, t, ss, tt, st = total
        ia, ib = np.nonzero(n)
        if now[0] == now[1]:
            ia, ib = ia[ia <= ib], ib[ia <= ib]
        return pa.record_batch([pa.array(now[0] * TILE + ia), pa.array(now[1] * TILE + ib), *(pa.array(x[ia, ib]) for x in (n, s, t, ss, tt, st))], names=[c.split()[0] for c in GRAM_SCHEMA.split(", ")])

    for batch in batches:
        p, q = batch.column("p").to_numpy(), batch.column("q").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1, [len(p)]]) if len(p) else np.zeros(1, int)
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if now != (int(p[start]), int(q[start])):
                if total is not None:
                    yield block()
                total, now = np.zeros((6, TILE, TILE)), (int(p[start]), int(q[start]))
            for at in range(start, stop, 1024):
                part = batch.slice(at, min(1024, stop - at))
                x, mx = _dense(part.column("ip"), part.column("vp"))
                y, my = (x, mx) if now[0] == now[1] else _dense(part.column("iq"), part.column("vq"))
                for i, (left, right) in enumerate(((mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y))):
                    total[i] += left.T @ right
    if total is not None:
        yield block()


def correlation_from_sums(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson r; null when either side does not vary."""
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    ok = (n > 1) & (va > 1e-12 * n * saa) & (vb > 1e-12 * n * sbb)
    return F.when(ok, (n * sab - sa * sb) / F.sqrt(va * vb))


# --- all pairs of rows, in balanced blocks --------------------------------------

def blocked_pairs(
    df: DataFrame,
    groups: list[str],
    key: str,
    payload: str,
    score: Callable[[list, list], np.ndarray],
    threshold: float | None,
    block_rows: int = 1024,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Scores of all pairs ``a < b`` inside each group, kept at ``>= threshold``.

    Columns to ``carry`` come with both sides, as ``a_`` and ``b_`` and their
    names, so that pairs need not meet their rows again.

    Rows are hashed into blocks of about ``block_rows``; every pair of blocks is
    one task group of bounded size, so a group holding a third of all rows is
    spread over many tasks. ``score(left, right)`` returns a dense block of
    scores; pairs under the threshold never become rows.
    """
    sizes = df.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nb"))
    d = df.select(*groups, key, payload, *carry)
    d = d.join(sizes, groups) if groups else attach(d, sizes)
    d = d.withColumn("_b", F.pmod(F.xxhash64(key), F.col("_nb")).cast("int"))
    d = d.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    d = d.select(*groups, key, payload, *carry, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    key_type = df.schema[key].dataType.simpleString()
    group_schema = "".join(f"`{g}` {df.schema[g].dataType.simpleString()}, " for g in groups)
    schema = f"{group_schema}a {key_type}, b {key_type}, score double" + "".join(f", `{side}_{c}` {df.schema[c].dataType.simpleString()}" for c in carry for side in "ab")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        left = pdf[pdf["_b"] == i]
        right = pdf[pdf["_b"] == j]
        if i == j:
            right = left
        s = score(list(left[payload]), list(right[payload]))
        mask = np.ones_like(s, bool) if threshold is None else s >= threshold
        mask &= ~np.isnan(s)
        if i == j:
            mask &= np.triu(np.ones_like(mask), 1)
        r, c = np.nonzero(mask)
        ka, kb = left[key].to_numpy()[r], right[key].to_numpy()[c]
        swap = ka > kb
        out = pd.DataFrame({"a": np.where(swap, kb, ka), "b": np.where(swap, ka, kb), "score": s[r, c]})
        for name in carry:
            va, vb = left[name].to_numpy()[r], right[name].to_numpy()[c]
            out[f"a_{name}"], out[f"b_{name}"] = np.where(swap, vb, va), np.where(swap, va, vb)
        for pos, g in enumerate(groups):
            out.insert(pos, g, pdf[g].iloc[0])
        return out

    return spread(d, *groups, "_i", "_j").groupBy(*groups, "_i", "_j").applyInPandas(pairs, schema)


def shared_counts(members: DataFrame, groups: list[str], key: str, item: str, others: DataFrame | None = None) -> DataFrame:
    """``a, b, shared`` of every two keys (inside groups) with an item in common: ``a < b``, or keys of ``others`` as ``b``.

    An inverted index: rows meet on the item, so only pairs with something in
    common are ever formed; a frequent item is a skewed join key, which adaptive
    execution splits. Repeated members count once.
    """
    one = members.select(*groups, F.col(key).alias("a"), item).distinct()
    two = (others if others is not None else members).select(*groups, F.col(key).alias("b"), item).distinct()
    met = one.join(two, [*groups, item])
    met = met if others is not None else met.where(F.col("a") < F.col("b"))
    return met.groupBy(*groups, "a", "b").agg(F.count("*").alias("shared"))


def similar_sets(members: DataFrame, key: str, item: str, threshold: float, overlap: bool = False) -> DataFrame:
    """``a < b, score``: sets whose Jaccard index (or overlap coefficient) is at least ``threshold`` > 0.

    Items are ordered from rare to frequent. Two sets that are alike enough have
    an item in common among the first few of both (for the overlap coefficient:
    the first few of the smaller set), so candidates come from an index on those
    prefixes, cut by the sizes, and only candidates are compared, as sorted
    arrays of item numbers. Null keys and items are left out, repeats count once.
    """
    once = cut(members.select(F.col(key).alias("key"), F.col(item).alias("item")).where("key is not null and item is not null").distinct())
    often = once.groupBy("item").agg(F.count("*").alias("often"))
    numbered = dense_index(often, "item", "id").select("item", F.struct("often", "id").alias("o"))
    sets = once.join(numbered, "item").groupBy("key").agg(F.array_sort(F.collect_list("o")).alias("o"))
    sets = cut(sets.select("key", F.transform("o", lambda x: x["id"]).alias("ids"), F.size("o").alias("n")))
    few = (F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1e-9)) + 1).cast("int")
    small = sets.select(F.col("key").alias("s"), F.col("n").alias("ns"), F.explode(F.slice("ids", F.lit(1), few)).alias("id"))
    large = sets.select(F.col("key").alias("t"), F.col("n").alias("nt"), F.explode(F.col("ids") if overlap else F.slice("ids", F.lit(1), few)).alias("id"))
    # the smaller set is s; of equal sizes the one that sorts first
    turn = (F.col("ns") < F.col("nt")) | ((F.col("ns") == F.col("nt")) & (F.col("s") < F.col("t")))
    if not overlap:
        turn = turn & (F.col("ns") >= F.col("nt") * threshold - 1e-9)
    candidates = small.join(large, "id").where(turn).select("s", "t").distinct()
    both = candidates.join(sets.select(F.col("key").alias("s"), F.col("ids").alias("_s"), F.col("n").alias("ns")), "s")
    both = both.join(sets.select(F.col("key").alias("t"), F.col("ids").alias("_t"), F.col("n").alias("nt")), "t")
    shared = F.size(F.array_intersect("_s", "_t")).cast("double")
    score = shared / (F.col("ns") if overlap else F.col("ns") + F.col("nt") - shared)
    return both.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), score.alias("score")).where(F.col("score") >= threshold)


def vector_dot(left: list, right: list) -> np.ndarray:
    """Dot products of equally long vectors."""
    if not left or not right:
        return np.zeros((len(left), len(right)))
    return np.stack(left).astype(float) @ np.stack(right).astype(float).T


# --- positions and seeded permutations ------------------------------------------

def dense_index(df: DataFrame, key: str, out: str, keys: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """Number rows (unique ``key`` inside ``keys``) 0..n-1 in a hash order, without sorting a whole group."""
    keys = keys or []
    d = df.withColumn("_hb", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counts = d.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_hb", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_hb").orderBy(key)
    return d.join(offsets, [*keys, "_hb"]).withColumn(out, F.col("_off") + F.row_number().over(inside) - 1).drop("_hb", "_off")


@F.pandas_udf(T.LongType())
def permuted_index(i: pd.Series, seed: pd.Series, n: pd.Series) -> pd.Series:
    """Position of ``i`` in a keyed pseudo-random permutation of 0..n-1."""
    return pd.Series(permuted_places(i.to_numpy(np.uint64), seed.to_numpy(np.int64), n.to_numpy(np.uint64)))


def permuted_places(i: np.ndarray, seed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``permuted_index`` of arrays; ``size`` may be one number.

    A four-round Feistel network with cycle walking: a bijection for every
    seed, computed per row, so shuffling needs no sort.
    """
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size.astype(float), 2.0)))).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = seed.astype(np.uint64)

    def rounds(x: np.ndarray, at=slice(None)) -> np.ndarray:
        shift, low, own = (half[at], mask[at], key[at]) if size.ndim else (half, mask, key[at])
        left, right = x >> shift, x & low
        for r in range(4):
            with np.errstate(over="ignore"):
                h = (right + np.uint64(0x9E3779B97F4A7C15) * np.uint64(r + 1)) ^ own
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
            left, right = right, (left ^ h) & low
        return (left << shift) | right

    x = rounds(i)
    outside = np.flatnonzero(x >= size)
    while len(outside):
        x[outside] = rounds(x[outside], outside)
        outside = outside[x[outside] >= (size[outside] if size.ndim else size)]
    return x.astype(np.int64)


def permuted_sets(i: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """``permuted_places`` of the same places under every seed, a row a seed.

    What a round adds depends on half of the bits only: where these are few, it
    is worked out once per seed and looked up for each place.
    """
    half = (max(2, int(np.ceil(np.log2(max(size, 2))))) + 1) // 2
    n, wide = len(seeds), 1 << half
    if wide > 2 * len(i):
        return permuted_places(np.tile(i, n), np.repeat(seeds, len(i)), np.uint64(size)).reshape(n, len(i))
    with np.errstate(over="ignore"):
        turns = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, 5, dtype=np.uint64)
        h = (np.arange(wide, dtype=np.uint64)[None, :] + turns[:, None])[None, :, :] ^ seeds.astype(np.uint64)[:, None, None]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        added = ((h ^ (h >> np.uint64(31))) & np.uint64(wide - 1)).astype(np.intp).transpose(1, 0, 2).reshape(4, n * wide)

    def rounds(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # both halves lie above their seed's place in the tables, which the rounds leave alone
        for table in added:
            left, right = right, left ^ table.take(right)
        return left, right

    place = i.astype(np.intp)
    base = np.arange(n, dtype=np.intp)[:, None] * wide
    left, right = rounds((base + (place >> half)).ravel(), (base + (place & (wide - 1))).ravel())
    x = ((left & (wide - 1)) << half) | (right & (wide - 1))
    outside = np.flatnonzero(x >= size)
    left, right = left[outside], right[outside]
    while len(outside):
        left, right = rounds(left, right)
        y = ((left & (wide - 1)) << half) | (right & (wide - 1))
        x[outside] = y
        on = np.flatnonzero(y >= size)
        outside, left, right = outside[on], left[on], right[on]
    return x.reshape(n, len(i)).astype(np.int64, copy=False)
