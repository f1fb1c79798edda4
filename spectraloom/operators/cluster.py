"""Exact agglomerative clustering of sparse pair tables."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.session import cut, spread


#: pairs of a component that one task holds as arrays
LOCAL_LINKS = 1_000_000


def complete_linkage(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, cluster`` of complete linkage cut at the largest distance in ``pairs``.

    ``pairs`` (``a < b, dist``) lists every pair at or under the cut; a pair not
    listed is farther. Clusters that are each other's nearest merge in the same
    round, which complete linkage allows because merging two clusters never
    brings a third one closer. A merged pair survives only if all its member
    pairs were listed, and takes the largest distance. Ties go to the smallest
    labels. Labels are the smallest member. Nodes of different components of
    ``pairs`` never meet, so components of up to ``LOCAL_LINKS`` pairs go through
    their rounds inside a task; the others go through them as tables.
    """
    from spectraloom.operators.graph import connected_components

    link = cut(pairs.select("a", "b", "dist"))
    if link.isEmpty():
        return nodes.select("node", F.col("node").alias("cluster")).distinct()
    part = cut(connected_components(link.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("a"), "component"))
    size = cut(link.join(part, "a").groupBy("component").agg(F.count(F.lit(1)).alias("_n")))
    small = part.join(size.where(F.col("_n") <= LOCAL_LINKS), "component").select("a", "component")
    inside = spread(link.join(small, "a"), "component").groupBy("component")
    kind = nodes.schema["node"].dataType.simpleString()
    merged = cut(inside.applyInPandas(lambda pdf: _rounds(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["dist"].to_numpy(float)), f"node {kind}, cluster {kind}"))
    large = size.where(F.col("_n") > LOCAL_LINKS)
    if large.isEmpty():
        every = nodes.select("node").distinct().join(merged, "node", "left")
        return every.select("node", F.coalesce("cluster", "node").alias("cluster"))
    rest = part.join(large, "component").select("a")
    d = _rounds_of_tables(link.join(rest, "a", "left_semi"), nodes)
    return d.join(merged.withColumnRenamed("cluster", "_local"), "node", "left").select("node", F.coalesce("_local", "cluster").alias("cluster"))


def _rounds(a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> pd.DataFrame:
    """``node, cluster`` of one component: the rounds of ``complete_linkage`` on arrays, labels as their ranks."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    k, n = len(names), len(a)
    a, b = np.minimum(at[:n], at[n:]), np.maximum(at[:n], at[n:])
    cluster = np.arange(k)
    while len(a):
        order = np.lexsort((b, a, dist))
        a, b, dist = a[order], b[order], dist[order]
        # the first link of every cluster in the order of the links
        near = np.full(k, len(a))
        np.minimum.at(near, np.concatenate([a, b]), np.tile(np.arange(len(a)), 2))
        own = np.arange(len(a))
        pick = (near[a] == own) & (near[b] == own)
        into, weight = np.arange(k), np.ones(k, np.int64)
        into[b[pick]] = a[pick]
        weight[a[pick]] = 2
        cluster = into[cluster]
        x, y = into[a], into[b]
        other = x != y
        x, y, dist = np.minimum(x, y)[other], np.maximum(x, y)[other], dist[other]
        _, first, back, count = np.unique(x * k + y, return_index=True, return_inverse=True, return_counts=True)
        far = np.full(len(first), -np.inf)
        np.maximum.at(far, back, dist)
        a, b = x[first], y[first]
        full = count == weight[a] * weight[b]
        a, b, dist = a[full], b[full], far[full]
    return pd.DataFrame({"node": names, "cluster": names[cluster]})


def _rounds_of_tables(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    link = cut(pairs.select("a", "b", "dist"))
    member = cut(nodes.select("node", F.col("node").alias("cluster")).distinct())
    while True:
        if link.isEmpty():
            return member
        order = F.struct("dist", "a", "b")
        near = link.select(F.explode(F.array("a", "b")).alias("c"), order.alias("o")).groupBy("c").agg(F.min("o").alias("o"))
        merge = near.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select(F.col("o.a").alias("into"), F.col("o.b").alias("gone"))
        merge = cut(merge)
        grown = merge.select(F.col("into").alias("big"))
        ga, gb = merge.select(F.col("gone").alias("a"), F.col("into").alias("_ia")), merge.select(F.col("gone").alias("b"), F.col("into").alias("_ib"))
        moved = link.join(ga, "a", "left").join(gb, "b", "left").select(F.coalesce("_ia", "a").alias("x"), F.coalesce("_ib", "b").alias("y"), "dist")
        moved = moved.where(F.col("x") != F.col("y")).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
            F.max("dist").alias("dist"), F.count(F.lit(1)).alias("n")
        )
        ma, mb = grown.select(F.col("big").alias("a"), F.lit(2).alias("_wa")), grown.select(F.col("big").alias("b"), F.lit(2).alias("_wb"))
        full = F.col("n") == F.coalesce("_wa", F.lit(1)) * F.coalesce("_wb", F.lit(1))
        link = cut(moved.join(ma, "a", "left").join(mb, "b", "left").where(full).select("a", "b", "dist"))
        member = cut(member.join(merge.withColumnRenamed("gone", "cluster"), "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster")))


def average_linkage(pairs: DataFrame, missing: float | None = None) -> DataFrame:
    """Merges ``into, gone, height, size`` of average linkage over ``pairs`` (``a < b, dist``).

    Two clusters are as far apart as their member pairs on average; a pair that
    is not listed counts with ``missing`` (by default the largest distance
    listed). Clusters that are each other's nearest merge in the same round,
    which average linkage allows because a merged pair is never nearer to a
    third cluster than the nearer of the two was. What a round keeps is one row
    per two clusters with a listed pair between them: the sum and the number of
    the listed distances. Ties go to the smallest labels; a cluster is labelled
    by its smallest member. Clusters without a listed pair between them stay
    apart.
    """
    if missing is None:
        missing = pairs.agg(F.max("dist")).first()[0] or 0.0
    link = cut(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("dist").alias("sum"), F.count("*").alias("n")).where("a <> b"))
    size = cut(link.select("a").union(link.select("b")).distinct().select(F.col("a").alias("node"), F.lit(1).cast("bigint").alias("size")))
    merges, turn = None, 0
    while not link.isEmpty():
        sa, sb = size.select(F.col("node").alias("a"), F.col("size").alias("_na")), size.select(F.col("node").alias("b"), F.col("size").alias("_nb"))
        both = F.col("_na") * F.col("_nb")
        apart = cut(link.join(sa, "a").join(sb, "b").withColumn("dist", (F.col("sum") + (both - F.col("n")) * missing) / both))
        order = F.struct("dist", "a", "b")
        near = apart.select(F.explode(F.array("a", "b")).alias("c"), order.alias("o"), (F.col("_na") + F.col("_nb")).alias("size")).groupBy("c").agg(F.min_by(F.struct("o", "size"), "o").alias("o"))
        merge = near.groupBy("o").agg(F.count("*").alias("k")).where("k = 2")
        merge = cut(merge.select(F.col("o.o.a").alias("into"), F.col("o.o.b").alias("gone"), F.col("o.o.dist").alias("height"), F.col("o.size").alias("size")))
        merges = merge if merges is None else merges.unionByName(merge)
        ga, gb = merge.select(F.col("gone").alias("a"), F.col("into").alias("_ia")), merge.select(F.col("gone").alias("b"), F.col("into").alias("_ib"))
        moved = link.join(ga, "a", "left").join(gb, "b", "left").select(F.coalesce("_ia", "a").alias("x"), F.coalesce("_ib", "b").alias("y"), "sum", "n").where("x <> y")
        link = cut(moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")))
        grown = merge.select(F.col("into").alias("node"), F.col("size").alias("_s"))
        left = size.join(merge.select(F.col("gone").alias("node")), "node", "left_anti").join(grown, "node", "left")
        size = cut(left.select("node", F.coalesce("_s", "size").alias("size")))
    return merges if merges is not None else link.select(F.col("a").alias("into"), F.col("b").alias("gone"), F.col("sum").alias("height"), F.col("n").alias("size"))


def linkage_on_line(points: DataFrame, keys: list[str], at: str, max_distance: float, out: str, bucket: float | None = None) -> DataFrame:
    """Complete linkage of positions on a line, per key, cut at ``max_distance``.

    No cluster spans a gap wider than the cut, so a key falls into islands that
    are linked on their own. Islands are found without sorting a key whole:
    positions lie in buckets of at least the cut's width, a bucket sorts its
    own, and only the first and last position of every bucket meet in a window.
    Numbers of clusters count along the line from one.
    """
    width = bucket if bucket is not None else max_distance * 64
    d = points.withColumn("_b", F.floor(F.col(at) / width))
    inner = Window.partitionBy(*keys, "_b").orderBy(at)
    gap = (F.col(at) - F.lag(at).over(inner)) > max_distance
    d = cut(d.withColumn("_i", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0))))
    ends = d.groupBy(*keys, "_b").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_i").alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_b")
    # islands before a bucket's first one: a bucket that goes on from the one before does not begin a new one
    starts = F.coalesce((F.col("_first") - F.lag("_last").over(line) > max_distance).cast("int"), F.lit(0))
    before = F.coalesce(F.sum(F.col("_n")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumns({"_start": starts, "_before": before})
    ends = ends.withColumn("_off", F.col("_before") + F.sum("_start").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.lit(True)
    for i, k in enumerate(["_b", *keys]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    offsets = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(["_b", *keys])], "_off")
    d = d.join(offsets, same).withColumn("_g", (F.col("_i") + F.col("_off")).cast("bigint"))
    columns = points.columns

    @F.arrow_udf("array<int>")
    def link(places: pa.Array) -> pa.Array:
        start = np.concatenate([[0], np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False).astype(int))])
        flat = places.flatten().to_numpy(zero_copy_only=False)
        out = np.empty(len(flat), np.int32)
        for lo, hi in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            order = np.argsort(flat[lo:hi], kind="stable")
            out[lo + order] = line_clusters(flat[lo:hi][order], max_distance)
        return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(out))

    # an island is one record, so a task links many in one call
    isles = spread(d.select(F.struct(*columns).alias("_row"), F.col(at).cast("double").alias("_at"), *keys, "_g"), *keys, "_g").groupBy(*keys, "_g").agg(F.collect_list(F.struct("_row", "_at")).alias("_l"))
    isles = isles.select("_g", F.explode(F.arrays_zip(F.col("_l._row").alias("row"), link("_l._at").alias("c"))).alias("_x"))
    linked = cut(isles.select("_x.row.*", F.col("_x.c").alias("_c"), "_g"))
    per = linked.groupBy(*keys, "_g").agg((F.max("_c") + 1).alias("_n"))
    upto = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(["_g", *keys])], F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    same = F.lit(True)
    for i, k in enumerate(["_g", *keys]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return linked.join(upto, same).withColumn(out, (F.col("_off") + F.col("_c") + 1).cast("int")).select(*columns, out)


def line_clusters(x: np.ndarray, max_distance: float) -> np.ndarray:
    """Cluster numbers of sorted positions under complete linkage cut at a distance.

    Only neighbours ever merge. Spans of neighbouring clusters wait in a heap;
    an entry whose clusters have changed since is skipped, so n merges cost
    n log n. The smallest span merges first, of equal ones the leftmost.
    """
    n = len(x)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    right, alive, version = x.tolist(), [True] * n, [0] * n
    heap = [(x[i + 1] - x[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        span, i, own, other = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or version[i] != own or version[j] != other:
            continue
        if span > max_distance:
            break
        right[i], after[i], alive[j] = right[j], after[j], False
        version[i] += 1
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (right[after[i]] - x[i], i, version[i], version[after[i]]))
        if before[i] >= 0:
            k = before[i]
            heapq.heappush(heap, (right[i] - x[k], k, version[k], version[i]))
    return (np.cumsum(alive) - 1).astype("int32")
