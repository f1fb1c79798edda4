"""Propagation of node scores over a network, with permutation tests.

The operator is ``S = pr (I - (1 - pr) A D^-1)^-1``; it is never formed. A
permutation test applies it to thousands of permuted score vectors, so the work
is split by permutation: a network of at most ``NETWORK_EDGES`` edges (counted
first; 8 bytes an edge and direction) goes to every task as sorted index arrays,
and a task walks blocks of permutations as one matrix. A larger network stays a
table and the permutations walk as keyed rows (``graph.random_walk``), which
draws other permutations of the same distribution.

Self heat, the diagonal of S, needs powers of the walk only to half their
number: with ``N = D^-1/2 A D^-1/2`` the diagonal of ``N^(j+k)`` at v is
``<N^j e_v, N^k e_v>``. So a walk from v stops in half the rounds, and no pair
of nodes is ever a result row.

Scores given twice for a node count as their maximum, nodes without a score
have zero, scores outside the network are left out, as are loops and repeated
edges. Null scores and nodes are left out too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import ratio
from spectraloom.functions.ordered import p_adjust_bh
from spectraloom.functions.session import attach, cut, shuffle_width
from spectraloom.operators import graph

#: largest network, in undirected edges, that is sent to every task
NETWORK_EDGES = 4_000_000
#: numbers a task holds for one step over the edges
STEP_NUMBERS = 8_000_000


def simple_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge once, without loops and null ends."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    return e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def known_heats(edges: DataFrame, heats: DataFrame, keys: list[str]) -> DataFrame:
    """One heat per (keys, node of the network), the largest given."""
    nodes = simple_edges(edges).select(F.col("src").alias("node")).distinct()
    return heats.where("heat is not null").join(nodes, "node", "left_semi").groupBy(*keys, "node").agg(F.max(F.col("heat").cast("double")).alias("heat"))


@dataclass
class Network:
    """Neighbours of every node, nodes numbered in name order."""

    names: np.ndarray
    begin: np.ndarray
    neighbour: np.ndarray
    degree: np.ndarray

    @classmethod
    def of(cls, edges: DataFrame, most: int) -> Network | None:
        """The network, or nothing if it has more than ``most`` edges."""
        both = cut(simple_edges(edges))
        if both.count() > 2 * most:
            return None
        table = both.toArrow()
        names, code = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]).astype(object), return_inverse=True)
        src, dst = code[: table.num_rows], code[table.num_rows :]
        degree = np.bincount(dst, minlength=len(names))
        return cls(names, np.cumsum(degree) - degree, src[np.argsort(dst, kind="stable")].astype(np.int32), degree.astype(float))

    @property
    def size(self) -> int:
        return len(self.names)

    @property
    def width(self) -> int:
        """How many vectors walk together."""
        return int(np.clip(STEP_NUMBERS // max(1, len(self.neighbour)), 1, 256))

    def sums(self, x: np.ndarray) -> np.ndarray:
        """A x: every node gets its neighbours' values; every node has a neighbour."""
        return np.add.reduceat(x[self.neighbour], self.begin, axis=0)

    def walk(self, x: np.ndarray, restart: float, tolerance: float) -> np.ndarray:
        """S x for the columns of x; what is left out is under ``tolerance`` of a column's sum."""
        share, total, step = 1 - restart, x * restart, x * restart
        for _ in range(_rounds(restart, tolerance)):
            step = share * self.sums(step / self.degree[:, None])
            total += step
        return total

    def diffused(self, nodes: np.ndarray, time: float, tolerance: float) -> np.ndarray:
        """``expm(-t (D - A))`` applied to single nodes: Poisson-weighted powers, in steps of bounded rate."""
        q = float(self.degree.max())
        steps = max(1, math.ceil(q * time / 500))
        rate = q * time / steps
        x = np.zeros((self.size, len(nodes)))
        x[nodes, np.arange(len(nodes))] = 1.0
        for _ in range(steps):
            weight, covered, k, power = math.exp(-rate), math.exp(-rate), 0, x
            total = x * weight
            while 1 - covered > tolerance / steps and not (k > rate and weight < 1e-18):
                k += 1
                weight *= rate / k
                covered += weight
                power = power + (self.sums(power) - power * self.degree[:, None]) / q
                total += weight * power
            x = total
        return x

    def self_heat(self, nodes: np.ndarray, restart: float, tolerance: float) -> np.ndarray:
        """Diagonal of S at some nodes."""
        root = np.sqrt(self.degree)[:, None]
        at = np.arange(len(nodes))
        now = np.zeros((self.size, len(nodes)))
        now[nodes, at] = 1.0
        out, weight = np.full(len(nodes), restart), restart
        for _ in range((_rounds(restart, tolerance) + 1) // 2):
            following = self.sums(now / root) / root
            out += weight * (1 - restart) * (now * following).sum(axis=0)
            weight *= (1 - restart) ** 2
            out += weight * (following * following).sum(axis=0)
            now = following
        return out


def _rounds(restart: float, tolerance: float) -> int:
    return 0 if restart >= 1 else math.ceil(math.log(tolerance) / math.log(1 - restart))


def _blocks(edges: DataFrame, count: int, width: int, make: Callable[[int, int], pa.RecordBatch], schema: str) -> DataFrame:
    """Rows that ``make(start, stop)`` gives for the blocks of ``range(count)``, spread over the tasks."""
    spark = edges.sparkSession
    blocks = -(-count // width)
    jobs = spark.range(0, blocks, 1, max(1, min(blocks, 4 * shuffle_width(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield make(i * width, min(count, (i + 1) * width))

    return jobs.mapInArrow(run, schema)


def self_heats(edges: DataFrame, restart: float, tolerance: float = 1e-9, network_edges: int = NETWORK_EDGES) -> DataFrame:
    """``node, self``: the diagonal of the operator for every node of the network."""
    net = Network.of(edges, network_edges)
    if net is None:
        return _self_heats_by_rows(edges, restart, tolerance)

    def make(start: int, stop: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(net.names[start:stop].tolist()), pa.array(net.self_heat(np.arange(start, stop), restart, tolerance))], names=["node", "self"])

    kind = dict(edges.dtypes)["src"]
    return _blocks(edges, net.size, net.width, make, f"node {kind}, self double")


def _self_vector(edges: DataFrame, net: Network, restart: float, tolerance: float) -> np.ndarray:
    """The diagonal in the order of the network's nodes."""
    got = self_heats(edges, restart, tolerance, len(net.neighbour)).toArrow()
    out = np.empty(net.size)
    out[np.searchsorted(net.names, got["node"].to_numpy().astype(object))] = got["self"].to_numpy()
    return out


def _self_heats_by_rows(edges: DataFrame, restart: float, tolerance: float) -> DataFrame:
    """The same from keyed rows: half the rounds, and mass under the tolerance's share goes no further."""
    w = simple_edges(edges)
    degree = w.groupBy("src").agg(F.sqrt(F.count("*").cast("double")).alias("root"))
    w = w.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("root").alias("_other")), "dst")
    w = cut(w.select("src", "dst", (1 / (F.col("root") * F.col("_other"))).alias("w")))
    now = cut(w.select(F.col("src").alias("of"), F.col("src").alias("node"), F.lit(1.0).alias("x")).distinct())
    parts, weight = [now.select("of", F.lit(restart).alias("part"))], restart
    rounds = (_rounds(restart, tolerance) + 1) // 2
    for _ in range(rounds):
        pushed = now.join(w, now["node"] == w["src"]).groupBy("of", "dst").agg(F.sum(F.col("x") * F.col("w")).alias("x"))
        following = cut(pushed.where(F.col("x") > tolerance / max(1, rounds)).select("of", F.col("dst").alias("node"), "x"))
        both = now.withColumnRenamed("x", "old").join(following, ["of", "node"])
        parts.append(cut(both.groupBy("of").agg((weight * (1 - restart) * F.sum(F.col("old") * F.col("x"))).alias("part"))))
        weight *= (1 - restart) ** 2
        parts.append(cut(following.groupBy("of").agg((weight * F.sum(F.col("x") * F.col("x"))).alias("part"))))
        now = following
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(F.col("of").alias("node")).agg(F.sum("part").alias("self"))


def walk_operator(edges: DataFrame, heats: DataFrame, restart: float, row_normalized: bool = False, remove_restart: bool = False, largest: bool = True, tolerance: float = 1e-12) -> DataFrame:
    """``node, heat``: the walk's operator (or its transpose) applied to heats.

    ``remove_restart`` takes the restart heat off the diagonal and scales the
    columns to sums of one again; ``largest`` keeps to the largest component.
    """
    edges = cut(simple_edges(graph.largest_component(edges) if largest else edges))
    h = known_heats(edges, heats, [])
    if not remove_restart:
        return graph.random_walk(edges, h, restart, tolerance=tolerance, transposed=row_normalized)
    if row_normalized:
        # a column of the transpose sums to what a row of the operator does
        ones = edges.select(F.col("src").alias("node")).distinct().withColumn("heat", F.lit(1.0))
        sums = graph.random_walk(edges, ones, restart, tolerance=tolerance).withColumnRenamed("heat", "_sum")
        h = h.join(sums, "node").select("node", (F.col("heat") / (F.col("_sum") - restart)).alias("heat"))
    else:
        h = h.select("node", (F.col("heat") / (1 - restart)).alias("heat"))
    h = cut(h)
    walked = graph.random_walk(edges, h, restart, tolerance=tolerance, transposed=row_normalized)
    own = h.select("node", (F.col("heat") * restart).alias("_own"))
    return walked.join(own, "node", "left").select("node", (F.col("heat") - F.coalesce("_own", F.lit(0.0))).alias("heat"))


def diffusion_operator(edges: DataFrame, heats: DataFrame, time: float, remove_restart: bool = False, largest: bool = True, tolerance: float = 1e-12, network_edges: int = NETWORK_EDGES) -> DataFrame:
    """``node, heat``: ``expm(-t (D - A))`` applied to heats.

    ``remove_restart`` sets the diagonal to zero and scales the columns to sums
    of one. The diagonal at v is the squared length of the diffusion of v over
    half the time.
    """
    edges = cut(simple_edges(graph.largest_component(edges) if largest else edges))
    h = known_heats(edges, heats, [])
    if not remove_restart:
        return graph.heat_diffusion(edges, h, time, tolerance=tolerance)
    h = cut(h.where("heat <> 0"))
    net = Network.of(edges, network_edges)
    if net is None:
        unit = h.select(F.col("node").alias("of"), "node", F.lit(1.0).alias("heat"))
        diagonal = graph.heat_diffusion(edges, unit, time / 2, ["of"], tolerance).groupBy(F.col("of").alias("node")).agg(F.sum(F.col("heat") * F.col("heat")).alias("_d"))
    else:
        def make(start: int, stop: int) -> pa.RecordBatch:
            d = (net.diffused(np.arange(start, stop), time / 2, tolerance) ** 2).sum(axis=0)
            return pa.record_batch([pa.array(net.names[start:stop].tolist()), pa.array(d)], names=["node", "_d"])

        diagonal = _blocks(edges, net.size, net.width, make, f"node {dict(edges.dtypes)['src']}, _d double")
    scaled = cut(h.join(diagonal, "node").select("node", (F.col("heat") / (1 - F.col("_d"))).alias("heat"), "_d"))
    spread = graph.heat_diffusion(edges, scaled.select("node", "heat"), time, tolerance=tolerance)
    own = scaled.select("node", (F.col("heat") * F.col("_d")).alias("_own"))
    return spread.join(own, "node", "left").select("node", (F.col("heat") - F.coalesce("_own", F.lit(0.0))).alias("heat"))


class _Heats:
    """Heats of one set on the network: vector, observed places, and what the operator makes of them."""

    def __init__(self, net: Network, name: object, nodes: list, values: list, restart: float, tolerance: float, observed_only: bool, own: np.ndarray | None, mean_one: bool):
        self.name, self.heat = name, np.zeros(net.size)
        self.at = np.sort(np.searchsorted(net.names, np.array(nodes, object)))
        self.heat[np.searchsorted(net.names, np.array(nodes, object))] = values
        if mean_one:
            self.heat *= net.size / self.heat.sum()
        # permuting a single value among the observed would change nothing
        self.places = self.at if observed_only and len(set(values)) > 1 else np.arange(net.size)
        unit = np.zeros(net.size)
        unit[self.places] = 1.0
        both = net.walk(np.column_stack([self.heat, unit]), restart, tolerance)
        self.walked, rows = both[:, 0], both[:, 1]
        self.self_heat = self.heat * own if own is not None else np.zeros(net.size)
        if own is not None:
            rows = rows - unit * own
        self.expected = rows * (self.heat.sum() / len(self.places))

    def permuted(self, seed: int, perms: range) -> np.ndarray:
        x = np.zeros((len(self.heat), len(perms)))
        moving = self.heat[self.places]
        for i, p in enumerate(perms):
            x[self.places, i] = np.random.default_rng([seed, p]).permutation(moving)
        return x


def _test(permuted: np.ndarray, beat: np.ndarray) -> np.ndarray:
    """Permuted scores at or above the one to beat, by row; rounding counts as a tie, minus infinity ties with itself."""
    slack = 1e-12 * np.maximum(1, np.abs(np.where(np.isfinite(beat), beat, 1)))
    return permuted >= np.where(np.isfinite(beat), beat - slack, beat)[:, None]


def _statistics(n_perm: int) -> Callable[[pa.Table], pa.Table]:
    def one(table: pa.Table) -> pa.Table:
        values = np.concatenate([np.asarray(v, float) for v in table["values"].to_numpy()])
        values = np.concatenate([values, np.zeros(n_perm - len(values))])
        beat = table["beat"][0].as_py()
        row = [table["node"][0].as_py(), int(_test(values[None], np.array([beat])).sum()), float(values.mean()), float(np.median(values)), float(values.std(ddof=1)) if n_perm > 1 else None]
        return pa.table([pa.array([x]) for x in row], names=["node", "above", "mean_perm_heat", "median_perm_heat", "sd_perm_heat"])

    return one


def propagate_heats(
    edges: DataFrame, heats: DataFrame, restart: float, n_perm: int = 20_000, network_only: bool = False, observed_only: bool = False,
    seed: int = 1, tolerance: float = 1e-9, network_edges: int = NETWORK_EDGES,
) -> DataFrame:
    """Walked heats with a permutation test per node.

    With ``network_only`` a node's own heat times the operator's diagonal is
    taken off the heat to beat, the permuted heats and the expected heat.
    ``observed_only`` permutes among the observed nodes unless they share one
    value. Mean, median and standard deviation are exact over all permutations.
    """
    net = Network.of(edges, network_edges)
    kind = dict(edges.dtypes)["src"]
    if net is None:
        base, permuted = _by_rows(edges, heats, restart, n_perm, network_only, observed_only, seed, tolerance)
    else:
        spark = edges.sparkSession
        given = known_heats(edges, heats, []).toArrow()
        if not given.num_rows:
            return _empty_result(spark, kind)
        own = _self_vector(edges, net, restart, tolerance)
        h = _Heats(net, None, given["node"].to_pylist(), given["heat"].to_pylist(), restart, tolerance, observed_only, own if network_only else None, False)
        beat = h.walked - h.self_heat
        columns = {"node": net.names.tolist(), "heat0": h.heat, "prop_heat": h.walked, "self_heat": h.heat * own, "expect_heat": h.expected, "beat": beat}
        base = spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))

        def make(start: int, stop: int) -> pa.RecordBatch:
            x = h.permuted(seed, range(start, stop))
            y = net.walk(x, restart, tolerance)
            if network_only:
                y -= x * own[:, None]
            return pa.record_batch([pa.array(net.names.tolist()), pa.array(list(y), pa.list_(pa.float64()))], names=["node", "values"])

        permuted = _blocks(edges, n_perm, net.width, make, f"node {kind}, values array<double>")
    base = cut(base)
    tested = base.select("node", "beat").join(permuted, "node", "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
    stats = tested.groupBy("node").applyInArrow(_statistics(n_perm), f"node {kind}, above long, mean_perm_heat double, median_perm_heat double, sd_perm_heat double")
    d = base.join(stats, "node").withColumn("pvalue", F.col("above") / n_perm)
    d = p_adjust_bh(cut(d), "pvalue", "adj_pvalue")
    return d.select(
        "node", "heat0", "prop_heat", "pvalue", "adj_pvalue", "self_heat", "expect_heat", "mean_perm_heat", "median_perm_heat", "sd_perm_heat",
        ratio(F.col("beat") - F.col("mean_perm_heat"), F.col("sd_perm_heat")).alias("z"),
    )


def _empty_result(spark, kind: str) -> DataFrame:
    numbers = "heat0 prop_heat pvalue adj_pvalue self_heat expect_heat mean_perm_heat median_perm_heat sd_perm_heat z".split()
    return spark.createDataFrame([], f"node {kind}, " + ", ".join(f"{c} double" for c in numbers))


def _by_rows(edges: DataFrame, heats: DataFrame, restart: float, n_perm: int, network_only: bool, observed_only: bool, seed: int, tolerance: float, block: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The same tables from keyed rows, a block of permutations at a time."""
    edges = cut(simple_edges(edges))
    nodes, h = graph._prepared(edges, heats, [])
    own = cut(self_heats(edges, restart, tolerance, 0))
    expect = expected_heat(edges, h, restart, observed_only, network_only, tolerance=tolerance, own=own)
    walked = graph.random_walk(edges, h, restart, tolerance=tolerance)
    base = nodes.select("node").join(h.withColumnRenamed("heat", "heat0"), "node", "left").join(walked.withColumnRenamed("heat", "prop_heat"), "node", "left").na.fill(0.0)
    base = base.join(own, "node").join(expect, "node").withColumn("self_heat", F.col("heat0") * F.col("self")).drop("self")
    base = base.withColumn("beat", F.col("prop_heat") - (F.col("self_heat") if network_only else F.lit(0.0)))
    perms = graph.permuted_heats(nodes, h, [], n_perm, seed, observed_only)
    every = None
    for start in range(0, n_perm, block):
        part = cut(perms.where((F.col("perm") > start) & (F.col("perm") <= start + block)))
        done = graph.random_walk(edges, part, restart, ["perm"], tolerance)
        if network_only:
            taken = part.join(own, "node").select("perm", "node", (F.col("heat") * F.col("self")).alias("_own"))
            done = done.join(taken, ["perm", "node"], "left").select("perm", "node", (F.col("heat") - F.coalesce("_own", F.lit(0.0))).alias("heat"))
        done = cut(done.groupBy("node").agg(F.collect_list("heat").alias("values")))
        every = done if every is None else every.unionByName(done)
    return base.select("node", "heat0", "prop_heat", "self_heat", "expect_heat", "beat"), every


def expected_heat(
    edges: DataFrame, heats: DataFrame, restart: float, observed_only: bool = False, network_only: bool = False, keys: list[str] | None = None,
    tolerance: float = 1e-9, own: DataFrame | None = None,
) -> DataFrame:
    """``keys, node, expect_heat``: row sums of the operator (over observed columns only if asked), scaled to the heat given.

    ``network_only`` leaves the diagonal out of the sums, of the observed nodes
    only where only their columns are summed.
    """
    keys = keys or []
    plain = graph.expected_heat(edges, heats, restart, observed_only, keys, tolerance)
    if not network_only:
        return plain
    nodes, h = graph._prepared(edges, heats, keys)
    n = nodes.count()
    own = own if own is not None else self_heats(edges, restart, tolerance)
    scale = h.groupBy(*keys).agg(F.sum("heat").alias("_sum"), F.count("*").alias("_obs"), F.countDistinct("heat").alias("_values"))
    scale = scale.withColumn("_only", F.lit(observed_only) & (F.col("_values") > 1))
    d = plain.join(scale, keys) if keys else attach(plain, scale)
    d = d.join(h.select(*keys, "node", F.lit(True).alias("_seen")), [*keys, "node"], "left").join(own, "node")
    factor = F.col("_sum") / F.when(F.col("_only"), F.col("_obs")).otherwise(F.lit(n))
    taken = F.when(F.col("_only") & F.col("_seen").isNull(), F.lit(0.0)).otherwise(F.col("self") * factor)
    return d.select(*keys, "node", (F.col("expect_heat") - taken).alias("expect_heat"))


def propagate_multi(
    edges: DataFrame, heats: DataFrame, restart: float, n_perm: int = 20_000, network_only: bool = False, observed_only: bool = True, seed: int = 1,
    set_key: str = "set", tolerance: float = 1e-9, network_edges: int = NETWORK_EDGES,
) -> DataFrame:
    """Several heat sets at once: log2(walked / expected) summed over the sets, with a permutation test per node.

    Each set is scaled to a mean of one over the network. Rows: node, then per
    set ``heat0_``, ``expect_``, ``prop_`` and ``log2_`` columns, the sum
    ``log2_prop_vs_expected``, ``pvalue`` and ``adj_pvalue``. A walked heat of
    zero (with ``network_only`` also one that rounding took below) has minus
    infinity, so has the sum, and minus infinity ties with itself. Set names
    become columns: the sets are a design factor, not data.
    """
    net = Network.of(edges, network_edges)
    kind = dict(edges.dtypes)["src"]
    if net is None:
        return _multi_by_rows(edges, heats, restart, n_perm, network_only, observed_only, seed, set_key, tolerance)
    spark = edges.sparkSession
    own = _self_vector(edges, net, restart, tolerance) if network_only else None
    given = known_heats(edges, heats, [set_key]).toPandas()
    sets = [_Heats(net, name, g["node"].tolist(), g["heat"].tolist(), restart, tolerance, observed_only, own, True) for name, g in given.groupby(set_key) if g["heat"].sum() > 0]

    def log2(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, np.log2(np.maximum(x, 0)), -np.inf)

    walked = {s.name: s.walked - s.self_heat for s in sets}
    score = {s.name: log2(walked[s.name]) - np.where(s.expected > 0, log2(s.expected), 0) for s in sets}
    beat = np.sum(list(score.values()), axis=0) if sets else np.zeros(net.size)

    def make(start: int, stop: int) -> pa.RecordBatch:
        total = np.zeros((net.size, stop - start))
        for i, s in enumerate(sets):
            x = s.permuted(seed + 1000 * i, range(start, stop))
            y = net.walk(x, restart, tolerance)
            if own is not None:
                y -= x * own[:, None]
            total += log2(y) - np.where(s.expected > 0, log2(s.expected), 0)[:, None]
        return pa.record_batch([pa.array(net.names.tolist()), pa.array(_test(total, beat).sum(axis=1).astype(np.int64))], names=["node", "above"])

    columns = {"node": net.names.tolist()}
    for s in sets:
        columns |= {f"heat0_{s.name}": s.heat, f"expect_{s.name}": s.expected, f"prop_{s.name}": walked[s.name], f"log2_{s.name}": score[s.name]}
    base = spark.createDataFrame(pa.table({k: pa.array(v) for k, v in (columns | {"log2_prop_vs_expected": beat}).items()}))
    above = _blocks(edges, n_perm, net.width, make, f"node {kind}, above long").groupBy("node").agg((F.sum("above") / n_perm).alias("pvalue"))
    return p_adjust_bh(cut(base.join(above, "node")), "pvalue", "adj_pvalue")


def _multi_by_rows(edges: DataFrame, heats: DataFrame, restart: float, n_perm: int, network_only: bool, observed_only: bool, seed: int, set_key: str, tolerance: float, block: int = 2000) -> DataFrame:
    """The same from keyed rows; the sets of a permutation walk together."""
    edges = cut(simple_edges(edges))
    nodes, h = graph._prepared(edges, heats, [set_key])
    n = nodes.count()
    total = h.groupBy(set_key).agg(F.sum("heat").alias("_t")).where("_t > 0")
    h = cut(h.join(total, set_key).select(set_key, "node", (n * F.col("heat") / F.col("_t")).alias("heat")))
    names = sorted(r[0] for r in total.select(set_key).collect())
    own = cut(self_heats(edges, restart, tolerance, 0)) if network_only else None
    expect = cut(expected_heat(edges, h, restart, observed_only, network_only, [set_key], tolerance, own))
    floor = float("-inf")

    def scored(part: DataFrame, first: int, last: int) -> DataFrame:
        """Walked heat and score of every (perm, set, node); what no heat reached has minus infinity."""
        done = graph.random_walk(edges, part, restart, ["perm", set_key], tolerance)
        if own is not None:
            taken = part.join(own, "node").select("perm", set_key, "node", (F.col("heat") * F.col("self")).alias("_own"))
            done = done.join(taken, ["perm", set_key, "node"], "left").select("perm", set_key, "node", (F.col("heat") - F.coalesce("_own", F.lit(0.0))).alias("heat"))
        d = expect.withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(done, ["perm", set_key, "node"], "left")
        log = F.when(F.col("heat") > 0, F.log2("heat") - F.when(F.col("expect_heat") > 0, F.log2("expect_heat")).otherwise(0.0)).otherwise(floor)
        return d.withColumn("heat", F.coalesce("heat", F.lit(0.0))).withColumn("log2", log)

    real = cut(scored(h.withColumn("perm", F.lit(0)), 0, 0).join(h.withColumnRenamed("heat", "heat0"), [set_key, "node"], "left").na.fill(0.0, ["heat0"]))
    wide = real.groupBy("node").agg(F.sum("log2").alias("log2_prop_vs_expected"), *[
        F.max(F.when(F.col(set_key) == s, F.col(c))).alias(f"{label}_{s}") for s in names for label, c in (("heat0", "heat0"), ("expect", "expect_heat"), ("prop", "heat"), ("log2", "log2"))
    ])
    wide = cut(wide)
    perms = graph.permuted_heats(nodes, h, [set_key], n_perm, seed, observed_only)
    above = None
    for start in range(0, n_perm, block):
        part = cut(perms.where((F.col("perm") > start) & (F.col("perm") <= start + block)))
        sums = scored(part, start + 1, min(n_perm, start + block)).groupBy("perm", "node").agg(F.sum("log2").alias("score")).join(wide.select("node", F.col("log2_prop_vs_expected").alias("beat")), "node")
        slack = F.when(F.col("beat") == floor, 0.0).otherwise(1e-12 * F.greatest(F.lit(1.0), F.abs("beat")))
        hit = cut(sums.groupBy("node").agg(F.sum((F.col("score") >= F.col("beat") - slack).cast("long")).alias("above")))
        above = hit if above is None else above.unionByName(hit)
    p = above.groupBy("node").agg((F.sum("above") / n_perm).alias("pvalue"))
    columns = ["node", *[f"{label}_{s}" for s in names for label in ("heat0", "expect", "prop", "log2")], "log2_prop_vs_expected", "pvalue"]
    return p_adjust_bh(cut(wide.join(p, "node").select(*columns)), "pvalue", "adj_pvalue")
