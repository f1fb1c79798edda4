"""Graph operators on edge tables: iterative joins with lineage cut each round."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.columns import first_row, ratio
from spectraloom.functions.ordered import add_order, exact_quantile, p_adjust_bh
from spectraloom.functions.session import attach, cut
from spectraloom.operators.cluster import average_linkage
from spectraloom.operators.relational import dense_index, permuted_index


# --- loading and cutting --------------------------------------------------------

def load_links(links: DataFrame, threshold: float = 600, named: dict[str, float] | None = None) -> DataFrame:
    out = links.where(F.col("combined_score") > threshold)
    for column, limit in (named or {}).items():
        out = out.where(F.col(column) > limit)
    return out


def ordered_ends(edges: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    lo, hi = F.least(a, b), F.greatest(a, b)
    return edges.withColumns({"_lo": lo, "_hi": hi}).withColumns({a: F.col("_lo"), b: F.col("_hi")}).drop("_lo", "_hi")


def subgraph(links: DataFrame, nodes: DataFrame, threshold: float = 600, named: dict[str, float] | None = None) -> DataFrame:
    """Edges with both ends in ``nodes`` (column ``name``), ends ordered, one row per pair."""
    e = links.where(F.col("combined_score") > threshold)
    for column, limit in (named or {}).items():
        e = e.where(F.col(column) >= limit)
    names = nodes.select("name").distinct()
    e = e.join(names.withColumnRenamed("name", "protein1"), "protein1", "left_semi")
    e = e.join(names.withColumnRenamed("name", "protein2"), "protein2", "left_semi")
    rest = [c for c in links.columns if c not in ("protein1", "protein2")]
    return first_row(ordered_ends(e), ["protein1", "protein2"], [-F.col("combined_score"), *[F.col(c) for c in rest]])


def node_sample(links: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Seeded draw of ``n`` distinct nodes; the draw is by hash, so it repeats."""
    nodes = links.select(F.col("protein1").alias("name")).union(links.select("protein2")).distinct()
    return nodes.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(n)


def connector_edges(links: DataFrame, nodes: DataFrame, min_score: float = 600) -> DataFrame:
    """Edges from outside nodes that touch the set more than once."""
    names = nodes.select(F.col("name").alias("_in")).distinct()
    e = links.where(F.col("combined_score") > min_score)
    both = e.select("protein1", "protein2", "combined_score", F.col("protein1").alias("cand"), F.col("protein2").alias("anchor")).unionByName(
        e.select("protein1", "protein2", "combined_score", F.col("protein2").alias("cand"), F.col("protein1").alias("anchor"))
    )
    both = both.join(names, F.col("anchor") == F.col("_in"), "left_semi").join(names, F.col("cand") == F.col("_in"), "left_anti")
    edges = ordered_ends(both).groupBy("protein1", "protein2", "cand").agg((F.max("combined_score") / 1000).alias("weight"))
    good = edges.groupBy("cand").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return edges.join(good, "cand", "left_semi").select("protein1", "protein2", "weight")


def sub_network(links: DataFrame, nodes: DataFrame, min_score: float = 600, one_hop: bool = False) -> DataFrame:
    names = nodes.select("name").distinct()
    e = links.where(F.col("combined_score") > min_score)
    e = e.join(names.withColumnRenamed("name", "protein1"), "protein1", "left_semi")
    e = e.join(names.withColumnRenamed("name", "protein2"), "protein2", "left_semi")
    inner = e.select("protein1", "protein2", (F.col("combined_score") / 1000).alias("weight"))
    return inner.unionByName(connector_edges(links, nodes, min_score)) if one_hop else inner


# --- components -----------------------------------------------------------------

def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` (smallest node name) by alternating large and small stars.

    Each half round is one min-aggregate and one join, both combinable, so a hub
    does not need its neighbours in one place. Rounds grow with log(n); they end
    as soon as every component is a star.
    """
    all_nodes = _both_ways(edges).select(F.col("src").alias("node")).distinct()
    if nodes is not None:
        all_nodes = all_nodes.unionByName(nodes.select("node")).distinct()
    e = cut(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )
    while True:
        sym = _both_ways(e)
        low = sym.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = sym.join(low, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low2 = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low2, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct(F.col("src").alias("src"), F.col("m").alias("dst")))).alias("p"))
        e = cut(small.select("p.src", "p.dst").where(F.col("src") != F.col("dst")).distinct())
        # done when only stars are left: one way up for every node, and none for a centre
        up, down = (e.select(F.col(c).alias("node"), F.lit(c == "src").cast("int").alias("up"), F.lit(c == "dst").alias("down")) for c in ("src", "dst"))
        ends = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.bool_or("down").alias("down"))
        if not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & F.col("down")))).first()[0]:
            break
    return all_nodes.join(e.select(F.col("src").alias("node"), F.col("dst").alias("_m")), "node", "left").select(
        "node", F.coalesce("_m", "node").alias("component")
    )


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes (ties: smallest label)."""
    comp = cut(connected_components(edges))
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    keep = comp.join(F.broadcast(top), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(keep, "src", "left_semi")


def hop_distances(edges: DataFrame, max_hops: int, sources: DataFrame | None = None) -> DataFrame:
    """``source, node, hops`` for every pair within ``max_hops`` (0 included).

    Breadth-first rounds: the frontier meets the edges, pairs already seen are
    removed, and the rest is written once per round.
    """
    adj = cut(_both_ways(edges).where(F.col("src") != F.col("dst")).distinct())
    start = sources.select(F.col("node").alias("source")).distinct() if sources is not None else adj.select(F.col("src").alias("source")).distinct()
    seen = cut(start.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    frontier = seen
    parts = [seen]
    for hop in range(1, max_hops + 1):
        step = frontier.join(adj, frontier["node"] == adj["src"]).select("source", F.col("dst").alias("node")).distinct()
        # an undirected frontier can only return to the last two rounds
        for old in parts[-2:]:
            step = step.join(old, ["source", "node"], "left_anti")
        frontier = cut(step.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- propagation ----------------------------------------------------------------

def _transition(edges: DataFrame, divide_by: str) -> DataFrame:
    """Symmetric adjacency without loops, weight 1 / degree of ``src`` or ``dst``."""
    adj = _both_ways(edges).where(F.col("src") != F.col("dst")).distinct()
    deg = adj.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    if divide_by == "src":
        return adj.join(deg, "src").select("src", "dst", (1.0 / F.col("_deg")).alias("w"))
    deg = deg.withColumnRenamed("src", "dst")
    return adj.join(deg, "dst").select("src", "dst", (1.0 / F.col("_deg")).alias("w"))


def random_walk(
    edges: DataFrame, heats: DataFrame, restart: float, keys: list[str] | None = None, tolerance: float = 1e-9,
    transposed: bool = False, max_rounds: int = 2000, rounds_per_cut: int = 6,
) -> DataFrame:
    """Apply ``pr (I - (1-pr) A D^-1)^-1`` to heats, for every ``keys`` at once.

    The operator matrix is never formed: ``x <- pr h + (1-pr) W x`` repeats until
    the largest change of one round is under ``tolerance`` times the largest heat. Heat tables carry
    ``keys``, ``node``, ``heat``; zero heats need no row.
    """
    keys = keys or []
    w = cut(_transition(edges, "dst" if transposed else "src"))
    network = w.select(F.col("src").alias("node")).distinct()
    h = cut(heats.join(network, "node", "left_semi").select(*keys, "node", F.col("heat").cast("double").alias("heat")).where(F.col("heat") != 0))
    peak = h.agg(F.max(F.abs("heat"))).first()[0]
    if peak is None:
        return h
    x = h
    done = 0
    while done < max_rounds:
        last = x
        for _ in range(rounds_per_cut):
            last = x
            moved = x.join(w, x["node"] == w["src"]).select(*keys, F.col("dst").alias("node"), ((1 - restart) * F.col("heat") * F.col("w")).alias("heat"))
            x = moved.unionByName(h.withColumn("heat", F.col("heat") * restart)).groupBy(*keys, "node").agg(F.sum("heat").alias("heat"))
            done += 1
        both = x.withColumnRenamed("heat", "_new").join(last, [*keys, "node"], "full")
        both = cut(both.select(*keys, "node", F.col("_new").alias("heat"), F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("heat", F.lit(0.0))).alias("_d")))
        x = both.where(F.col("heat").isNotNull()).select(*keys, "node", "heat")
        change = both.agg(F.max("_d")).first()[0]
        if change is None or change < tolerance * peak:
            return x
    raise RuntimeError("random walk did not settle")


def heat_diffusion(
    edges: DataFrame, heats: DataFrame, time: float, keys: list[str] | None = None, tolerance: float = 1e-10, rounds_per_cut: int = 4, largest_rate: float = 500
) -> DataFrame:
    """Apply ``expm(-t (D - A))`` to heats by uniformization.

    ``exp(-tL) = sum_k Poisson(qt; k) (I - L/q)^k`` with q the largest degree;
    terms stop when the Poisson mass left is under ``tolerance``.
    """
    keys = keys or []
    adj = cut(_both_ways(edges).where(F.col("src") != F.col("dst")).distinct())
    deg = cut(adj.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("deg")))
    q = float(deg.agg(F.max("deg")).first()[0])
    h = cut(heats.join(deg.withColumnRenamed("src", "node"), "node", "left_semi").select(*keys, "node", F.col("heat").cast("double").alias("heat")).where(F.col("heat") != 0))
    rate = q * time
    if rate > largest_rate:
        # exp(-tL) is exp(-tL/s) applied s times; a series of a larger rate would start from a weight of zero
        steps = math.ceil(rate / largest_rate)
        for _ in range(steps):
            h = cut(heat_diffusion(edges, h, time / steps, keys, tolerance / steps, rounds_per_cut, 1.01 * largest_rate))
        return h
    weight, covered, k = math.exp(-rate), math.exp(-rate), 0
    power = h
    total = h.withColumn("heat", F.col("heat") * weight)
    while 1.0 - covered > tolerance:
        k += 1
        weight *= rate / k
        covered += weight
        flow = power.join(adj, power["node"] == adj["src"]).select(*keys, F.col("dst").alias("node"), (F.col("heat") / q).alias("heat"))
        stay = power.join(deg, power["node"] == deg["src"]).select(*keys, "node", (F.col("heat") * (1 - F.col("deg") / q)).alias("heat"))
        power = flow.unionByName(stay).groupBy(*keys, "node").agg(F.sum("heat").alias("heat"))
        if k % rounds_per_cut == 0:
            power = cut(power)
        total = total.unionByName(power.withColumn("heat", F.col("heat") * weight))
        if k % rounds_per_cut == 0:
            total = cut(total.groupBy(*keys, "node").agg(F.sum("heat").alias("heat")))
        if k > rate and weight < 1e-18:
            break
    return total.groupBy(*keys, "node").agg(F.sum("heat").alias("heat"))


def _prepared(edges: DataFrame, heats: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Numbered network nodes, and one heat per (keys, node) as the largest given."""
    nodes = cut(dense_index(_both_ways(edges).where(F.col("src") != F.col("dst")).select(F.col("src").alias("node")).distinct(), "node", "idx"))
    h = heats.where("heat is not null").join(nodes.select("node"), "node", "left_semi").groupBy(*keys, "node").agg(F.max("heat").alias("heat"))
    return nodes, cut(h)


def permuted_heats(nodes: DataFrame, heats: DataFrame, keys: list[str], n_perm: int, seed: int, observed_only: bool) -> DataFrame:
    """``keys, perm, node, heat``: each heat moves to a permuted position."""
    if observed_only:
        # positions 0..m-1 among the observed nodes of each key
        h = dense_index(heats, "node", "idx", keys)
        size = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        h = h.join(size, keys) if keys else attach(h, size)
        place = h.select(*keys, F.col("idx").alias("_to"), "node")
    else:
        h = heats.join(nodes, "node").withColumn("size", F.lit(nodes.count()))
        place = None
    moved = h.where(F.col("heat") != 0).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).select(
        *keys, "perm", permuted_index(F.col("idx"), F.xxhash64("perm", F.lit(seed), *keys), F.col("size")).alias("_to"), "heat"
    )
    if place is not None:
        return moved.join(place, [*keys, "_to"]).select(*keys, "perm", "node", "heat")
    return moved.join(nodes.select(F.col("idx").alias("_to"), "node"), "_to").select(*keys, "perm", "node", "heat")


def expected_heat(edges: DataFrame, heats: DataFrame, restart: float, observed_only: bool = False, keys: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Row sums of the operator (over observed columns only if asked), scaled to the heat given."""
    keys = keys or []
    nodes, h = _prepared(edges, heats, keys)
    n = nodes.count()
    scale = h.groupBy(*keys).agg(F.sum("heat").alias("_sum"), F.count(F.lit(1)).alias("_obs"), F.countDistinct("heat").alias("_values"))
    flat = scale.select(*keys, "_sum", "_obs", (F.lit(observed_only) & (F.col("_values") > 1)).alias("_only"))
    # all-node row sums do not depend on the heat set: one unkeyed walk serves every such set
    seen = h.join(flat.where("_only"), keys, "left_semi") if keys else attach(h, flat).where("_only")
    sums = random_walk(edges, seen.select(*keys, "node", F.lit(1.0).alias("heat")), restart, keys, tolerance) if observed_only else None
    full = random_walk(edges, nodes.select("node", F.lit(1.0).alias("heat")), restart, tolerance=tolerance)
    if keys:
        sets = flat.where(~F.col("_only")).agg(F.collect_list(F.struct(*keys)).alias("_sets"))
        full = attach(full, sets).select(F.explode("_sets").alias("_k"), "node", "heat").select(*[F.col("_k")[k].alias(k) for k in keys], "node", "heat")
        sums = full if sums is None else sums.unionByName(full)
        joined = sums.join(flat, keys)
    else:
        full = attach(full, flat).where(~F.col("_only"))
        joined = full if sums is None else full.unionByName(attach(sums, flat))
    factor = F.col("_sum") / n * F.when(F.col("_only"), F.lit(float(n)) / F.col("_obs")).otherwise(1.0)
    return joined.select(*keys, "node", (F.col("heat") * factor).alias("expect_heat"))


def heat_contributions(edges: DataFrame, heats: DataFrame, targets: DataFrame, restart: float, network_only: bool = False, tolerance: float = 1e-9) -> DataFrame:
    """Heat each source gives each target: one transposed walk per target, keyed."""
    unit = targets.select(F.col("node").alias("to"), "node", F.lit(1.0).alias("heat"))
    walked = random_walk(edges, unit, restart, ["to"], tolerance, transposed=True)
    h = heats.groupBy("node").agg(F.max("heat").alias("_h"))
    d = walked.join(h, "node").select("to", F.col("node").alias("from"), (F.col("heat") * F.col("_h")).alias("contributed_heat"))
    if network_only:
        d = d.where(F.col("to") != F.col("from"))
    d = cut(d.where(F.col("contributed_heat") > 0))
    total = d.groupBy("to").agg(F.sum("contributed_heat").alias("_t"))
    d = d.join(total, "to").withColumn("percent", 100 * F.col("contributed_heat") / F.col("_t")).drop("_t")
    w = Window.partitionBy("to").orderBy(F.col("percent").desc(), "from").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cumulative_percent", F.sum("percent").over(w))


# --- forests and matchings ------------------------------------------------------

def spanning_forest(edges: DataFrame) -> DataFrame:
    """One spanning tree per component (Boruvka rounds; the edge order breaks ties)."""
    e = cut(edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    label = cut(_both_ways(e).select(F.col("src").alias("node"), F.col("src").alias("comp")).distinct())
    chosen = None
    while True:
        la = label.select(F.col("node").alias("src"), F.col("comp").alias("ca"))
        lb = label.select(F.col("node").alias("dst"), F.col("comp").alias("cb"))
        cross = cut(e.join(la, "src").join(lb, "dst").where(F.col("ca") != F.col("cb")).select("src", "dst", "ca", "cb"))
        if cross.isEmpty():
            break
        order = F.struct(F.xxhash64("src", "dst").alias("h"), "src", "dst", "ca", "cb")
        best = cross.select(F.explode(F.array("ca", "cb")).alias("c"), order.alias("o")).groupBy("c").agg(F.min("o").alias("o"))
        picked = cut(best.select("o.src", "o.dst", "o.ca", "o.cb").distinct())
        chosen = picked.select("src", "dst") if chosen is None else chosen.unionByName(picked.select("src", "dst"))
        merged = connected_components(picked.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        label = cut(label.join(merged, label["comp"] == merged["node"], "left").select(label["node"], F.coalesce(merged["component"], label["comp"]).alias("comp")))
        e = cross.select("src", "dst")
    return chosen if chosen is not None else e


def one_edge_per_node(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Greedy matching in edge order: same result as scanning the edges one by one.

    Each round keeps the edges that come first at both of their ends and drops
    everything touching them.
    """
    left = cut(edges.select("src", "dst", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "src", "dst").alias("o")))
    kept = None
    while True:
        ends = left.select(F.explode(F.array("src", "dst")).alias("node"), "o")
        best = ends.groupBy("node").agg(F.min("o").alias("o"))
        won = best.groupBy("o").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == 2) | (F.col("o.src") == F.col("o.dst")))
        won = cut(won.select("o.src", "o.dst", "o"))
        kept = won if kept is None else kept.unionByName(won)
        used = won.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        left = cut(
            left.join(used.withColumnRenamed("node", "src"), "src", "left_anti").join(used.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", "o")
        )
        if left.isEmpty():
            return kept.select("src", "dst")


# --- complexes ------------------------------------------------------------------

def decoy_complexes(
    complexes: DataFrame, distances: DataFrame, min_distance: int = 3, quantile: float = 0.1, min_size: int = 2, retries: int = 3, seed: int = 1, per_complex: int = 1, unfit: str = "error"
) -> DataFrame:
    """Complexes of randomly drawn genes that are far apart, ``per_complex`` for each real complex.

    ``complexes`` has ``complex_id, gene``; ``distances`` has ``gene1 < gene2, hops``.
    Draws are seeded by (complex, copy, try); the first accepted try is kept. All
    known distances count, those under ``min_distance`` too: a try is accepted
    when their quantile reaches it or none is known. Where no try is accepted,
    the one with the largest quantile is kept, as its genes all are of the pool
    of far genes. A complex larger than that pool draws from all genes of the
    complexes too; if none of its tries is accepted, or it is larger than both
    pools together, it is an error, or with ``unfit="keep"`` one row without a gene.
    """
    sizes = cut(complexes.groupBy("complex_id").agg(F.countDistinct("gene").alias("size")).where(F.col("size") >= min_size))
    far = distances.where(F.col("hops") >= min_distance)
    pool = far.select(F.col("gene1").alias("gene")).union(far.select("gene2")).distinct()
    pool = cut(dense_index(pool, "gene", "idx"))
    n = most = pool.count()
    if (sizes.agg(F.max("size")).first()[0] or 0) > n:
        rest = complexes.select("gene").where("gene is not null").distinct().join(pool, "gene", "left_anti")
        pool = cut(pool.select("gene", "idx").unionByName(dense_index(rest, "gene", "idx").select("gene", (F.col("idx") + n).alias("idx"))))
        most = pool.count()
    wanted = sizes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(per_complex))))
    key = ["complex_id", "copy"]
    span = F.when(F.col("size") <= n, F.lit(n)).otherwise(F.lit(most)).cast("bigint")
    left, fits, near = wanted.where(F.col("size") <= most), [], []
    for turn in range(1, retries + 1):
        draws = left.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)))
        draws = draws.withColumn("idx", permuted_index(F.col("pos"), F.xxhash64(*key, F.lit(turn), F.lit(seed)), span))
        drawn = cut(draws.join(pool, "idx").select(*key, "size", "gene"))
        other = drawn.select(*key, F.col("gene").alias("gene2"))
        pairs = drawn.withColumnRenamed("gene", "gene1").join(other, key).where(F.col("gene1") < F.col("gene2"))
        known = exact_quantile(pairs.join(distances, ["gene1", "gene2"]), key, "hops", quantile, "_q")
        bad = cut(known.where(F.col("_q") < min_distance).select(*key, "_q"))
        if bad.isEmpty():
            fits.append(drawn)
            near = []
            break
        fits.append(drawn.join(bad, key, "left_anti"))
        left = left.join(bad, key, "left_semi")
        near.append(drawn.where(F.col("size") <= n).join(bad.withColumn("_try", F.struct("_q", F.lit(-turn))), key).drop("_q"))
    if near:
        tries = near[0]
        for more in near[1:]:
            tries = tries.unionByName(more)
        best = tries.groupBy(*key).agg(F.max("_try").alias("_try")).join(bad, key, "left_semi")
        fits.append(tries.join(best, [*key, "_try"], "left_semi").drop("_try"))
    kept = fits[0] if fits else wanted.select(*key, "size", F.lit(None).cast("string").alias("gene")).limit(0)
    for more in fits[1:]:
        kept = kept.unionByName(more)
    kept = cut(wanted.join(kept.drop("size"), key, "left"))
    if unfit == "error" and (bad := kept.where(F.col("gene").isNull()).count()):
        raise ValueError(f"no draw of genes at least {min_distance} apart fits {bad} complexes: raise the number of retries or lower the distance")
    label = F.concat(F.lit("decoy_"), F.col("complex_id").cast("string"), F.when(F.col("copy") > 1, F.concat(F.lit("_"), F.col("copy").cast("string"))).otherwise(""))
    return kept.select(label.alias("complex_id"), F.col("size").alias("complex_size"), "gene")


def targets_and_decoys(complexes: DataFrame, distances: DataFrame, **options) -> DataFrame:
    """Real complexes (``complex_id, complex_name, gene, protein``) and their decoys in one table with a ``decoy`` flag.

    A decoy's proteins are those that its genes have in the real complexes (the
    smallest, if several); genes outside them have none.
    """
    size = complexes.groupBy("complex_id").agg(F.countDistinct("gene").alias("complex_size"))
    real = complexes.join(size, "complex_id").select(F.col("complex_id").cast("string").alias("complex_id"), "complex_name", "complex_size", "gene", "protein", F.lit(False).alias("decoy"))
    protein = complexes.groupBy("gene").agg(F.min("protein").alias("protein"))
    decoys = decoy_complexes(complexes.select("complex_id", "gene"), distances, **options).join(protein, "gene", "left")
    return real.unionByName(decoys.select("complex_id", F.col("complex_id").alias("complex_name"), "complex_size", "gene", "protein", F.lit(True).alias("decoy")))


def complexes_for_epic(complexes: DataFrame, min_members: int = 2, strict: bool = True) -> DataFrame:
    """Tab-packed members of complexes with more than (or at least) ``min_members``."""
    members = F.split("subunits_uniprot_id", ";")
    keep = F.size(members) > min_members if strict else F.size(members) >= min_members
    return complexes.where(keep).select("complex_id", F.array_join(members, "\t").alias("members"))


# --- modules --------------------------------------------------------------------

def module_centers(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Median position, count and drawn radius per module of matching preys."""
    d = nodes.where(F.col("nameMatch") & (F.col("type") == "prey"))
    return d.groupBy(*keys).agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count(F.lit(1)).alias("N")).withColumn("radius", F.sqrt("N"))


def module_edges(nodes: DataFrame, bait_prey: DataFrame) -> DataFrame:
    d = nodes.where(F.col("nameMatch") & (F.col("type") == "prey")).select("gene", "cluster")
    return bait_prey.join(d, bait_prey["prey"] == d["gene"]).groupBy("bait", "cluster").agg(F.count(F.lit(1)).alias("N"))


def edge_view(nodes: DataFrame, bait_prey: DataFrame, max_length: float, stub: float) -> DataFrame:
    """Edges with end coordinates, length and the shortened end of long edges."""
    a = nodes.select(F.col("gene").alias("bait"), "x", "y")
    b = nodes.select(F.col("gene").alias("prey"), F.col("x").alias("xend"), F.col("y").alias("yend"))
    e = bait_prey.select("bait", "prey").join(a, "bait").join(b, "prey")
    dx, dy = F.col("xend") - F.col("x"), F.col("yend") - F.col("y")
    e = e.withColumn("length", F.sqrt(dx * dx + dy * dy))
    long = F.col("length") > max_length
    return e.withColumn("xend_stub", F.when(long, F.col("x") + dx * ratio(F.lit(stub), F.col("length"))).otherwise(F.col("xend"))).withColumn(
        "yend_stub", F.when(long, F.col("y") + dy * ratio(F.lit(stub), F.col("length"))).otherwise(F.col("yend"))
    )


def baits_per_prey(bait_prey: DataFrame) -> DataFrame:
    return bait_prey.groupBy("prey").agg(F.count(F.lit(1)).alias("baitPerPrey"))


def modules_from_distance(distances: DataFrame, max_distance: float, min_size: int = 5) -> DataFrame:
    """Modules as components of the graph of distances at most ``max_distance``; small ones are dropped."""
    e = distances.where(F.col("distance") <= max_distance).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = cut(connected_components(e))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    return comp.join(size, "component").select(F.col("node").alias("gene"), F.col("component").alias("cluster"), "size")


def modules_by_average_linkage(distances: DataFrame, height: float | None = None, min_size: int = 5) -> DataFrame:
    """``gene, cluster, size``: branches of the average-linkage tree below ``height``.

    ``distances`` has ``a, b, distance``. By default the tree is cut at 99 % of
    the way from the 5 % quantile of its merge heights up to the highest merge,
    so the cut follows the tree. Clusters are numbered by falling size
    (``clust.001``; ties by smallest gene); genes of smaller branches have none.
    """
    pairs = distances.select(F.col("a"), F.col("b"), F.col("distance").cast("double").alias("dist"))
    merges = cut(average_linkage(pairs))
    if height is None:
        low = exact_quantile(merges, [], "height", 0.05, "low").first()
        high = merges.agg(F.max("height")).first()[0]
        height = low[0] + 0.99 * (high - low[0]) if high is not None else 0.0
    genes = pairs.select(F.col("a").alias("gene")).union(pairs.select("b")).distinct()
    comp = connected_components(merges.where(F.col("height") <= height).select(F.col("into").alias("src"), F.col("gone").alias("dst")), genes.select(F.col("gene").alias("node")))
    comp = cut(comp)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    named = add_order(sizes, [F.desc("size"), F.asc("component")], "_i").select("component", "size", F.format_string("clust.%03d", "_i").alias("cluster"))
    return comp.join(named, "component", "left").select(F.col("node").alias("gene"), "cluster", "size")
