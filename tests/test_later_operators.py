"""Propagation, permutation nulls, tiles, set pairs, alignment, mixed models, linkage, local fits, factors, selection: against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import distributions as dist
from spectraloom.functions import local, ordered
from spectraloom.operators import apms, cluster, elution, enrich, factorscan, graph, ingest, mixed, propagation, relational, sites

# --- propagation ----------------------------------------------------------------


def network(seed, n=24):
    rng = np.random.default_rng(seed)
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(p)) for p in rng.integers(0, n, (2 * n, 2)).tolist() if p[0] != p[1]}
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = 1
    return a, [(f"n{i:02d}", f"n{j:02d}") for i, j in pairs] + [("n00", "n00"), ("n01", "n00")]


def dense(a, restart):
    d = a.sum(axis=0)
    return restart * np.linalg.inv(np.eye(len(a)) - (1 - restart) * a / d)


def vector(rows, n, column):
    out = np.zeros(n)
    for r in rows:
        out[int(r["node"][1:])] = r[column]
    return out


@pytest.fixture(scope="module")
def net(spark):
    a, edges = network(3)
    heats = [(f"n{i:02d}", float(1 + i * i % 7)) for i in range(0, 24, 2)] + [("n04", 0.5), ("other", 9.0), ("n05", None)]
    h = np.zeros(24)
    for node, v in heats:
        if node != "other" and v is not None:
            h[int(node[1:])] = max(h[int(node[1:])], v)
    return a, h, spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(heats, "node string, heat double")


@pytest.mark.parametrize("edges_sent, restart", [(propagation.NETWORK_EDGES, 0.5), (propagation.NETWORK_EDGES, 0.1), (0, 0.7)])
def test_self_heat(net, edges_sent, restart):
    a, _, edges, _ = net
    got = vector(propagation.self_heats(edges, restart, 1e-11, edges_sent).collect(), 24, "self")
    assert np.abs(got - np.diag(dense(a, restart))).max() < 1e-9


def expm(m):
    values, vectors = np.linalg.eigh(m)
    return vectors @ np.diag(np.exp(values)) @ vectors.T


@pytest.mark.parametrize("transposed", [False, True])
@pytest.mark.parametrize("remove", [False, True])
def test_walk_operator(net, transposed, remove):
    a, h, edges, heats = net
    s = dense(a, 0.6)
    s = s.T if transposed else s
    if remove:
        s = s - 0.6 * np.eye(24)
        s = s / s.sum(axis=0)
    got = vector(propagation.walk_operator(edges, heats, 0.6, transposed, remove, tolerance=1e-10).collect(), 24, "heat")
    assert np.abs(got - s @ h).max() < 1e-8


@pytest.mark.parametrize("remove, edges_sent", [(False, 0), (True, propagation.NETWORK_EDGES), (True, 0)])
def test_diffusion_operator(net, remove, edges_sent):
    a, h, edges, heats = net
    s = expm(-0.2 * (np.diag(a.sum(axis=0)) - a))
    if remove:
        s = s - np.diag(np.diag(s))
        s = s / s.sum(axis=0)
    got = vector(propagation.diffusion_operator(edges, heats, 0.2, remove, network_edges=edges_sent).collect(), 24, "heat")
    assert np.abs(got - s @ h).max() < 1e-6


def test_diffusion_of_a_large_rate_goes_in_steps(net):
    a, h, edges, heats = net
    s = expm(-0.5 * (np.diag(a.sum(axis=0)) - a))
    got = vector(graph.heat_diffusion(edges, propagation.known_heats(edges, heats, []), 0.5, largest_rate=2).collect(), 24, "heat")
    assert np.abs(got - s @ h).max() < 1e-6
    wide = propagation.Network.of(edges, 1000)
    far = expm(-200.0 * (np.diag(a.sum(axis=0)) - a))
    assert np.abs(wide.diffused(np.arange(24), 200.0, 1e-12) - far).max() < 1e-8


def test_largest_component_only(spark):
    edges = spark.createDataFrame([("n00", "n01"), ("n01", "n02"), ("n10", "n11")], "src string, dst string")
    heats = spark.createDataFrame([("n00", 1.0), ("n10", 1.0)], "node string, heat double")
    assert {r.node for r in propagation.walk_operator(edges, heats, 0.5).collect()} == {"n00", "n01", "n02"}
    assert {r.node for r in propagation.walk_operator(edges, heats, 0.5, largest=False).collect()} == {"n00", "n01", "n02", "n10", "n11"}


def plain_expected(s, h, seen, only, network_only):
    columns = seen if only else np.ones(len(h), bool)
    out = s[:, columns].sum(axis=1)
    if network_only:
        out = out - np.where(columns, np.diag(s), 0)
    return out * h.sum() / columns.sum()


@pytest.mark.parametrize("observed_only, network_only", list(itertools.product([False, True], repeat=2)))
def test_propagate_heats(net, observed_only, network_only):
    a, h, edges, heats = net
    s, seen = dense(a, 0.5), h > 0
    walked = s @ h
    rows = {}
    for sent, n_perm in ((propagation.NETWORK_EDGES, 2000), (0, 60)):
        d = propagation.propagate_heats(edges, heats, 0.5, n_perm, network_only, observed_only, network_edges=sent, tolerance=1e-12)
        rows[sent] = d.orderBy("node").collect()
    for got in rows.values():
        assert np.abs(vector(got, 24, "prop_heat") - walked).max() < 1e-8
        assert np.abs(vector(got, 24, "self_heat") - h * np.diag(s)).max() < 1e-8
        assert np.abs(vector(got, 24, "expect_heat") - plain_expected(s, h, seen, observed_only, network_only)).max() < 1e-8
    rng, places = np.random.default_rng(9), np.flatnonzero(seen) if observed_only else np.arange(24)
    x = np.zeros((24, 4000))
    for i in range(4000):
        x[places, i] = rng.permutation(h[places])
    y = s @ x - (x * np.diag(s)[:, None] if network_only else 0)
    beat = walked - (h * np.diag(s) if network_only else 0)
    want = (y >= beat[:, None] - 1e-12).mean(axis=1)
    for sent, slack in ((propagation.NETWORK_EDGES, 0.06), (0, 0.3)):
        got = rows[sent]
        assert np.abs(vector(got, 24, "pvalue") - want).max() < slack
        assert np.abs(vector(got, 24, "mean_perm_heat") - y.mean(axis=1)).max() < 5 * slack
        z = (beat - vector(got, 24, "mean_perm_heat")) / vector(got, 24, "sd_perm_heat")
        assert np.abs(vector(got, 24, "z") - z).max() < 1e-9
    assert np.abs(vector(rows[propagation.NETWORK_EDGES], 24, "median_perm_heat") - np.median(y, axis=1)).max() < 0.2


@pytest.mark.parametrize("network_only", [False, True])
def test_propagate_multi(spark, net, network_only):
    a, h, edges, heats = net
    s = dense(a, 0.5)
    both = heats.withColumn("set", F.lit("one")).unionByName(heats.where("heat > 2").withColumn("set", F.lit("two")))
    sets = {"one": h, "two": np.where(h > 2, h, 0)}
    total, want = 0, {}
    for name, x in sets.items():
        seen = x > 0
        x = 24 * x / x.sum()
        walked = s @ x - (x * np.diag(s) if network_only else 0)
        expect = plain_expected(s, x, seen, len(set(x[seen])) > 1, network_only)
        want[name] = (x, expect, walked)
        total = total + np.log2(walked) - np.log2(expect)
    p = {}
    for sent, n_perm in ((propagation.NETWORK_EDGES, 1500), (0, 60)):
        got = propagation.propagate_multi(edges, both, 0.5, n_perm, network_only, network_edges=sent, tolerance=1e-12).collect()
        for name, (x, expect, walked) in want.items():
            for label, v in (("heat0", x), ("expect", expect), ("prop", walked)):
                assert np.abs(vector(got, 24, f"{label}_{name}") - v).max() < 1e-7, (name, label)
        assert np.abs(vector(got, 24, "log2_prop_vs_expected") - total).max() < 1e-7
        p[sent] = vector(got, 24, "pvalue")
    assert np.abs(p[0] - p[propagation.NETWORK_EDGES]).max() < 0.3


def test_propagation_without_heats(spark, net):
    none = spark.createDataFrame([], "node string, heat double")
    assert propagation.propagate_heats(net[2], none, 0.5, 10).count() == 0


# --- permutation nulls ----------------------------------------------------------

def test_prefix_scores_equal_a_walk_over_all_ranks():
    rng = np.random.default_rng(0)
    n = 60
    score = np.sort(rng.normal(size=n))[::-1].copy()
    score[20:30] = 0
    order = rng.permutation(n)[:25]
    sizes = np.array([1, 2, 7, 25])
    for weight, kind in ((1.0, "std"), (0.0, "pos"), (2.0, "neg")):
        got = enrich._prefix_scores(order + 1, score[order], np.arange(25), n, sizes, weight, kind)
        for k, es in zip(sizes, got, strict=True):
            hit = np.isin(np.arange(n), order[:k])
            v = np.where(hit, np.abs(score) ** weight, 0)
            up = np.cumsum(v) / v.sum() if v.sum() > 0 else np.cumsum(hit) / k
            run = up - np.cumsum(~hit) / (n - k)
            before = np.concatenate([[0], run[:-1]])[hit] - 0
            top = run[hit].max()
            low = (up[hit] - v[hit] / (v.sum() if v.sum() > 0 else 1) - (0 if v.sum() > 0 else 1 / k) - (np.cumsum(~hit) / (n - k))[hit]).min()
            want = {"pos": top, "neg": low, "std": 0.0 if abs(top + low) < 1e-12 else (top if top > -low else low)}[kind]
            assert abs(es - want) < 1e-9 and len(before) == k


def test_null_scores_share_one_order(spark):
    ranked = enrich.ranked_scores(spark.createDataFrame([("g", f"x{i}", float(i % 13) - 6) for i in range(80)], "grp string, gene string, score double"))
    sizes = spark.createDataFrame([("g", 3), ("g", 10)], "grp string, size long")
    null = enrich.null_scores(ranked, sizes, 300, 1.0, "std", 1).toPandas()
    assert (null.groupby("size").size() == 300).all() and null["null_es"].abs().max() <= 1 + 1e-9
    rng, score = np.random.default_rng(4), np.array([r.score for r in ranked.orderBy("rank").collect()])
    for k in (3, 10):
        plain = [enrich._prefix_scores(o + 1, score[o], np.arange(k), 80, np.array([k]), 1.0, "std")[0] for o in (rng.permutation(80)[:k] for _ in range(2000))]
        mine = np.sort(null[null["size"] == k]["null_es"].to_numpy())
        grid = np.linspace(-1, 1, 41)
        gap = np.abs(np.searchsorted(mine, grid) / len(mine) - np.searchsorted(np.sort(plain), grid) / len(plain)).max()
        assert gap < 0.1  # two-sample distance; 0.1 is beyond the 1 % point


# --- column tiles, set pairs ----------------------------------------------------

def test_column_gram_over_several_tiles(spark):
    rng = np.random.default_rng(0)
    columns, rows = 1100, 30
    x = np.where(rng.random((rows, columns)) < 0.3, np.nan, rng.normal(size=(rows, columns)))
    long = [(i, f"c{j:04d}", float(x[i, j])) for i in range(rows) for j in range(columns) if not np.isnan(x[i, j])]
    got = relational.column_gram(spark.createDataFrame(long, "r int, c string, v double"), ["r"], "c", "v").toPandas()
    m, z = ~np.isnan(x), np.nan_to_num(x)
    a, b = (got[c].str[1:].astype(int).to_numpy() for c in ("a", "b"))
    full = {"n": m.T.astype(float) @ m, "sa": z.T @ m, "sb": m.T @ z, "saa": (z * z).T @ m, "sbb": m.T @ (z * z), "sab": z.T @ z}
    assert (a <= b).all() and len(got) == int((np.triu(full["n"]) > 0).sum())
    for name, want in full.items():
        assert np.abs(got[name].to_numpy() - want[a, b]).max() < 1e-9, name


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.8, 1.0])
def test_similar_sets(spark, overlap, threshold):
    rng = np.random.default_rng(5)
    sets = {f"s{i:02d}": set(rng.choice(40, int(rng.integers(1, 15)), replace=False).tolist()) for i in range(40)}
    sets |= {"s40": set(sets["s03"]), "s41": {0, 1, 2, 99}}
    rows = [(k, f"g{x}") for k, v in sets.items() for x in v] + [("s00", None), (None, "g1")] + [(k, f"g{x}") for k, v in sets.items() for x in list(v)[:1]]
    got = {(r.a, r.b): r.score for r in relational.similar_sets(spark.createDataFrame(rows, "k string, x string"), "k", "x", threshold, overlap).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        score = shared / (min(len(sets[a]), len(sets[b])) if overlap else len(sets[a] | sets[b]))
        if score >= threshold:
            want[a, b] = score
    assert got == want


def test_overlap_tests_and_windows(spark):
    rng = np.random.default_rng(6)
    preys = {f"b{i}": set(rng.choice(30, int(rng.integers(1, 12)), replace=False).tolist()) for i in range(14)}
    d = spark.createDataFrame([(b, f"p{x}") for b, v in preys.items() for x in v], "bait string, prey string")

    def tail(k, m, n, total=100):
        return sum(math.comb(m, i) * math.comb(total - m, n - i) for i in range(k, min(m, n) + 1)) / math.comb(total, n)

    got = {(r.bait1, r.bait2): (r.shared, r.fisherP) for r in apms.prey_overlap_fisher(d, background=100).collect()}
    assert len(got) == 14 * 13 // 2
    for (a, b), (shared, p) in got.items():
        assert a < b and shared == len(preys[a] & preys[b]) and abs(p - tail(shared, len(preys[a]), len(preys[b]))) < 1e-9
    one, two = d.where("bait < 'b3'"), d
    between = {(r.bait1, r.bait2) for r in apms.prey_overlap_fisher_between(one, two, 100).collect()}
    first = {b for b in preys if b < "b3"}
    assert between == {(a, b) for a in first for b in set(preys) - first}
    windows = {r.countPrey: (r.numBaitsWithCP, r.windowSize) for r in apms.prey_size_windows(d, 5).collect()}
    sizes = [len(v) for v in preys.values()]
    for c in range(1, max(sizes) + 1):
        radius = next((r for r in range(max(sizes)) if sum(abs(s - c) <= r for s in sizes) > 5), max(sizes))
        assert windows[c] == (sizes.count(c), radius)
    assert len(windows) == max(sizes)


# --- alignment ------------------------------------------------------------------

def aligned_score(a, b, match, mismatch, gap_open, gap_extend):
    total, gap = 0.0, None
    for x, y in zip(a, b, strict=True):
        side = "a" if x == "-" else "b" if y == "-" else None
        if side is None:
            total += match if x == y else mismatch
        else:
            total -= gap_extend + (gap_open if side != gap else 0)
        gap = side
    return total


def test_alignment_in_bands_equals_the_full_table(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = "".join(rng.choice(list("ACGT"), int(rng.integers(0, 90))))
        b = list(a)
        for _ in range(int(rng.integers(0, 12))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 4))] = rng.choice(list("ACGT"), int(rng.integers(0, 5))).tolist()
        b = "".join(b)
        monkeypatch.setattr(sites, "TRACE_CELLS", 10**9)
        whole = sites._Aligner(a, b, 4.0, -3.0, 6.0, 1.0).align()
        monkeypatch.setattr(sites, "TRACE_CELLS", 60)
        bands = sites._Aligner(a, b, 4.0, -3.0, 6.0, 1.0).align()
        assert bands == whole and whole[0].replace("-", "") == a and whole[1].replace("-", "") == b
        # best score by plain recursion over three states
        neg = -1e18
        m, n = len(a), len(b)
        h = np.full((m + 1, n + 1, 3), neg)
        h[0, 0, 0] = 0
        for i in range(m + 1):
            for j in range(n + 1):
                if i and j:
                    h[i, j, 0] = max(h[i - 1, j - 1]) + (4.0 if a[i - 1] == b[j - 1] else -3.0)
                if i:
                    h[i, j, 1] = max(h[i - 1, j, 1] - 1, max(h[i - 1, j, 0], h[i - 1, j, 2]) - 7)
                if j:
                    h[i, j, 2] = max(h[i, j - 1, 2] - 1, max(h[i, j - 1, 0], h[i, j - 1, 1]) - 7)
        assert abs(aligned_score(*whole, 4.0, -3.0, 6.0, 1.0) - h[m, n].max()) < 1e-9


def test_a_genome_sized_pair_stays_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("ACGT"), 6000))
    b = a[:2000] + a[2300:] + "ACGT"
    tracemalloc.start()
    x, y = sites._Aligner(a, b, 4.0, -3.0, 10.0, 4.0).align()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000 and x.replace("-", "") == a and y.count("-") == 300 and x.count("-") == 4


def test_modification_patterns(spark):
    texts = ["S[79.9663]K", "n[42]AK[1.]", "A[B]C", "S[Phospho (STY)]T(Oxidation (M))", "_(ac)K[Acetyl (Protein N-term)]", "K(1(2))", "M(ox)"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = d.select("i", F.regexp_replace("t", sites.ANY_MASS, "").alias("m"), F.regexp_replace("t", sites.ANY_NAMED, "").alias("n"), ingest.missed_cleavages("t").alias("c")).orderBy("i").collect()
    assert [r.m for r in got][:3] == ["SK", "AK[1.]", "A[B]C"]
    assert [r.n for r in got] == ["S[79.9663]K", "n[42]AK[1.]", "A[B]C", "ST", "_(ac)K", "K(1(2))", "M(ox)"]
    cleaved = spark.createDataFrame([("AKPRKAK",), ("KKA",), ("RPKX",)], "p string").select(ingest.missed_cleavages("p").alias("c")).collect()
    assert [r.c for r in cleaved] == [1, 1, 0]


# --- mixed models ---------------------------------------------------------------

def test_random_intercept_equals_dense_reml(spark):
    rng = np.random.default_rng(2)
    frames = []
    for key in ("k1", "k2"):
        rows = [(key, f"s{s}", g) for s in range(8) for g in "AB" for _ in range(int(rng.integers(1, 4)))]
        d = pd.DataFrame(rows, columns=["key", "subject", "grp"])
        d["y"] = d["subject"].map(dict(zip(sorted(set(d["subject"])), rng.normal(0, 1.5, 8), strict=True))) + (d["grp"] == "B") * 0.7 + rng.normal(0, 1, len(d))
        frames.append(d)
    flat = pd.DataFrame({"key": "k3", "subject": "s0", "grp": ["A", "B"], "y": [1.0, 2.0]})
    got = mixed.mixed_models(spark.createDataFrame(pd.concat([*frames, flat])), "key", "y", ["grp"], "subject", "grp").toPandas()
    assert got[got["key"] == "k3"]["kind"].tolist() == ["error"]
    for d in frames:
        x = np.column_stack([np.ones(len(d)), d["grp"] == "B"]).astype(float)
        z = (d["subject"].to_numpy()[:, None] == np.array(sorted(set(d["subject"])))[None]).astype(float)
        y = d["y"].to_numpy()

        def fit(u, e, x=x, z=z, y=y):
            vi = np.linalg.inv(e * np.eye(len(y)) + u * z @ z.T)
            c = np.linalg.inv(x.T @ vi @ x)
            beta = c @ x.T @ vi @ y
            r = y - x @ beta
            return -np.linalg.slogdet(vi)[1] - np.linalg.slogdet(c)[1] + r @ vi @ r, beta, c

        mine = got[got["key"] == d["key"].iloc[0]].set_index(["kind", "term"])
        u, e = mine.loc[("variance", "subject"), "estimate"], mine.loc[("variance", "residual"), "estimate"]
        best, beta, c = fit(u, e)
        assert all(best <= fit(u * s, e * t)[0] + 1e-9 for s in (0.99, 1, 1.01) for t in (0.99, 1, 1.01))
        row = mine.loc[("coef", "grpB")]
        assert abs(row["estimate"] - beta[1]) < 1e-6 and abs(row["SE"] - np.sqrt(c[1, 1])) < 1e-6
        contrast = mine.loc[("contrast", "A-B")]
        assert abs(contrast["estimate"] + beta[1]) < 1e-6 and 2 < contrast["df"] < len(d)


def test_balanced_random_intercept(spark):
    rng = np.random.default_rng(3)
    rows = [("k", f"s{s}", g, float(u + (g == "B") + rng.normal())) for s, u in enumerate(rng.normal(0, 2, 10)) for g in "ABC"]
    d = pd.DataFrame(rows, columns=["key", "subject", "grp", "y"])
    got = mixed.mixed_models(spark.createDataFrame(d), "key", "y", ["grp"], "subject", "grp").toPandas().set_index(["kind", "term"])
    y = d.pivot(index="subject", columns="grp", values="y").to_numpy()
    rest = y - y.mean(axis=1, keepdims=True) - y.mean(axis=0, keepdims=True) + y.mean()
    within, between = (rest**2).sum() / 18, 3 * y.mean(axis=1).var(ddof=1)
    assert abs(got.loc[("variance", "residual"), "estimate"] - within) < 1e-5 and abs(got.loc[("variance", "subject"), "estimate"] - (between - within) / 3) < 1e-5
    line = got.loc[("contrast", "A-B")]
    assert abs(line["SE"] - np.sqrt(2 * within / 10)) < 1e-6 and abs(line["df"] - 18) < 1e-2


# --- linkage --------------------------------------------------------------------

def plain_average(names, dist_of):
    groups = {n: [n] for n in names}
    out = []

    def apart(a, b):
        return float(np.mean([dist_of[min(x, y), max(x, y)] for x in groups[a] for y in groups[b]]))

    while len(groups) > 1:
        d, a, b = min((apart(a, b), a, b) for a, b in itertools.combinations(sorted(groups), 2))
        groups[a] += groups.pop(b)
        out.append((a, b, round(d, 9), len(groups[a])))
    return sorted(out, key=lambda r: (r[2], r[:2]))


def test_average_linkage(spark):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 0.4, (12, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    names = [f"g{i:02d}" for i in range(len(points))]
    dist_of = {(names[i], names[j]): float(np.linalg.norm(points[i] - points[j])) for i in range(len(names)) for j in range(i + 1, len(names))}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in dist_of.items()], "a string, b string, dist double")
    got = sorted(((r["into"], r["gone"], round(r["height"], 9), r["size"]) for r in cluster.average_linkage(pairs).collect()), key=lambda r: (r[2], r[:2]))
    assert got == plain_average(names, dist_of)
    modules = {r.gene: r.cluster for r in graph.modules_by_average_linkage(pairs.withColumnRenamed("dist", "distance"), 3.0).collect()}
    assert len(set(modules.values())) == 3 and all(len({modules[f"g{i:02d}"] for i in range(s, s + 12)}) == 1 for s in (0, 12, 24))
    cut_by_tree = graph.modules_by_average_linkage(pairs.withColumnRenamed("dist", "distance")).collect()
    assert {r.cluster for r in cut_by_tree} <= {"clust.001", "clust.002", "clust.003", None} and len(cut_by_tree) == 36


def test_line_clusters(spark):
    rng = np.random.default_rng(1)

    def plain(x, most):
        groups = [[v] for v in x]
        while len(groups) > 1:
            span = [b[-1] - a[0] for a, b in zip(groups, groups[1:], strict=False)]
            i = int(np.argmin(span))
            if span[i] > most:
                break
            groups[i] += groups.pop(i + 1)
        return np.repeat(np.arange(len(groups)), [len(g) for g in groups]).tolist()

    for _ in range(30):
        x = np.sort(np.round(rng.random(int(rng.integers(1, 60))) * 20, 1))
        assert cluster.line_clusters(x, 2.0).tolist() == plain(x, 2.0)
    rows = [(k, float(v)) for k in ("p", "q", None) for v in np.round(rng.random(80) * 60, 2)] + [("r", 1.0)]
    d = spark.createDataFrame(rows, "k string, x double")
    for bucket in (None, 2.0, 7.0):
        got = cluster.linkage_on_line(d, ["k"], "x", 2.0, "c", bucket).toPandas()
        for key in ("p", "q", None, "r"):
            mine = got[got["k"].isna() if key is None else got["k"] == key].sort_values(["x", "c"])
            assert mine["c"].tolist() == [c + 1 for c in plain(mine["x"].tolist(), 2.0)], (key, bucket)


# --- local regression, factors --------------------------------------------------

def test_local_values_equal_direct_fits():
    rng = np.random.default_rng(0)
    x = np.sort(rng.random(200) * 10)
    y = np.sin(x) + rng.normal(0, 0.1, 200)
    at = np.linspace(0, 10, 17)
    for span, degree in ((0.3, 1), (0.25, 2), (1.0, 1)):
        got = local.local_values(x, y, at, span, degree)
        k = int(np.ceil(span * 200))
        for place, value in zip(at, got, strict=True):
            d = np.abs(x - place)
            h = np.sort(d)[k - 1]
            w = np.clip(1 - (d / (1.001 * h)) ** 3, 0, None) ** 3 * (d <= h)
            v = np.vander(x - place, degree + 1, increasing=True) * np.sqrt(w)[:, None]
            assert abs(np.linalg.lstsq(v, y * np.sqrt(w), rcond=None)[0][0] - value) < 1e-7
    trend = local.robust_trend(x, np.where(np.arange(200) % 40 == 0, 50, 2 * x), 0.5)
    assert np.abs(trend - 2 * x).max() < 0.2  # outliers are weighed away


def test_loess_normalization_brings_samples_together(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(20, 3, 300)
    shift = {"a": lambda v: 0.0, "b": lambda v: 1 + 0.1 * (v - 20), "c": lambda v: -0.5}
    rows = [(s, f"p{i}", f, float(2 ** (v + move(v) + rng.normal(0, 0.02)))) for s, move in shift.items() for i, v in enumerate(base) for f in (1, 2)]
    d = spark.createDataFrame(rows, "sample string, protein string, fraction int, intensity double")
    got = elution.windowed_loess_normalize(d).toPandas()
    wide = np.log2(got.pivot(index=["protein", "fraction"], columns="sample", values="intensity"))
    assert len(got) == len(rows) and (wide.max(axis=1) - wide.min(axis=1)).median() < 0.1


def test_alignment_of_peaks_of_all_samples(spark):
    rng = np.random.default_rng(7)
    centre = rng.uniform(15, 60, 500)
    rows = []
    for sample, move in (("std", lambda c: c), ("late", lambda c: c + 2), ("early", lambda c: c * 0.95)):
        for i, c in enumerate(centre):
            rows.append((sample, f"p{i}", int(round(move(c))), float(move(c) + rng.normal(0, 0.01)), True))
    peaks = spark.createDataFrame(rows, "sample string, protein string, peakLocation int, cofmN double, goodPeak boolean")
    moved, curves = elution.align_peaks_to_standard(peaks, "std", min_per_fraction=0, first=1, last=72, start_at=5)
    got = moved.toPandas()
    got["truth"] = centre[got["protein"].str[1:].astype(int)]
    assert len(got) == len(rows) and {r.sample for r in curves.collect()} == {"std", "late", "early"}
    assert (got["cofmN_standardized"] - got["truth"]).abs().median() < 0.1
    f = elution.standard_fractions(spark.createDataFrame([("late", 32), ("none", 5)], "sample string, fraction int"), curves).collect()
    assert abs(next(r.standardFraction for r in f if r.sample == "late") - 30) < 0.3 and next(r.standardFraction for r in f if r.sample == "none") is None


def test_factorization_scan(spark):
    rng = np.random.default_rng(0)
    w, h = rng.random((60, 3)) ** 3, rng.random((3, 12)) ** 3
    x = w @ h
    d = spark.createDataFrame([(f"r{i}", f"c{j:02d}", float(x[i, j])) for i in range(60) for j in range(12)], "r string, c string, v double")
    fits, basis, coef = factorscan.factorization_scan(d, "r", "c", "v", [1, 2, 3], 4, 80)
    f = fits.toPandas()
    best = f[f["best"]].set_index("rank")["divergence"]
    assert len(f) == 12 and (f.groupby("rank")["best"].sum() == 1).all() and best[1] > best[2] > best[3] and best[3] < 0.05 * best[1]
    assert (best == f.groupby("rank")["divergence"].min()).all()
    b, c = basis.where("rank = 3").toPandas(), coef.where("rank = 3").toPandas()
    fit = b.pivot(index="row", columns="factor", values="w").to_numpy() @ c.pivot(index="factor", columns="col", values="h").to_numpy()
    names = sorted(f"r{i}" for i in range(60))
    assert abs(factorscan.divergence(x[[int(n[1:]) for n in names]], fit) - best[3]) < 0.05 * best[1]


# --- selection, order, tails ----------------------------------------------------

@pytest.mark.parametrize("values", [
    [1.0] * 50 + [1e300, -1e300, math.inf], [-1.7e308, 1.7e308, 0.0, -0.0, 1e-320, 2e-320], list(np.random.default_rng(0).normal(size=999)), [1.0, np.nextafter(1.0, 2)],
])
def test_radix_quantile(spark, values):
    rows = [(k, float(v)) for k in ("a", None) for v in values]
    d = spark.createDataFrame(rows, "k string, v double")
    for prob in (0.0, 0.77):
        got = ordered.radix_quantile(d, ["k"], "v", prob, "q").collect()
        v = sorted(values)
        at = (len(v) - 1) * prob
        a, z = v[math.floor(at)], v[math.ceil(at)]
        want = a + (at - math.floor(at)) * (z - a) if at != math.floor(at) else a
        assert len(got) == 2 and all(r.q == want or (math.isnan(want) and math.isnan(r.q)) or abs(r.q - want) <= 1e-9 * abs(want) for r in got), (prob, got, want)


def test_quantile_beyond_its_bracket_is_selected(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=5000), np.full(3000, 0.25), 10 ** rng.uniform(-200, 200, 2000)])
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    for prob in (0.5, 0.9):
        got = ordered.exact_quantile(d, [], "v", prob, "q", accuracy=60).first().q
        assert abs(got - np.quantile(values, prob)) <= 1e-9 * max(1, abs(got))


def test_total_order_numbers(spark):
    d = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "a long, b string")
    got = ordered.add_order(d, [F.col("a").desc()], "n").collect()
    assert {(r.a, r.n) for r in got} == {(a, 1000 - a) for a in range(1000)}


def test_tail_functions():
    x = np.concatenate([np.linspace(0.01, 30, 400), [1e3, 1e8]])
    assert max(abs(a - math.lgamma(b)) / max(1, abs(math.lgamma(b))) for a, b in zip(dist._lgamma(x), x, strict=True)) < 1e-13
    df = np.array([1.0, 2.0, 5.0, 5.0, 30.5, np.nan])
    q = dist.t_quantile(0.975, df)
    assert np.allclose(q[:4], [12.706204736, 4.3026527297, 2.5705818356, 2.5705818356], rtol=1e-9) and np.isnan(q[5])
    assert np.abs(dist.t_upper(q[:5], df[:5]) - 0.025).max() < 1e-12
