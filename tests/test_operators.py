"""Literal fixtures, invariants and brute-force comparisons on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.functions import distributions as D
from spectraloom.functions.ordered import exact_quantile, p_adjust_bh, running_totals
from spectraloom.operators import apms, cluster, elution, enrich, graph, ingest, models, normalize, propagation, relational, sites


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_condition_names(spark):
    d = spark.createDataFrame([("7dCold-3",), ("Ctl-9d",)], "c string")
    assert [r[0] for r in d.select(ingest.fix_condition_names("c")).collect()] == ["x.7dCold_3", "Ctl_9d"]


def test_term_names(spark):
    d = spark.createDataFrame([("membrane",), ("rna splicing",), ("GO_DNA_REPAIR",)], "c string")
    assert [r[0] for r in d.select(enrich.pretty_term("c")).collect()] == ["Membrane", "RNA splicing", "DNA repair"]


def test_contrasts_by_regex_with_back_references(spark):
    d = spark.createDataFrame([(f"{day}_{arm}",) for day in ("d1", "d2") for arm in ("ctl", "cold", "heat")], "c string")
    got = {r["name"] for r in ingest.contrasts_by_regex(d, "c", [r"^(d.)_(cold|heat)-\1_ctl$", r"^d2_(....)-d1_\1$"]).collect()}
    assert got == {"d1_cold-d1_ctl", "d1_heat-d1_ctl", "d2_cold-d2_ctl", "d2_heat-d2_ctl", "d2_cold-d1_cold", "d2_heat-d1_heat"}


def test_site_representative_prefers_finite_then_small_p(spark):
    inf = math.inf
    d = spark.createDataFrame(
        [("k", "P", "T7", "low", 0.5, 0.04), ("k", "P", "T7", "best", -1.25, 0.001), ("k", "P", "T7", "off", inf, None),
         ("k", "P", "T8", "up", inf, None), ("k", "P", "T8", "down", -inf, None), ("k", "P", "T9", "alone", -inf, None)],
        "contrast_label string, Gene_Name string, aaPos string, phSiteCombo string, log2FC double, pvalue double",
    )
    got = {r["phSiteCombo"] for r in sites.choose_site_representatives(d).where("representative").collect()}
    assert got == {"best", "alone"}


def test_every_label_in_both_brackets(spark):
    texts = [(f"A{r[0]}{o}{n}{c}G", f"A{r[0]}({t})G") for r, n, t in sites.LABELS.values() for o, c in ("[]", "()")] + [("AK(Dimethyl (K))G", "AK(dmet)G"), ("AN[Dimethyl (N)]G", "AN(dmet)G")]
    d = spark.createDataFrame(texts, "a string, want string")
    assert d.where(sites.convert_named_mods("a") != F.col("want")).count() == 0


def test_grid_duplicates_null_levels_and_null_keys(spark):
    d = spark.createDataFrame([(None, "x", 5.0), ("a", "y", 1.0), ("b", None, 9.0)], "k string, c string, v double")
    assert {(r.k, r.c, r.v) for r in relational.complete_grid(d, ["k"], "c", "v").collect()} == {(None, "x", 5.0), (None, "y", None), ("a", "x", None), ("a", "y", 1.0)}


def test_named_and_mass_tags(spark):
    d = spark.createDataFrame([("_AS[Phospho (STY)]M(Oxidation (M))K[Acetyl (K)]_", "n[42.0106]AS[79.9663]C[57.0215]")], "a string, b string")
    r = d.select(sites.convert_named_mods("a").alias("a"), sites.convert_named_mods("a", keep_only=["PH"]).alias("k"), sites.convert_mass_mods("b").alias("b"), sites.clean_sequence("a").alias("c")).first()
    assert r["a"] == "_AS(ph)M(ox)K(kac)_" and r["k"] == "_AS(ph)MK_" and r["b"] == "A(ac)S(ph)C(cam)" and r["c"] == "ASMK"


def test_alignment(spark):
    d = spark.createDataFrame([("ACDEFGH", "ACDFGH"), ("MKT", "MKT")], "from_seq string, to_seq string")
    got = {(r["from_seq"], r["aligned_from"], r["aligned_to"]) for r in sites.align_pairs(d, gap_open=2.0, gap_extend=1.0).collect()}
    assert got == {("ACDEFGH", "ACDEFGH", "ACD-FGH"), ("MKT", "MKT", "MKT")}


def test_distribution_tails():
    assert D.t_upper(np.array([2.0]), np.array([5.0]))[0] == pytest.approx(0.05096974, abs=1e-7)
    assert D.t_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228138852, abs=1e-7)
    assert D.f_upper(np.array([3.0]), np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.09536743, abs=1e-6)
    exact = sum(math.comb(10, k) * math.comb(40, 12 - k) for k in range(4, 11)) / math.comb(50, 12)
    assert math.exp(D.hypergeom_upper_ln(np.array([4.0]), np.array([10.0]), np.array([50.0]), np.array([12.0]))[0]) == pytest.approx(exact, rel=1e-10)


def test_quantile_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(int(g), float(round(v, 2))) for g, v in zip(rng.integers(0, 4, 3000), rng.normal(size=3000))]
    d = spark.createDataFrame(data, "g int, v double")
    for p in (0.0, 0.125, 0.5, 0.93, 1.0):
        got = {r["g"]: r["q"] for r in exact_quantile(d, ["g"], "v", p, "q").collect()}
        for g in range(4):
            assert got[g] == pytest.approx(np.quantile([v for k, v in data if k == g], p), abs=1e-12)


def test_bucketed_running_totals_equal_plain(spark):
    d = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    a = sorted(rows(running_totals(d, ["k"], "v", sums=["n"], maxima=["v"], buckets=7)))
    b = sorted(rows(running_totals(d, ["k"], "v", sums=["n"], maxima=["v"])))
    assert a == b


def test_bh(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5, None])], "i int, p double")
    got = {r["i"]: r["q"] for r in p_adjust_bh(d, "p", "q").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.04, 0.04, 0.04, 0.5]) and got[4] is None


def test_permuted_index_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 1000):
        d = spark.range(n).select(relational.permuted_index(F.col("id"), F.lit(11).cast("bigint"), F.lit(n).cast("bigint")).alias("x"))
        assert sorted(r["x"] for r in d.collect()) == list(range(n))


def _brute_complete(dist, names, height):
    groups = [[n] for n in names]
    gap = lambda a, b: max(dist.get((min(x, y), max(x, y)), math.inf) for x in a for y in b)
    while len(groups) > 1:
        d, _, _, i, j = min((gap(a, b), min(a), min(b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2))
        if d > height:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_complete_linkage_against_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"n{i:02d}" for i in range(25)]
    xy = rng.random((25, 2))
    dist = {(a, b): float(np.hypot(*(xy[i] - xy[j]))) for (i, a), (j, b) in itertools.combinations(enumerate(names), 2)}
    pairs = spark.createDataFrame([(a, b, d) for (a, b), d in dist.items() if d <= 0.4], "a string, b string, dist double")
    got = {}
    for r in cluster.complete_linkage(pairs, spark.createDataFrame([(n,) for n in names], "node string")).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == _brute_complete(dist, names, 0.4)


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]


def _dense():
    names = sorted({n for e in EDGES for n in e})
    a = np.zeros((len(names), len(names)))
    for s, t in EDGES:
        a[names.index(s), names.index(t)] = a[names.index(t), names.index(s)] = 1
    return names, a


def test_propagation_against_dense_matrices(spark):
    names, a = _dense()
    e = spark.createDataFrame(EDGES, "src string, dst string")
    h = spark.createDataFrame([("a", 2.0), ("d", 1.0), ("x", 1.0)], "node string, heat double")
    v = np.array([{"a": 2.0, "d": 1.0, "x": 1.0}.get(n, 0.0) for n in names])
    s = 0.3 * np.linalg.inv(np.eye(len(names)) - 0.7 * a @ np.diag(1 / a.sum(0)))
    got = {r["node"]: r["heat"] for r in graph.random_walk(e, h, 0.3, tolerance=1e-10).collect()}
    assert [got.get(n, 0.0) for n in names] == pytest.approx(list(s @ v), abs=1e-7)
    assert sum(got.values()) == pytest.approx(v.sum(), abs=1e-6)
    lap = np.diag(a.sum(0)) - a
    w, q = np.linalg.eigh(lap)
    diff = {r["node"]: r["heat"] for r in graph.heat_diffusion(e, h, 0.4).collect()}
    assert [diff.get(n, 0.0) for n in names] == pytest.approx(list(q @ np.diag(np.exp(-0.4 * w)) @ q.T @ v), abs=1e-7)
    c = {(r["to"], r["from"]): r["contributed_heat"] for r in graph.heat_contributions(e, h, spark.createDataFrame([("e",)], "node string"), 0.3, tolerance=1e-10).collect()}
    assert c[("e", "a")] == pytest.approx(s[names.index("e"), names.index("a")] * 2.0, abs=1e-7)


def test_components_forest_and_matching(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    comp = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert comp == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}
    assert graph.spanning_forest(e).count() == 5
    order = {e: i for i, e in enumerate(EDGES)}
    ranked = spark.createDataFrame([(s, t, order[(s, t)]) for s, t in EDGES], "src string, dst string, o int")
    used, want = set(), set()
    for s, t in EDGES:
        if s not in used and t not in used:
            used |= {s, t}
            want.add((s, t))
    assert set(rows(graph.one_edge_per_node(ranked, [F.col("o")]))) == want


def test_permutation_heats_are_conserved(spark):
    e = spark.createDataFrame(EDGES[:5], "src string, dst string")
    h = spark.createDataFrame([("a", 2.0), ("d", 1.0)], "node string, heat double")
    r = propagation.propagate_heats(e, h, 0.4, n_perm=8, tolerance=1e-8).toPandas()
    assert r["prop_heat"].sum() == pytest.approx(3.0, abs=1e-5)
    assert r["expect_heat"].sum() == pytest.approx(3.0, abs=1e-5)
    assert r["pvalue"].between(0, 1).all() and len(r) == 5


def test_median_polish_recovers_effects(spark):
    col = {"r1": 0.0, "r2": 1.0, "r3": -2.0}
    d = spark.createDataFrame([(f"f{i}", c, 10 + i + e) for i in range(9) for c, e in col.items()], "f string, r string, v double")
    overall, effect, _ = normalize.median_polish(d, "f", "r", "v")
    assert {k: v - effect["r1"] for k, v in effect.items()} == pytest.approx({"r1": 0.0, "r2": 1.0, "r3": -2.0})
    assert overall + effect["r1"] == pytest.approx(14.0)


def test_complete_grid_fails_on_repeated_cells(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 1.0)], "k string, c string, v double")
    with pytest.raises(Exception):
        relational.complete_grid(d, ["k"], "c", "v").collect()


def test_imputation_keeps_observed_and_fills_missing(spark):
    data = [(f"b{b}", f"b{b}_{r}", "P", None if (b + r) % 3 == 0 else 22.0 + b + 0.1 * r) for b in range(4) for r in range(3)]
    d = spark.createDataFrame(data, "bait string, run string, preyProtein string, log2Intensity double")
    got = {r["run"]: r for r in apms.impute_missing_by_prey(d, floor=20.0).collect()}
    for b, run, _, v in data:
        assert got[run]["replaceNA"] is not None
        if v is not None:
            assert got[run]["replaceNA"] == v
        else:
            assert got[run]["SD"] >= 0.33


def test_linear_model_matches_numpy(spark):
    rng = np.random.default_rng(1)
    data = [("k", g, s, float(y)) for g, s, y in zip(rng.choice(list("abc"), 60), rng.choice(list("uv"), 60), rng.normal(size=60))]
    d = spark.createDataFrame(data, "k string, g string, s string, y double")
    got = {r["term"]: r["estimate"] for r in models.linear_models(d, "k", "y", {"m": ["g", "s"]}).where("kind = 'coef'").collect()}
    x = np.array([[1, g == "b", g == "c", s == "v"] for _, g, s, _ in data], float)
    want = np.linalg.lstsq(x, np.array([r[3] for r in data]), rcond=None)[0]
    assert [got[t] for t in ("(Intercept)", "gb", "gc", "sv")] == pytest.approx(list(want))


def test_polynomial_choice(spark):
    data = [("k", float(t), s, t * t * 0.5 + (s == "v") + 0.01 * ((t * 7 + len(s)) % 3)) for t in range(6) for s in ("u", "v")]
    d = spark.createDataFrame(data, "k string, rankTime double, SUBJECT string, LogIntensities double")
    f = models.fit_polynomial_powers(d, "k", min_power=1).where("power = best").first()
    assert f["best"] == 2 and f["largestDelta"] == pytest.approx(12.5, abs=0.1)


def test_factorization_reconstructs(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 2)) @ rng.random((2, 6))
    d = spark.createDataFrame([(f"r{i}", f"c{j}", float(x[i, j])) for i in range(30) for j in range(6)], "r string, c string, v double")
    w, h = models.factorize_nonnegative(d, "r", "c", "v", 2, rounds=60)
    res = models.factor_residuals(d, "r", "c", "v", w, h).agg(F.max(F.abs("residual"))).first()[0]
    assert res < 0.05 and w.agg(F.min("w")).first()[0] >= 0


def test_peaks_and_line_clusters(spark):
    bump = [math.exp(-((f - 20) ** 2) / 8) + 0.5 * math.exp(-((f - 40) ** 2) / 8) for f in range(1, 61)]
    d = spark.createDataFrame([("s", "p", f, v) for f, v in zip(range(1, 61), bump)], "sample string, protein string, fraction int, x double")
    p = elution.find_peaks(d, "x").collect()
    assert [r["peakLocation"] for r in sorted(p, key=lambda r: r["peakLocation"])] == [20, 40] and all(r["goodPeak"] for r in p)
    pts = spark.createDataFrame([("k", x) for x in (1.0, 1.5, 2.8, 3.4, 9.0)], "k string, x double")
    got = [r["c"] for r in cluster.linkage_on_line(pts, ["k"], "x", 2.0, "c").orderBy("x").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_count_model_prior_in_closed_form(spark):
    inter = spark.createDataFrame([(f"t{r}", p, s) for r in range(3) for p, s in (("A", 40), ("B", 2))] + [("c0", "B", 2), ("c1", "B", 3)], "run string, prey string, spc long")
    baits = spark.createDataFrame([(f"t{r}", "x", "T") for r in range(3)] + [("c0", "ctl", "C"), ("c1", "ctl", "C")], "run string, bait string, treatment string")
    preys = spark.createDataFrame([("A", "A"), ("B", "B")], "prey string, preyGene string")
    d, beta = apms.saint_spc(inter, baits, preys)
    s = {r["prey"]: r for r in d.collect()}
    assert beta == pytest.approx(0.0, abs=1e-9)
    assert s["A"]["avgScore"] > 0.99 and s["B"]["avgScore"] < 0.1 and s["A"]["bfdr"] == 0


def test_matched_samples_use_each_background_once(spark):
    b = spark.createDataFrame([(f"b{i}", 5, 2) for i in range(6)], "bait string, countPrey int, windowRadius int")
    bg = spark.createDataFrame([(f"g{i}", 4 + i % 3) for i in range(12)], "bait string, countPrey int")
    got = apms.size_matched_sample(b, bg, 3).toPandas()
    assert len(got) == 18 and not got.duplicated(["sample", "cand"]).any()
