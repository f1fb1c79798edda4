"""Steps that a finding of round 3 named: the rows stay, the work that made them grow does not."""

import numpy as np
import pytest

from spectraloom.functions import ordered
from spectraloom.operators import apms, cluster, elution, ids, relational, sites


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("other", "other")
    return out, n


def test_small_components_are_linked_inside_tasks(spark, monkeypatch):
    # a path whose links grow takes a round a link; two more components, of equal distances and of random ones
    rng = np.random.default_rng(4)
    pairs = [(f"p{i:02}", f"p{i + 1:02}", 1.0 + i) for i in range(30)] + [(f"q{i}", f"q{j}", 1.0) for i in range(4) for j in range(i + 1, 4)]
    pairs += [(f"r{i:02}", f"r{j:02}", float(rng.integers(1, 6))) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.7]
    d = spark.createDataFrame(pairs, "a string, b string, dist double")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p[:2]} | {"alone"})], "node string")
    (got, n) = jobs_of(spark, "linkage", lambda: {r.node: r.cluster for r in cluster.complete_linkage(d, nodes).collect()})
    assert n < 80
    few = [p for p in pairs if p[0] >= "q"]
    monkeypatch.setattr(cluster, "LOCAL_LINKS", 10)
    some = {r.node: r.cluster for r in cluster.complete_linkage(spark.createDataFrame(few, "a string, b string, dist double"), nodes).collect()}
    assert len(got) == len(some) == nodes.count()
    assert {k: v for k, v in got.items() if k >= "q"} == {k: v for k, v in some.items() if k >= "q"}
    assert got["alone"] == "alone" and got["q3"] == "q0" and got["p01"] == "p00" and got["p02"] == "p02"


def test_complex_pairs_are_not_gathered(spark):
    d = spark.createDataFrame([("1", "x", "b;a;a"), ("1", "x", "c;a"), ("1", "x", "a;b"), ("2", "y", "a"), (None, None, "m;n"), ("3", "z", None)], "complex_id string, complex_name string, subunits_gene_name string")
    for ordered_ in (True, False):
        got = apms.corum_pairs(d, ordered=ordered_)
        want = {("1", "a", "b"), ("1", "a", "c"), (None, "m", "n")}
        want |= {(c, b, a) for c, a, b in want} | {("1", x, x) for x in "abc"} | {("2", "a", "a"), (None, "m", "m"), (None, "n", "n")} if ordered_ else set()
        rows = [(r.complex_id, r.gene1, r.gene2) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
        assert "keys=[complex_id#" in plan(got) and "gene2#" not in "".join(x for x in plan(got).splitlines() if "Exchange" in x)


def test_rows_of_few_groups_stay_for_quantiles(spark):
    rows = [(g, float(x)) for g in "ab" for x in range(40)] + [(None, 1.0), ("c", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    assert {r.g: r.q for r in ordered.exact_quantile(d, ["g"], "v", 0.3, "q", stable=True).collect()} == pytest.approx({"a": 11.7, "b": 11.7})
    seen = ordered._beside(d, d.groupBy("g").agg({"v": "max"}), ["g"])
    assert "BroadcastHashJoin" in plan(seen) and "SortMergeJoin" not in plan(seen)


def test_ortholog_pairs_are_not_gathered(spark):
    h = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 2)], "left_gene int, right_gene int")
    l = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (9, "c"), (None, "n")], "id int, uniprot string")
    r = spark.createDataFrame([(2, "x"), (2, "x"), (3, "y"), (3, None)], "id int, uniprot string")
    got = ids.ortholog_protein_pairs(h, l, r)
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == 6 and set(rows) == {(p, q, 1, g) for p in "ab" for q, g in (("x", 2), ("y", 3), (None, 3))}
    assert not any("Exchange" in x and "left_uniprot" in x for x in plan(got).splitlines())


def test_results_are_translated_with_names_packed_once(spark):
    results = spark.createDataFrame([("P_S1;P_T2", "u"), ("P_S1;P_T2", "v"), ("P_S1", "u"), ("Q_S5", "u"), (None, "u"), ("R_S7", "u")], "Protein string, Label string")
    rows = [("P", 1, "S", "H1", "T", 2), ("P", 1, "S", "H1", "T", 2), ("P", 2, "S", "H1", "T", 3), ("Q", 5, "-", "H2", "T", 9), ("P", 2, "S", "H2", "T", 1)]
    m = spark.createDataFrame(rows, "other_uniprot string, other_pos int, other_aa string, human_uniprot string, human_aa string, human_pos int")
    names = spark.createDataFrame([("H1", "g1")], "human_uniprot string, Gene_Name string")
    d = sites.translate_results_species(results, m, names)
    got = sorted(map(str, ((r.Protein, r.Label, r.singleSite, r.human_uniprot, r.human, r.Gene_Name) for r in d.collect())))
    both = [("P_S1;P_T2", x, s, h, t, g) for x in "uv" for s, h, t, g in (("P_S1", "H1", "H1_T2;H1_T3", "g1"), ("P_S1", "H1", "H1_T2;H1_T3", "g1"), ("P_T2", "H1", "H1_T2;H1_T3", "g1"), ("P_T2", "H2", "H2_T1", None))]
    want = [*both, *[("P_S1", "u", "P_S1", "H1", "H1_T2", "g1")] * 2, ("Q_S5", "u", None, None, None, None), ("R_S7", "u", "R_S7", None, None, None)]
    assert got == sorted(map(str, want))


def test_cells_of_few_columns_stay_with_their_rows(spark):
    rng = np.random.default_rng(3)
    cells = [(f"p{p}", f, s, float(rng.random())) for p in range(30) for f in range(1, 13) for s in ("A", "B", "C") if rng.random() < 0.6]
    d = spark.createDataFrame(cells, "protein string, fraction int, sample string, intensity_totalScaled double")
    grid = np.zeros((3, 30, 12))
    for p, f, s, x in cells:
        grid["ABC".index(s), int(p[1:]), f - 1] = x
    held = grid[:, (grid > 0).any(axis=0)]
    for r in elution.sample_correlation(d).collect():
        assert r.r == pytest.approx(np.corrcoef(held["ABC".index(r.a)], held["ABC".index(r.b)])[0, 1], abs=1e-9)
    wide = np.pad(grid[:, :, 2:10], ((0, 0), (0, 0), (4, 4)))
    # moved by up to two, a window of the eight fractions and two on either side
    window = wide[:, :, 2:14]
    got = elution.shifted_sample_correlation(d, 3, 10, 2).collect()
    assert len(got) == 3 * 14
    for r in got:
        moved = np.roll(wide["ABC".index(r.otherSample)], -r.offset, axis=1)[:, 2:14]
        assert r.r == pytest.approx(np.corrcoef(window["ABC".index(r.refSample)].ravel(), moved.ravel())[0, 1], abs=1e-9)
    gram = relational.column_gram(d, ["protein", "fraction"], "sample", "intensity_totalScaled")
    assert "SortMergeJoin" not in plan(gram)
