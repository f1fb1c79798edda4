"""Findings of round 4."""

import random

import numpy as np
from pyspark.sql import functions as F

from spectraloom.functions import distributions as dist
from spectraloom.operators import apms, graph, relational, sites


def _two_sides(spark, n=5):
    """Genes of two sides: one hop apart on a side, four hops across."""
    genes = [f"{side}{i}" for side in "ab" for i in range(n)]
    pairs = [(x, y, 1 if x[0] == y[0] else 4) for i, x in enumerate(genes) for y in genes[i + 1 :]]
    return spark.createDataFrame(pairs, "gene1 string, gene2 string, hops int")


def test_known_near_genes_are_drawn_again(spark):
    complexes = spark.createDataFrame([(c, f"{c}{g}") for c in range(30) for g in range(2)], "complex_id int, gene string")
    drawn = graph.decoy_complexes(complexes, _two_sides(spark), retries=12).collect()
    sides = {}
    for r in drawn:
        sides.setdefault(r.complex_id, []).append(r.gene[0])
    assert len(sides) == 30 and all(sorted(x) == ["a", "b"] for x in sides.values())


def test_a_complex_without_a_far_draw_keeps_its_farthest_try(spark):
    # any three genes hold a near pair; at the median two of three distances are far unless all are of one side
    complexes = spark.createDataFrame([(c, f"{c}{g}") for c in range(20) for g in range(3)], "complex_id int, gene string")
    drawn = graph.decoy_complexes(complexes, _two_sides(spark), retries=4, unfit="error")
    per = drawn.groupBy("complex_id").agg(F.countDistinct("gene").alias("genes"), F.countDistinct(F.substring("gene", 1, 1)).alias("sides"))
    assert {tuple(r)[1:] for r in per.collect()} == {(3, 2)} and per.count() == 20


def test_short_pairs_are_aligned_together(monkeypatch):
    rng = random.Random(3)
    word = lambda letters, sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
    a, b = [word("ACGTé", [0, 1, 2, 5, 22, 30]) for _ in range(200)], [word("ACGT", [0, 1, 3, 8, 22, 50]) for _ in range(200)]
    for scores in ((sites.MATCH, sites.MISMATCH, 10.0, 4.0), (1.0, -1.0, 0.0, 0.5)):
        want = [sites._Aligner(x, y, *scores).align() for x, y in zip(a, b)]
        assert sites._align_many([*a, "AC\0G", "A" * 600], [*b, "ACG", "AC"], *scores)[:200] == want
        with monkeypatch.context() as m:
            m.setattr(sites, "_Aligner", None)
            for cells in (2_000_000, 3000, 1):
                m.setattr(sites, "TOGETHER_CELLS", cells)
                assert sites._align_many(a, b, *scores) == want
    assert sites._align_many([], [], *scores) == []


def test_permutations_by_tables_are_the_same():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 16, 17, 75, 257, 1000):
        for k in {1, min(3, size), min(25, size), size}:
            own, seeds = rng.choice(size, k, replace=False).astype(np.uint64), rng.integers(-(2**62), 2**62, 20)
            want = relational.permuted_places(np.tile(own, 20), np.repeat(seeds, k), np.uint64(size)).reshape(20, k)
            assert np.array_equal(relational.permuted_sets(own, seeds, size), want)


def test_scored_preys_stay_where_they_are(spark):
    rows = [(f"p{p}" if p else None, f"b{b}_{r}", f"b{b}" if b else None, "control" if b == 1 else f"b{b}" if b < 5 else None, float((p * 7 + b * 3 + r * r) % 11) if (p + b + r) % 4 else None) for p in range(6) for b in range(6) for r in range(3)]
    d = spark.createDataFrame(rows, "preyProtein string, run string, bait string, excludeGroup string, log2Intensity double")
    d = apms.exclude_bait_as_prey(d)
    got = apms.zmadex(d.withColumn("replaceNA", F.coalesce("log2Intensity", F.lit(5.0))))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    found = {(r.preyProtein, r.run): r for r in got.collect()}
    assert len(found) == len(rows)
    for prey, run, bait, group, x in rows:
        r = found[prey, run]
        if None in (prey, bait, group):
            assert r.median_exc is None and r.t_test_p is None and r.Zmadex is None
            continue
        others = np.array([5.0 if y is None else y for p, _, _, g, y in rows if p == prey and g not in (group, None)])
        own = np.array([y for p, _, b, g, y in rows if (p, b, g) == (prey, bait, group) and y is not None])
        middle = np.median(others)
        assert abs(r.median_exc - middle) < 1e-12 and abs(r.mad_exc - 1.4826 * np.median(np.abs(others - middle))) < 1e-12
        if len(own):
            assert abs(r.t_log2FC - (own.mean() - others.mean())) < 1e-12
        if len(own) > 1:
            a, b = own.var(ddof=1) / len(own), others.var(ddof=1) / len(others)
            df = (a + b) ** 2 / (a * a / (len(own) - 1) + b * b / (len(others) - 1))
            assert abs(r.t_test_p - 2 * dist.t_upper(np.array([abs(own.mean() - others.mean()) / np.sqrt(a + b)]), np.array([df]))[0]) < 1e-12
    # imputed and scored in the same records
    both = apms.compute_zmadex(d)
    assert both.columns == ["preyProtein", "bait", "excludeGroup", "run", "log2Intensity", "excludeGlobally", "predicted", "SD", "replaceNA", "median_exc", "mad_exc", "t_test_p", "t_log2FC", "t_lowerCI", "Zmadex", "p_Z"]
    apart = apms.empirical_p(apms.zmadex(apms.impute_missing_by_prey(d)))
    order = lambda x: sorted((tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in x.select(both.columns).collect()))
    assert order(both) == order(apart) and both.count() == len(rows)


def test_pairs_carry_columns_of_both_sides(spark):
    rows = [(g, f"n{i}", [1.0, float(i)], i * 10, f"x{i}" if i % 3 else None) for g in "ab" for i in range(40)]
    d = spark.createDataFrame(rows, "g string, name string, v array<double>, ten int, word string")
    got = relational.blocked_pairs(d, ["g"], "name", "v", relational.vector_dot, None, block_rows=16, carry=("ten", "word")).collect()
    assert len(got) == 2 * 40 * 39 // 2
    for r in got:
        i, j = int(r.a[1:]), int(r.b[1:])
        assert r.a < r.b and (r.a_ten, r.b_ten) == (i * 10, j * 10) and (r.a_word, r.b_word) == (f"x{i}" if i % 3 else None, f"x{j}" if j % 3 else None)


def test_replicates_of_a_bait_and_prey_are_one_record(spark):
    counts = [(f"{b}_{r}", p, (i * 5 + r * 3 + len(p)) % 9 + (20 if b == "t1" and p == "p1" else 0)) for i, b in enumerate(("c", "t1", "t2")) for r in range(3) for p in ("p1", "p2", "pp3")]
    interactions = spark.createDataFrame(counts, "run string, prey string, spc int")
    baits = spark.createDataFrame([(f"{b}_{r}", b, b[0].upper()) for b in ("c", "t1", "t2") for r in range(3)], "run string, bait string, treatment string")
    # a prey of two names and one without
    preys = spark.createDataFrame([("p1", "one"), ("p1", "uno"), ("p2", "two")], "prey string, preyGene string")
    got, _ = apms.saint_spc(interactions, baits, preys)
    rows = {(r.bait, r.prey, r.preyGene): r for r in got.collect()}
    assert set(rows) == {(b, p, g) for b in ("t1", "t2") for p, g in (("p1", "one"), ("p1", "uno"), ("p2", "two"), ("pp3", None))}
    for (bait, prey, _), r in rows.items():
        own = [n for run, p, n in counts if p == prey and run.startswith(bait)]
        control = [n for run, p, n in counts if p == prey and run.startswith("c_")]
        assert r.treatCounts == "|".join(map(str, own)) and abs(r.avgSpec - sum(own) / 3) < 1e-12
        assert abs(r.foldChange - np.mean(own) / max(0.1, np.mean(control))) < 1e-9 and r.controlSource == "experimentalControls"
    assert rows["t1", "p1", "one"].avgScore == max(r.avgScore for r in rows.values()) > 0.9
