"""Steps over many groups at once against plain versions of one group; whole work at size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import pii
from spectraloom.operators import apms, elution, relational
from spectraloom.operators.models import CellFit

# --- bait-prey ------------------------------------------------------------------


def plain_imputation(values, baits, low, offset=2.0, min_sd=0.33):
    gone = np.isnan(values)
    m = np.array([sum(g for g, o in zip(gone, baits, strict=True) if o == b) for b in baits], float)
    part = ~gone & (m > 0)
    y, x, fit = values[part], m[part], None
    if len(np.unique(x)) > 1:
        b, r = apms._huber(np.column_stack([np.ones_like(x), x]), y)
        fit = (b, r) if b[1] < 0 else None
    if fit is None and len(y) > 1:
        b, r = apms._huber(np.ones((len(y), 1)), y)
        fit = (np.array([b[0], 0.0]), r)
    if fit is not None:
        around = np.median(np.abs(fit[1] - np.median(fit[1]))) * 1.4826
        return fit[0][0] + fit[0][1] * m, max(min_sd, min(fit[1].std(ddof=1), around))
    if len(y) == 1:
        return np.full(len(values), y[0]), min_sd
    seen = np.nanmin(values) if (~gone).any() else np.nan
    return np.full(len(values), low if np.isnan(seen) else min(seen - offset, low)), min_sd


def test_imputation_of_many_preys_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(apms, "CELLS", 60)
    rng = np.random.default_rng(5)
    data, want = [], {}
    for p in range(60):
        baits = [f"b{i}" for i in range(int(rng.integers(1, 6))) for _ in range(3)]
        v = np.where(rng.random(len(baits)) < rng.choice([0.0, 0.3, 0.6, 0.95, 1.0]), np.nan, 20 - 0.7 * rng.integers(0, 4, len(baits)) + rng.normal(0, 0.5, len(baits)))
        pred, sd = plain_imputation(v, baits, 15.0)
        for i, b in enumerate(baits):
            data.append((f"p{p}", f"r{i}", b, None if np.isnan(v[i]) else float(v[i])))
            want[f"p{p}", f"r{i}"] = (pred[i], sd) if np.isnan(v[i]) else (None, None)
    data += [(None, "r0", "b0", None), ("p0", "odd", None, None)]
    got = apms.impute_missing_by_prey(spark.createDataFrame(data, "preyProtein string, run string, bait string, log2Intensity double"), floor=15.0).collect()
    assert len(got) == len(data)
    for r in got:
        w = want.get((r["preyProtein"], r["run"]), (None, None))
        assert (r["predicted"], r["SD"]) == (w if w[0] is None else pytest.approx(w, rel=1e-9))


def test_background_of_many_preys_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(apms, "CELLS", 200)
    rng = np.random.default_rng(6)
    data = [(f"p{p}", f"r{i}", f"b{i // 3}", "control" if i < 6 else f"b{i // 3}", None if rng.random() < 0.2 else float(rng.integers(0, 30)) / 7, p == i // 3) for p in range(40) for i in range(int(rng.integers(1, 20)))]
    data += [(None, "r0", "b0", "control", 1.0, False), ("p0", "odd", "b9", None, 2.0, False)]
    d = spark.createDataFrame(data, "preyProtein string, run string, bait string, excludeGroup string, log2Intensity double, excludeGlobally boolean")
    got = apms.zmadex(d.withColumn("replaceNA", F.col("log2Intensity"))).collect()
    assert len(got) == len(data)
    for r in got:
        if r["preyProtein"] is None or r["excludeGroup"] is None:
            assert r["median_exc"] is None
            continue
        others = np.array([v for p, _, _, g, v, out in data if p == r["preyProtein"] and g not in (None, r["excludeGroup"]) and v is not None and not out])
        if not len(others):
            assert r["median_exc"] is None and r["mad_exc"] is None
            continue
        assert r["median_exc"] == np.median(others) and r["mad_exc"] == 1.4826 * np.median(np.abs(others - np.median(others)))


@pytest.mark.parametrize("few", [0, 2_000])
def test_grid_by_records_equals_grid_by_salt(spark, monkeypatch, few):
    monkeypatch.setattr(relational, "FEW_LEVELS", few)
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), (None, "z", 3.0), ("b", None, 4.0)], "k string, c string, v double")
    got = {tuple(r) for r in relational.complete_grid(d, ["k"], "c", "v", 0.0).collect()}
    assert got == {("a", "x", 1.0), ("a", "y", 0.0), ("a", "z", 0.0), (None, "x", 0.0), (None, "y", 0.0), (None, "z", 3.0)}


# --- elution --------------------------------------------------------------------


def peak_tables(spark):
    rng = np.random.default_rng(9)
    data = []
    for p in range(25):
        treatments = ["A", "N", "R"][: int(rng.integers(1, 4))]
        for i, t in enumerate(treatments):
            for sample in range(int(rng.integers(1, 3))):
                for f in range(1, 14):
                    if rng.random() < (0.9 if p % 3 else 0.25):
                        data.append((f"p{p}", f"{t}{sample}", t, float(f), float(rng.lognormal(i * 0.3, 0.4))))
    d = spark.createDataFrame(data, "protein string, sample string, treatment string, standardFraction double, intensity_totalScaled double")
    c = spark.createDataFrame([(f"p{p}", k, c) for p in range(25) for k, c in ((1, 5.25), (2, 10.0))], "protein string, peakCluster int, center double")
    return d, c


def near_cells(d, c, radius, log, at):
    peaks = c.collect()
    rows = [(p, k, x - m if log else str(x), t, np.log2(y) if log else y) for p, _, t, x, y in d.collect() for q, k, m in peaks if p == q and abs(x - m) <= radius]
    f = pd.DataFrame(rows, columns=["protein", "peakCluster", at, "treatment", "y"])
    return f.assign(q=f["y"] ** 2).groupby(["protein", "peakCluster", at, "treatment"], as_index=False).agg(_n=("y", "size"), _s=("y", "sum"), _q=("q", "sum"))


def test_anova_of_many_peaks_equals_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(elution, "DESIGN_CELLS", 1_000)
    d, c = peak_tables(spark)
    got = {(r["protein"], r["peakCluster"], r["term"]): r for r in elution.peak_anova(d, c).collect()}
    for (p, k), cells in near_cells(d, c, 5.0, True, "x").groupby(["protein", "peakCluster"]):
        if cells["treatment"].nunique() < 2:
            assert got[p, k, None]["error"] == elution.ONE_TREATMENT
            continue
        cells = cells.reset_index(drop=True)
        for i in range(1, 5):
            cells[f"x{i}"] = cells["x"] ** i / 5.0 ** (i - 1)
        base = ["x1", "x2", "x3", "x4"]
        fits = [CellFit(cells, t) for t in (base, [*base, "treatment"], [*base, "treatment", *[f"{b}:treatment" for b in base]])]
        if fits[2].df <= 0:
            assert got[p, k, None]["error"] == "too few values"
            continue
        for term, a, b in (("treatment", *fits[:2]), ("interaction", *fits[1:])):
            f = (a.rss - b.rss) / (a.df - b.df) / fits[2].sigma2 if a.df > b.df and fits[2].sigma2 > 0 else None
            assert got[p, k, term]["t"] == (f if f is None else pytest.approx(f, rel=1e-6, abs=1e-8))
            assert f is None or 0 <= got[p, k, term]["p"] <= 1


def test_matched_fractions_of_many_peaks_equal_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(elution, "DESIGN_CELLS", 1_000)
    d, c = peak_tables(spark)
    got = {(r["protein"], r["peakCluster"], r["term"]): r for r in elution.peak_t_fraction_matched(d, c).collect()}
    seen = 0
    for (p, k), cells in near_cells(d, c, 3.5, False, "frac").groupby(["protein", "peakCluster"]):
        if cells["treatment"].nunique() < 2:
            assert got[p, k, None]["error"] == elution.ONE_TREATMENT
            seen += 1
            continue
        want = CellFit(cells.reset_index(drop=True), ["frac", "treatment"]).coefficients()
        for w in want[want["term"].str.startswith("treatment")].itertuples():
            r = got[p, k, w.term[len("treatment") :]]
            seen += 1
            assert r["deltaInt"] == pytest.approx(w.estimate, rel=1e-7, abs=1e-10)
            for a, b in ((r["SE"], w.SE), (r["t"], w.stat), (r["p"], w.p)):
                assert np.isnan(b) if a is None else a == pytest.approx(b, rel=1e-5, abs=1e-9)
    assert seen == len(got)


def test_specificity_permutations_equal_drawn_rows(spark):
    data = [(p, f"r{i}", f"b{i // 2}", v) for p, spc in (("p", [5, 1, 0, 2, 0, 0, 3, 1]), ("q", [0, 0, 0, 0, 0, 7, 0, 0]), ("zero", [0] * 8)) for i, v in enumerate(spc)]
    d = spark.createDataFrame(data, "prey string, run string, bait string, spc long")
    got = {(r["prey"], r["bait"]): r for r in apms.specificity_permutation(d, n_perm=50).collect()}
    place = {r["run"]: r["idx"] for r in relational.dense_index(d.select("run", "bait").distinct(), "run", "idx").collect()}
    bait = {place[f"r{i}"]: f"b{i // 2}" for i in range(8)}
    assert len(got) == 8
    for prey in "pq":
        rows = spark.range(1, 51).select(F.col("id").cast("int").alias("perm"), F.lit(prey).alias("prey"), F.explode(F.array(*[F.lit(place[r]) for p, r, _, v in data if p == prey and v]).cast("array<bigint>")).alias("idx"))
        rows = rows.select("perm", "idx", relational.permuted_index(F.col("idx"), F.xxhash64("prey", "perm", F.lit(1)), F.lit(8).cast("long")).alias("to")).collect()
        spc = {place[r]: v for p, r, _, v in data if p == prey}
        drawn = {}
        for r in rows:
            drawn[r["perm"], bait[r["to"]]] = drawn.get((r["perm"], bait[r["to"]]), 0) + spc[r["idx"]]
        for b in ("b0", "b1", "b2", "b3"):
            own = sum(v for p, _, x, v in data if p == prey and x == b)
            want = 1.0 if own == 0 else sum(v >= own for v in drawn.values()) / 200
            assert got[prey, b]["pvalue"] == pytest.approx(want)


def test_near_pairs_are_not_broadcast(spark):
    d = spark.range(50).select(F.col("id").alias("a"), (F.col("id") % 7).cast("double").alias("x"))
    e = d.withColumnRenamed("a", "b")
    near = relational.distance_join(d, e, ["x"], 2.0)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() == sum(abs(i % 7 - j % 7) <= 2 for i in range(50) for j in range(50))


# --- training data --------------------------------------------------------------


def test_personal_data_learns_from_every_labelled_candidate(spark, monkeypatch):
    class Called(Exception):
        pass

    def staged(df, name):
        raise Called(name, df.count())

    monkeypatch.setattr(pii, "staged", staged)
    c = spark.range(20_500).select(F.col("id").alias("row"), F.lit("email").alias("kind"), F.lit(0).alias("start"), (F.col("id") % 500 > 0).alias("base"), (F.col("id") % 2 == 0).alias("passed"))
    with pytest.raises(Called) as call:
        pii.added_spans(c)
    assert call.value.args == ("fit", 20_459)
