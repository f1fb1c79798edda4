"""Fractionation (elution) profiles: scaling, smoothing, peaks, alignment, tests, co-elution.

Long tables have ``sample, treatment, replicate, protein, fraction, intensity``.
A profile (one sample and protein) holds at most one value per fraction, so it
is carried as one array record; work on profiles is vectorised over batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from spectraloom.functions import distributions as dist
from spectraloom.functions.columns import first_row, ratio
from spectraloom.functions.local import local_values, robust_trend
from spectraloom.functions.ordered import exact_median, exact_quantile, rank_table
from spectraloom.functions.session import attach, cut, shuffle_width, spread
from spectraloom.operators.apms import _huber
from spectraloom.operators.cluster import complete_linkage, linkage_on_line
from spectraloom.operators.models import unit_vectors
from spectraloom.operators.normalize import median_polish
from spectraloom.operators.relational import blocked_pairs, column_gram, complete_grid, correlation_from_sums, level_pairs, nearest_join, range_join, vector_dot
from spectraloom.operators.significance import density_at, kernel_density

CELL = "\u0001"


# --- summaries and quality ------------------------------------------------------

def summarize_runs(df: DataFrame) -> DataFrame:
    seen = F.collect_set("fraction")
    d = df.groupBy("treatment", "replicate").agg(F.min("fraction").alias("minFraction"), F.max("fraction").alias("maxFraction"), F.count(F.lit(1)).alias("nrow"), seen.alias("_s"))
    gone = F.array_sort(F.array_except(F.sequence("minFraction", "maxFraction"), "_s"))
    return d.select("treatment", "replicate", F.size("_s").alias("numFractions"), "minFraction", "maxFraction", "nrow", F.array_join(F.transform(gone, lambda x: x.cast("string")), ";").alias("missingFractions"))


def fraction_polish(df: DataFrame) -> DataFrame:
    """Median-polish level (overall plus column effect) per sample and fraction."""
    d = df.where(F.col("intensity") > 0).select("protein", F.concat_ws(CELL, "sample", F.col("fraction").cast("string")).alias("_c"), F.log2("intensity").alias("v"))
    overall, effect, _ = median_polish(d, "protein", "_c", "v")
    rows = [(*k.split(CELL), overall + e) for k, e in effect.items()]
    t = df.sparkSession.createDataFrame([(a, int(b), float(c)) for a, b, c in rows], "sample string, fraction int, medPolishIntensity double")
    return t


def fraction_qc(df: DataFrame) -> DataFrame:
    pos = df.where(F.col("intensity") > 0)
    n = df.groupBy("sample", "fraction").agg(F.countDistinct(F.when(F.col("intensity") > 0, F.col("protein"))).alias("numProteins"))
    med = exact_median(pos, ["sample", "fraction"], "intensity", "medIntensity")
    info = df.groupBy("sample").agg(F.first("treatment").alias("treatment"), F.first("replicate").alias("replicate"))
    return n.join(med, ["sample", "fraction"], "left").join(fraction_polish(df), ["sample", "fraction"], "left").join(info, "sample")


def longest_runs(df: DataFrame, feature: str = "protein", value: str = "intensity", cutoff: float = 0.0) -> DataFrame:
    """Longest run of consecutive fractions over the cutoff, and their number, per sample and feature."""
    d = df.select("sample", feature).distinct()
    hit = df.where(F.col(value) > cutoff).select("sample", feature, "fraction").distinct()
    w = Window.partitionBy("sample", feature).orderBy("fraction")
    island = hit.withColumn("_g", F.col("fraction") - F.row_number().over(w)).groupBy("sample", feature, "_g").agg(F.count(F.lit(1)).alias("n"))
    runs = island.groupBy("sample", feature).agg(F.max("n").alias("longestRun"), F.sum("n").alias("countFractions"))
    return d.join(runs, ["sample", feature], "left").na.fill(0, ["longestRun", "countFractions"])


# --- scaling and grids ----------------------------------------------------------

def scale_total(df: DataFrame, keep_sample_relative: bool = False) -> DataFrame:
    s = df.groupBy("sample", "protein").agg(F.sum("intensity").alias("_sum"))
    d = df.join(s, ["sample", "protein"]).withColumn("intensity_totalScaled", ratio(F.col("intensity"), F.col("_sum")))
    if keep_sample_relative:
        top = s.groupBy("protein").agg(F.max("_sum").alias("_top"))
        d = d.join(top, "protein").withColumn("intensity_totalScaled", F.col("intensity_totalScaled") * ratio(F.col("_sum"), F.col("_top"))).drop("_top")
    return d.drop("_sum")


def scale_max(df: DataFrame, over_samples: bool = False) -> DataFrame:
    keys = ["protein"] if over_samples else ["sample", "protein"]
    m = df.groupBy(*keys).agg(F.max("intensity").alias("_m"))
    return df.join(m, keys).withColumn("intensity_maxScaled", ratio(F.col("intensity"), F.col("_m"))).drop("_m")


def profile_grid(df: DataFrame, value: str = "intensity_totalScaled") -> DataFrame:
    """Every protein at every (sample, fraction), zero where absent, plus its mean top fraction."""
    cells = df.select("protein", F.concat_ws(CELL, "sample", F.col("fraction").cast("string")).alias("_c"), F.coalesce(value, F.lit(0.0)).alias("value"))
    g = complete_grid(cells, ["protein"], "_c", "value", 0.0)
    part = F.split("_c", CELL)
    return g.select("protein", part[0].alias("sample"), part[1].cast("int").alias("fraction"), "value")


def top_fraction(df: DataFrame, value: str = "intensity") -> DataFrame:
    """Mean over samples of the fraction with most signal."""
    t = df.where(F.col(value).isNotNull()).groupBy("sample", "protein").agg(F.min_by("fraction", F.struct(-F.col(value), F.col("fraction"))).alias("f"))
    return t.groupBy("protein").agg(F.avg("f").alias("meanMaxFraction"))


def profile_order(df: DataFrame, value: str = "value") -> DataFrame:
    """Proteins ordered by mean centre of mass, then mean top fraction."""
    c = df.groupBy("sample", "protein").agg(ratio(F.sum(F.col(value) * F.col("fraction")), F.sum(value)).alias("c"), F.min_by("fraction", F.struct(-F.col(value), F.col("fraction"))).alias("t"))
    return c.groupBy("protein").agg(F.avg("c").alias("center"), F.avg("t").alias("top"))


# --- sample and fraction comparisons --------------------------------------------

def _zero_filled(gram: DataFrame, total: float) -> DataFrame:
    """Correlations of columns whose absent cells count as zero."""
    own = gram.where(F.col("a") == F.col("b"))
    a, b = own.select("a", F.col("sa").alias("_sa"), F.col("saa").alias("_qa"), F.col("n").alias("_na")), own.select(F.col("a").alias("b"), F.col("sa").alias("_sb"), F.col("saa").alias("_qb"), F.col("n").alias("_nb"))
    every = level_pairs(own, "a").join(a, "a").join(b, "b")
    d = every.join(gram.select("a", "b", "n", "sab"), ["a", "b"], "left").na.fill(0.0, ["n", "sab"])
    r = correlation_from_sums(F.lit(float(total)), F.col("_sa"), F.col("_sb"), F.col("_qa"), F.col("_qb"), F.col("sab"))
    return d.select("a", "b", r.alias("pearson"), ratio(F.col("n"), F.col("_na") + F.col("_nb") - F.col("n")).alias("jaccard"))


def sample_correlation(df: DataFrame, value: str = "intensity_totalScaled") -> DataFrame:
    """Whole-profile Pearson r between samples, absent cells zero."""
    df = cut(df.select("protein", "fraction", "sample", F.coalesce(value, F.lit(0.0)).alias("_x")))
    g = column_gram(df, ["protein", "fraction"], "sample", "_x")
    n = df.select("protein", "fraction").distinct().count()
    return _zero_filled(g, n).select("a", "b", F.col("pearson").alias("r"))


def shifted_sample_correlation(df: DataFrame, start: int = 15, end: int = 60, radius: int = 5, value: str = "intensity_totalScaled") -> DataFrame:
    """Correlation of each reference sample with every sample moved by -radius..radius, zero padded."""
    d = df.where(F.col("fraction").between(start, end)).select("protein", "fraction", "sample", F.col(value).alias("x"))
    # by protein, so that the moved cells of a protein meet where they are made
    d = cut(d.repartition(shuffle_width(df.sparkSession), "protein"))
    n = d.select("protein").distinct().count() * (d.select("fraction").distinct().count() + 2 * radius)
    d = d.withColumn("o", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).select(
        "protein", (F.col("fraction") - F.col("o")).alias("at"), F.concat_ws(CELL, "sample", F.col("o").cast("string")).alias("col"), "x"
    )
    c = _zero_filled(column_gram(d, ["protein", "at"], "col", "x"), n).select("a", "b", F.col("pearson").alias("r"))
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    ref, other = F.split("a", CELL), F.split("b", CELL)
    return both.where(ref[1] == "0").select(ref[0].alias("refSample"), other[0].alias("otherSample"), other[1].cast("int").alias("offset"), "r")


def best_offset(shifted: DataFrame) -> DataFrame:
    return shifted.where(F.col("refSample") != F.col("otherSample")).groupBy("refSample", "otherSample").agg(F.min_by("offset", F.struct(-F.col("r"), F.abs("offset"), F.col("offset"))).alias("offset"))


def fraction_comparison(df: DataFrame, value: str = "intensity_totalScaled") -> DataFrame:
    """Pearson r and Jaccard overlap of every two (sample, fraction) columns."""
    d = df.where(F.col(value) > 0).withColumn("_c", F.concat_ws(CELL, "sample", F.lpad(F.col("fraction").cast("string"), 4, "0")))
    n = df.select("protein").distinct().count()
    c = _zero_filled(column_gram(d, ["protein"], "_c", value), n)
    a, b = F.split("a", CELL), F.split("b", CELL)
    return c.select(a[0].alias("ref_sample"), a[1].cast("int").alias("ref_fraction"), b[0].alias("other_sample"), b[1].cast("int").alias("other_fraction"), "pearson", "jaccard")


def best_matching_fraction(pairs: DataFrame) -> DataFrame:
    flipped = pairs.select(F.col("other_sample").alias("ref_sample"), F.col("other_fraction").alias("ref_fraction"), F.col("ref_sample").alias("other_sample"), F.col("ref_fraction").alias("other_fraction"), "pearson", "jaccard")
    d = pairs.unionByName(flipped).where((F.col("ref_sample") != F.col("other_sample")) & F.col("pearson").isNotNull())
    return first_row(d, ["ref_sample", "ref_fraction", "other_sample"], [-F.col("pearson"), F.col("other_fraction")])


def correlation_by_offset(pairs: DataFrame, fraction_range: int = 5) -> DataFrame:
    off = F.col("other_fraction") - F.col("ref_fraction")
    return pairs.where(F.abs(off) <= fraction_range).withColumn("offset", off).withColumn("within", F.col("ref_sample") == F.col("other_sample"))


def protein_correlation_between_samples(df: DataFrame, value: str = "intensity_totalScaled") -> DataFrame:
    """Same protein, every ordered pair of samples, over all fractions with absent cells zero."""
    n = df.select("fraction").distinct().count()
    d = df.where(F.col(value).isNotNull()).groupBy("protein", "sample", "fraction").agg(F.sum(value).alias("x"))
    own = d.groupBy("protein", "sample").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    b = d.select("protein", "fraction", F.col("sample").alias("other_sample"), F.col("x").alias("y"))
    xy = d.join(b, ["protein", "fraction"]).where(F.col("sample") != F.col("other_sample")).groupBy("protein", "sample", "other_sample").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    o = own.select("protein", F.col("sample").alias("other_sample"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    pairs = own.join(o, "protein").where(F.col("sample") != F.col("other_sample")).join(xy, ["protein", "sample", "other_sample"], "left").na.fill(0.0, ["xy"])
    r = correlation_from_sums(F.lit(float(n)), F.col("s"), F.col("s2"), F.col("q"), F.col("q2"), F.col("xy"))
    return pairs.select("protein", F.col("sample").alias("ref_sample"), "other_sample", r.alias("r"))


def profile_arrays(df: DataFrame, value: str, keys: tuple[str, ...] = ("sample", "protein")) -> tuple[DataFrame, int]:
    """One record per profile: values from the lowest to the highest fraction of the table, zero where absent."""
    lo, hi = df.agg(F.min("fraction"), F.max("fraction")).first()
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, "fraction").agg(F.sum(value).alias("x"))
    m = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("fraction", "x"))).alias("_m"))
    v = F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda f: F.coalesce(F.try_element_at("_m", f), F.lit(0.0)))
    return m.select(*keys, v.alias("x")), lo


def shift_ratio(df: DataFrame, value: str, max_shift: int = 5, near: tuple[int, ...] = (1,), far: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Correlation of each profile with itself shifted: near over far shifts."""
    arrays, _ = profile_arrays(df, value)

    @F.pandas_udf(DoubleType())
    def one(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy())
        size = m.shape[1] - max_shift
        base = m[:, :size] - m[:, :size].mean(axis=1, keepdims=True)
        cors = {}
        with np.errstate(all="ignore"):
            for s in {*near, *far}:
                o = m[:, s : s + size]
                o = o - o.mean(axis=1, keepdims=True)
                cors[s] = (base * o).sum(axis=1) / np.sqrt((base**2).sum(axis=1) * (o**2).sum(axis=1))
            out = np.mean([cors[s] for s in near], axis=0) / np.mean([cors[s] for s in far], axis=0)
        return pd.Series(out).where(np.isfinite(out))

    return arrays.select("sample", "protein", one("x").alias("shiftRatio"))


def cluster_profiles(df: DataFrame, value: str, threshold: float = 0.9, min_size: int = 5) -> DataFrame:
    """Complete-linkage clusters of profiles with r >= threshold, in every sample; small ones pooled, empty ones marked.

    Adds the cluster's size, median centre and median top fraction.
    """
    arrays, lo = profile_arrays(df, value)
    node = F.concat_ws(CELL, "sample", "protein").alias("_node")
    arrays = cut(arrays.select("*", node))
    live = cut(unit_vectors(arrays, "_node", "x", center=True).withColumn("sample", F.split("_node", CELL)[0]))
    near = blocked_pairs(live, ["sample"], "_node", "vector", vector_dot, threshold)
    c = complete_linkage(near.select("a", "b", (1 - F.col("score")).alias("dist")), live.select(F.col("_node").alias("node")))
    size = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    name = F.concat(F.lit("cluster."), F.split("cluster", CELL)[1])
    c = c.join(size, "cluster").select(F.col("node").alias("_node"), F.when(F.col("_n") < min_size, "cluster.0000").otherwise(name).alias("cluster"))
    c = arrays.join(c, "_node", "left").withColumn("cluster", F.coalesce("cluster", F.lit("cluster.xxxx")))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    weighted = F.aggregate(F.transform("x", lambda v, i: v * (i + lo)), F.lit(0.0), lambda a, b: a + b)
    c = c.select("sample", "protein", "cluster", ratio(weighted, total).alias("_c"), (F.array_position("x", F.array_max("x")) + lo - 1).cast("double").alias("_t"))
    c = cut(c)
    by = ["sample", "cluster"]
    stat = c.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    mid = exact_median(c, by, "_c", "fractionCenter", stable=True)
    top = exact_median(c, by, "_t", "fractionMax", stable=True)
    return c.select("sample", "protein", "cluster").join(stat, by).join(mid, by, "left").join(top, by, "left")


# --- fraction normalization -----------------------------------------------------

def fit_local_cubics(qc: DataFrame, window: int = 15, extend: int = 3, model: str = "additive") -> DataFrame:
    """Robust cubic of the fraction level in every window, with a sample term.

    ``model`` is additive, interaction, interactionByTreatment or singleSample.
    A window holds at most samples x (window + 1) rows of the quality table.
    """
    lo, hi = qc.agg(F.min("fraction"), F.max("fraction")).first()
    starts = F.sequence(F.lit(lo - extend), F.lit(hi - (window - 1) + extend))
    d = qc.where(F.col("medPolishIntensity").isNotNull()).select("sample", "treatment", "fraction", "medPolishIntensity")
    d = d.withColumn("start", F.explode(F.filter(starts, lambda s: F.col("fraction").between(s, s + window))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["fraction"].to_numpy(float)
        z = (f - f.mean()) / max(f.std(), 1e-9)
        poly = np.column_stack([z, z**2, z**3])
        dummies = lambda c: np.column_stack([(pdf[c] == v).to_numpy(float) for v in sorted(pdf[c].unique())[1:]] or [np.zeros(len(pdf))])
        parts = [np.ones((len(pdf), 1)), poly]
        if model != "singleSample":
            parts.append(dummies("sample"))
        if model == "interaction":
            parts += [poly * s[:, None] for s in dummies("sample").T]
        if model == "interactionByTreatment":
            parts += [poly * s[:, None] for s in dummies("treatment").T]
        _, resid = _huber(np.hstack(parts), pdf["medPolishIntensity"].to_numpy(float))
        return pd.DataFrame({"start": pdf["start"], "sample": pdf["sample"], "fraction": pdf["fraction"], "fitted": pdf["medPolishIntensity"] - resid, "residual": resid})

    return spread(d, "start").groupBy("start").applyInPandas(fit, "start int, sample string, fraction int, fitted double, residual double")


def label_outliers(qc: DataFrame, fits: DataFrame, threshold: float = 1.5) -> DataFrame:
    m = fits.groupBy("sample", "fraction").agg(F.median("residual").alias("medianResidual"))
    return qc.join(m, ["sample", "fraction"], "left").withColumn("isOutlier", F.abs("medianResidual") > math.log2(threshold))


def normalize_by_residuals(df: DataFrame, qc: DataFrame) -> DataFrame:
    d = df.join(qc.select("sample", "fraction", "medianResidual"), ["sample", "fraction"], "left").withColumn("originalIntensity", F.col("intensity"))
    d = d.withColumn("intensity", F.col("intensity") / F.pow(F.lit(2.0), "medianResidual")).drop("medianResidual")
    if "intensity_totalScaled" in df.columns:
        d = scale_total(d.drop("intensity_totalScaled"))
    return scale_max(d.drop("intensity_maxScaled")) if "intensity_maxScaled" in df.columns else d


def undo_normalization(df: DataFrame) -> DataFrame:
    return df.withColumn("intensity", F.col("originalIntensity")).drop("originalIntensity", "intensity_totalScaled", "intensity_maxScaled")


def interpolate_fractions(df: DataFrame, qc: DataFrame, fractions: tuple[int, int], max_gap: int = 1) -> DataFrame:
    """Outlier and absent fractions of a sample re-filled on a line between neighbours, short gaps only, flagged."""
    bad = qc.where(F.col("isOutlier")).select("sample", "fraction").withColumn("_bad", F.lit(True))
    every = df.select("sample").distinct().withColumn("fraction", F.explode(F.sequence(F.lit(fractions[0]), F.lit(fractions[1]))))
    gone = every.join(df.select("sample", "fraction").distinct(), ["sample", "fraction"], "left_anti").withColumn("_bad", F.lit(True))
    fix = bad.unionByName(gone).distinct().groupBy("sample").agg(F.collect_set("fraction").alias("_fix"))
    m = df.where(F.col("intensity").isNotNull()).groupBy("sample", "protein").agg(F.map_from_entries(F.collect_list(F.struct("fraction", "intensity"))).alias("_m"))
    m = m.join(fix, "sample", "left").withColumn("_fix", F.coalesce("_fix", F.expr("cast(array() as array<int>)")))
    d = m.withColumn("fraction", F.explode(F.sequence(F.lit(fractions[0]), F.lit(fractions[1])))).withColumn("interpolated", F.array_contains("_fix", F.col("fraction")))
    d = d.select("sample", "protein", "fraction", "interpolated", F.when(~F.col("interpolated"), F.try_element_at("_m", F.col("fraction"))).alias("v"))
    w = Window.partitionBy("sample", "protein").orderBy("fraction")
    known = F.when(F.col("v").isNotNull(), F.struct("fraction", "v"))
    d = d.withColumn("_p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_n", F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    gap = F.col("_n")["fraction"] - F.col("_p")["fraction"] - 1
    line = F.col("_p")["v"] + (F.col("_n")["v"] - F.col("_p")["v"]) * (F.col("fraction") - F.col("_p")["fraction"]) / (gap + 1)
    return d.select("sample", "protein", "fraction", F.when(F.col("interpolated"), F.when(gap <= max_gap, line)).otherwise(F.col("v")).alias("intensity"), "interpolated")


def windowed_loess_normalize(df: DataFrame, samples: list[str] | None = None, window: int = 3, span: float | None = None, rounds: int = 3, robust: int = 3) -> DataFrame:
    """Cyclic local-regression normalization inside sliding fraction windows, of all samples at once.

    The columns of a window are its (sample, fraction) runs. In each round every
    column moves by the local regression of its distance from the mean of all
    columns on that mean, over its own points; all columns of all windows are
    fitted in one job. A protein's values over its windows are averaged.
    ``span`` follows the number of points of a column unless given.
    """
    d = df.where(F.col("intensity") > 0)
    d = d if samples is None else d.where(F.col("sample").isin(samples))
    d = d.select("protein", "fraction", "sample", F.log2("intensity").alias("v"))
    half = window // 2
    d = d.withColumn("w", F.explode(F.sequence(F.col("fraction") - half, F.col("fraction") + (window - 1 - half))))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        a, v = pdf["a"].to_numpy(float), pdf["v"].to_numpy(float)
        share = span if span is not None else min(1.0, 0.3 + 0.7 * (50 / max(1, len(a))) ** (1 / 3))
        return pdf[["protein", "fraction", "sample", "w"]].assign(v=v - robust_trend(a, v - a, share, robust=robust))

    for _ in range(rounds):
        d = cut(d)
        mean = d.groupBy("w", "protein").agg(F.avg("v").alias("a"))
        points = d.join(mean, ["w", "protein"])
        d = spread(points, "w", "sample", "fraction").groupBy("w", "sample", "fraction").applyInPandas(move, ", ".join(f"{c} {kinds[c]}" for c in ("protein", "fraction", "sample", "w", "v")))
    return d.groupBy("protein", "fraction", "sample").agg(F.pow(F.lit(2.0), F.avg("v")).alias("intensity"))


def match_fraction_medians(df: DataFrame, control: str, samples: list[str], fractions: tuple[int, int]) -> DataFrame:
    """Shift chosen samples' fractions so that their median log matches the control's."""
    pos = df.where((F.col("intensity") > 0) & F.col("sample").isin([control, *samples])).select("sample", "fraction", F.log2("intensity").alias("l"))
    med = cut(exact_median(pos, ["sample", "fraction"], "l", "m"))
    ref = med.where(F.col("sample") == control).select("fraction", F.col("m").alias("ref"))
    shift = med.where(F.col("sample").isin(samples)).join(ref, "fraction").select("sample", "fraction", (F.col("ref") - F.col("m")).alias("_s"))
    d = df.join(shift, ["sample", "fraction"], "left")
    inside = F.col("fraction").between(*fractions)
    return d.withColumn("intensity", F.when(inside & F.col("_s").isNotNull(), F.col("intensity") * F.pow(F.lit(2.0), "_s")).otherwise(F.col("intensity"))).drop("_s")


# --- smoothing and peaks --------------------------------------------------------

SD_PER_BANDWIDTH = 0.3706505  # fixed value: quartiles of the normal kernel at a quarter of the bandwidth


def _kernel(size: int, bandwidth: float) -> np.ndarray:
    sd = bandwidth * SD_PER_BANDWIDTH
    d = np.abs(np.arange(size)[:, None] - np.arange(size)[None, :])
    k = np.where(d <= 4 * sd, np.exp(-0.5 * (d / sd) ** 2), 0.0)
    return k / k.sum(axis=1, keepdims=True)


def smooth_gaussian(df: DataFrame, value: str, bandwidth: float = 2.68) -> DataFrame:
    """Normal-kernel smoothing of every profile: one matrix product per batch."""
    arrays, lo = profile_arrays(df, value)

    @F.pandas_udf(ArrayType(DoubleType()))
    def smooth(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy())
        return pd.Series(list(m @ _kernel(m.shape[1], bandwidth).T))

    d = arrays.select("sample", "protein", F.posexplode(smooth("x")).alias("_i", "smoothed"))
    return d.select("sample", "protein", (F.col("_i") + lo).cast("int").alias("fraction"), "smoothed")


PEAK = "array<struct<peakHeight: double, peakLocation: int, peakStart: int, peakEnd: int, cofmN: double, centerComplete: boolean, mean: double, var: double>>"


def find_peaks(
    df: DataFrame, value: str, bandwidth: float = 2.68, ups: int = 2, downs: int = 2, center_radius: int = 2, var_radius: int = 4, min_height: float = 0.01, min_cv: float = 0.2
) -> DataFrame:
    """Peaks of every smoothed profile with location, extent, centre of mass and quality.

    A peak is a rise of at least ``ups`` steps met by a fall of at least
    ``downs``. Good peaks are high, have no empty fraction near the top and vary
    enough around it (both on the unsmoothed profile).
    """
    arrays, lo = profile_arrays(df, value)

    @F.pandas_udf(PEAK)
    def locate(x: pd.Series) -> pd.Series:
        raw = np.stack(x.to_numpy())
        n = raw.shape[1]
        s = raw @ _kernel(n, bandwidth).T
        step = np.sign(np.diff(s, axis=1))
        up, down = np.zeros_like(raw, dtype=int), np.zeros_like(raw, dtype=int)
        for i in range(1, n):
            up[:, i] = np.where(step[:, i - 1] > 0, up[:, i - 1] + 1, 0)
        for i in range(n - 2, -1, -1):
            down[:, i] = np.where(step[:, i] < 0, down[:, i + 1] + 1, 0)
        out = []
        for r in range(len(raw)):
            peaks = []
            for c in np.nonzero((up[r] >= ups) & (down[r] >= downs))[0]:
                a, b = max(0, c - 2), min(n, c + 3)
                mass = s[r, a:b]
                near = raw[r, max(0, c - var_radius) : c + var_radius + 1]
                core = raw[r, max(0, c - center_radius) : c + center_radius + 1]
                peaks.append(
                    {
                        "peakHeight": float(s[r, c]), "peakLocation": int(c + lo), "peakStart": int(c - up[r, c] + lo), "peakEnd": int(c + down[r, c] + lo),
                        "cofmN": float((mass * (np.arange(a, b) + lo)).sum() / mass.sum()), "centerComplete": bool((core > 0).all()), "mean": float(near.mean()), "var": float(near.var(ddof=1)),
                    }
                )
            out.append(peaks)
        return pd.Series(out)

    d = arrays.select("sample", "protein", F.explode(locate("x")).alias("p")).select("sample", "protein", "p.*")
    d = d.withColumn("cv", ratio(F.sqrt("var"), F.col("mean")))
    return d.withColumn("goodPeak", (F.col("peakHeight") > min_height) & F.col("centerComplete") & F.coalesce(F.col("cv") > min_cv, F.lit(False)))


def good_peak_flags(df: DataFrame, peaks: DataFrame) -> DataFrame:
    """Protein x fraction flags of good peaks per sample."""
    good = peaks.where("goodPeak").select("sample", "protein", F.col("peakLocation").alias("fraction")).distinct().withColumn("_g", F.lit(True))
    return df.select("sample", "protein", "fraction").join(good, ["sample", "protein", "fraction"], "left").select("sample", "protein", "fraction", F.coalesce("_g", F.lit(False)).alias("goodPeak"))


def match_peaks(a: DataFrame, b: DataFrame, at: str = "peakLocation", keys: list[str] | None = None) -> DataFrame:
    """Pairs of peaks of a protein (inside ``keys``) that are each other's nearest; ``i_`` columns come from ``b``.

    Ties go to the lower location. Deltas the reversed axis could not hold become null.
    """
    keys = keys or []
    on = [*keys, "protein"]
    x = a.select(*on, F.col(at).alias("_at"), *[F.col(c).alias(c) for c in a.columns if c not in on])
    y = b.select(*on, F.col(at).alias("_at"), *[F.col(c).alias(f"i_{c}") for c in b.columns if c not in on])
    ab = nearest_join(x.withColumn("_id", F.col(at)), y.withColumn("_iid", F.col(f"i_{at}")), on, "_at", [c for c in y.columns if c not in (*on, "_at")] + ["_iid"], 64)
    ba = nearest_join(y.withColumn("_iid", F.col(f"i_{at}")), x.withColumn("_id", F.col(at)), on, "_at", ["_id"], 64).select(*on, "_iid", "_id").where(F.col("_id").isNotNull())
    d = cut(ab.where(F.col("_iid").isNotNull()).join(ba, [*on, "_id", "_iid"], "left_semi").drop("_at", "_id", "_iid", "nearest_at"))
    d = d.withColumn("deltaPeak", F.col(f"i_{at}") - F.col(at))
    ends = d.groupBy(*keys).agg(F.least(F.min(at), F.min(f"i_{at}")).alias("_lo"), F.greatest(F.max(at), F.max(f"i_{at}")).alias("_hi"))
    odd = (F.col("deltaPeak") > F.col(at) - F.col("_lo")) | (F.col("deltaPeak") < F.col(at) - F.col("_hi"))
    both = d.join(ends, keys) if keys else attach(d, ends)
    return both.withColumn("deltaPeak", F.when(~odd, F.col("deltaPeak"))).drop("_lo", "_hi")


def standard_curves(
    peaks: DataFrame, standard: str, min_per_fraction: int = 50, first: float = 1, last: float = 72, portion: float = 0.75, start_at: float = 15, span: float = 0.25, places: int = 200
) -> DataFrame:
    """``sample, x, y``: per sample the curve from its fractions to the standard's, as sorted arrays.

    Good peaks matched with the standard's, of well-filled fractions, middle
    part only, are fitted point by point (local quadratic), all samples in one
    job; the tails run straight to ``first`` and ``last``. A sample with fewer
    than four points has no curve; the standard's own is the line through both
    ends.
    """
    columns = ["sample", "protein", "peakLocation", "cofmN", "goodPeak"]
    own = peaks.where(F.col("sample") == standard).select(*columns[1:])
    others = peaks.where(F.col("sample") != standard).select(*columns)
    names = others.agg(F.collect_set("sample").alias("_names"))
    copies = attach(own, names).select(F.explode("_names").alias("sample"), *columns[1:])
    m = match_peaks(others, copies, keys=["sample"]).where(F.col("goodPeak") & F.col("i_goodPeak") & (F.col("cofmN") >= start_at) & (F.col("i_cofmN") >= start_at))
    m = cut(m.select("sample", "peakLocation", "cofmN", "i_cofmN"))
    by = ["sample", "peakLocation"]
    full = m.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_per_fraction)
    m = m.join(full.select(*by), by, "left_semi")
    side = (1 - portion) / 2
    lo, hi = exact_quantile(m, by, "i_cofmN", side, "_lo", stable=True), exact_quantile(m, by, "i_cofmN", 1 - side, "_hi", stable=True)
    m = m.join(lo, by).join(hi, by).where(F.col("i_cofmN").between(F.col("_lo"), F.col("_hi")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cofmN")
        x, y = pdf["cofmN"].to_numpy(float), pdf["i_cofmN"].to_numpy(float)
        if len(x) < 4 or x[0] == x[-1]:
            return pd.DataFrame({"sample": [], "x": [], "y": []})
        at = np.linspace(x[0], x[-1], places)
        curve = [(float(first), float(first)), *zip(at.tolist(), local_values(x, y, at, max(span, 4 / len(x)), 2).tolist(), strict=True), (float(last), float(last))]
        kept = [curve[0]]
        for point in curve[1:]:
            if point[0] > kept[-1][0]:
                kept.append(point)
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "x": [[p[0] for p in kept]], "y": [[p[1] for p in kept]]})

    kind = peaks.schema["sample"].dataType.simpleString()
    fitted = spread(m.select("sample", "cofmN", "i_cofmN"), "sample").groupBy("sample").applyInPandas(fit, f"sample {kind}, x array<double>, y array<double>")
    ends = F.array(F.lit(float(first)), F.lit(float(last)))
    return fitted.unionByName(peaks.where(F.col("sample") == standard).select("sample", ends.alias("x"), ends.alias("y")).distinct())


def along_curves(df: DataFrame, curves: DataFrame, value: str, out: str) -> DataFrame:
    """Add the value of a row's place on its sample's curve; null without a curve, flat beyond its ends."""

    @F.pandas_udf(DoubleType())
    def along(v: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.interp(a, b, c) if b is not None and a == a else None for a, b, c in zip(v, x, y, strict=True)], dtype=float)

    named = curves.select("sample", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return df.join(named, "sample", "left").withColumn(out, along(F.col(value).cast("double"), "_x", "_y")).drop("_x", "_y")


def align_peaks_to_standard(peaks: DataFrame, standard: str, **options) -> tuple[DataFrame, DataFrame]:
    """Peaks of all samples with ``cofmN_standardized``, and the curves; the standard's peaks keep their centres."""
    curves = cut(standard_curves(peaks, standard, **options))
    moved = along_curves(peaks, curves, "cofmN", "cofmN_standardized")
    return moved.withColumn("cofmN_standardized", F.when(F.col("sample") == standard, F.col("cofmN")).otherwise(F.col("cofmN_standardized"))), curves


def standard_fractions(df: DataFrame, curves: DataFrame) -> DataFrame:
    """Add ``standardFraction`` to the long table of all samples."""
    return along_curves(df, curves, "fraction", "standardFraction")


def mass_calibration(standards: DataFrame) -> DataFrame:
    """Slope and intercept of log10(mass) on fraction."""
    y = F.log10("mw")
    return standards.agg(F.regr_slope(y, F.col("fraction")).alias("slope"), F.regr_intercept(y, F.col("fraction")).alias("intercept"))


def fraction_to_mass(df: DataFrame, calibration: DataFrame, fraction: str, out: str = "mass") -> DataFrame:
    d = attach(df, calibration)
    return d.withColumn(out, F.pow(F.lit(10.0), F.col("intercept") + F.col("slope") * F.col(fraction))).drop("slope", "intercept")


def mass_to_fraction(df: DataFrame, calibration: DataFrame, mass: str, out: str = "massFraction") -> DataFrame:
    d = attach(df, calibration)
    return d.withColumn(out, ratio(F.log10(mass) - F.col("intercept"), F.col("slope"))).drop("slope", "intercept")


def resample_integer_fractions(df: DataFrame, value: str, lo: int = 1, hi: int = 72, bridge: bool = False) -> DataFrame:
    """Values on a line at whole standard fractions; missing values break the line unless bridged."""
    d = df.where(F.col("standardFraction").isNotNull())
    d = d.where(F.col(value).isNotNull()) if bridge else d
    pts = F.array_sort(F.collect_list(F.struct(F.col("standardFraction").alias("x"), F.col(value).alias("y"))))
    a = d.groupBy("sample", "treatment", "protein").agg(pts.alias("_p"))
    g = a.withColumn("_f", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    left = F.try_element_at(F.filter("_p", lambda p: p["x"] <= F.col("_f")), F.lit(-1))
    right = F.try_element_at(F.filter("_p", lambda p: p["x"] >= F.col("_f")), F.lit(1))
    g = g.withColumn("_l", left).withColumn("_r", right)
    width = F.col("_r")["x"] - F.col("_l")["x"]
    y = F.when(width == 0, F.col("_l")["y"]).otherwise(F.col("_l")["y"] + (F.col("_r")["y"] - F.col("_l")["y"]) * ratio(F.col("_f") - F.col("_l")["x"], width))
    error = F.when(F.size("_p") < 2, "need at least two non-NA values to interpolate")
    return g.select("sample", "treatment", "protein", F.col("_f").alias("standardFraction"), F.when(error.isNull(), y).alias(value), error.alias("error"))


# --- differential peaks ---------------------------------------------------------

def cluster_peaks(peaks: DataFrame, keys: list[str], at: str = "cofmN_standardized", max_distance: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(peaks with ``peakCluster``, one row per cluster: centre, count, mean height)."""
    p = linkage_on_line(peaks, keys, at, max_distance, "peakCluster")
    c = p.groupBy(*keys, "peakCluster").agg(F.avg(at).alias("center"), F.count(F.lit(1)).alias("numPeaks"), F.avg("peakHeight").alias("meanHeight"))
    return p, c


def _around(df: DataFrame, clusters: DataFrame, key: str, at: str, radius: float) -> DataFrame:
    c = clusters.select(F.col(key), "peakCluster", "center", (F.col("center") - radius).alias("_lo"), (F.col("center") + radius).alias("_hi"))
    return range_join(df, c, at, "_lo", "_hi", 2 * radius, [key])


TEST_SCHEMA = "term string, deltaInt double, SE double, t double, p double, error string"


#: cells times columns of the designs that are fitted at a time
DESIGN_CELLS = 4_000_000
ONE_TREATMENT = "one treatment only"


def _per_peak(cells: DataFrame, key: str, columns: list[str], fit) -> DataFrame:
    """Rows of ``TEST_SCHEMA`` of every peak. A peak's cells are one record; ``fit(start, treatment, columns)`` takes the cells of many peaks, in a row, by their starts."""
    made = spread(cells, key, "peakCluster").groupBy(key, "peakCluster").agg(F.collect_list(F.struct("treatment", *columns)).alias("_l"))

    def run(treatment: pa.Array, *lists: pa.Array) -> pa.Array:
        start = np.concatenate([[0], np.cumsum(treatment.value_lengths().to_numpy(zero_copy_only=False).astype(int))])
        flat = [x.flatten() for x in lists]
        names = treatment.flatten()
        out = [fit(start[lo : hi + 1] - start[lo], names.slice(start[lo], start[hi] - start[lo]), [x.slice(start[lo], start[hi] - start[lo]) for x in flat]) for lo, hi in _runs_of(start)]
        peak = np.concatenate([o["peak"] + lo for o, (lo, _) in zip(out, _runs_of(start), strict=True)]) if out else np.zeros(0, int)
        order = np.argsort(peak, kind="stable")
        joined = {c: [v for o in out for v in o[c]] for c in ("term", "deltaInt", "SE", "t", "p", "error")}
        fields = []
        for c, kind in (("term", pa.string()), ("deltaInt", pa.float64()), ("SE", pa.float64()), ("t", pa.float64()), ("p", pa.float64()), ("error", pa.string())):
            v = [joined[c][i] for i in order.tolist()]
            fields.append(pa.array(v, pa.string()) if kind == pa.string() else pa.array(np.array(v, float), mask=np.isnan(np.array(v, float))))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(peak, minlength=len(treatment)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["term", "deltaInt", "SE", "t", "p", "error"]))

    rows = F.arrow_udf(run, f"array<struct<{TEST_SCHEMA}>>")("_l.treatment", *[f"_l.{c}" for c in columns])
    return made.select(key, "peakCluster", F.explode(rows).alias("_r")).select(key, "peakCluster", "_r.*")


def _runs_of(start: np.ndarray, peaks: int = 2_000) -> list[tuple[int, int]]:
    return [(lo, min(lo + peaks, len(start) - 1)) for lo in range(0, len(start) - 1, peaks)]


def _levels(start: np.ndarray, names: pa.Array) -> tuple[np.ndarray, list[list[str]]]:
    """Number of every cell's level among the sorted levels of its peak (-1: null), and the levels."""
    coded = names.dictionary_encode()
    order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
    rank = np.empty(len(order) + 1, int)
    rank[order], rank[-1] = np.arange(len(order)), -1
    code = rank[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False).astype(int)]
    labels = [coded.dictionary[int(i)].as_py() for i in order]
    peak = np.repeat(np.arange(len(start) - 1), np.diff(start))
    known = code >= 0
    seen, at = np.unique(peak[known] * (len(order) + 1) + code[known], return_inverse=True)
    owner = seen // (len(order) + 1)
    inside = np.arange(len(seen)) - np.searchsorted(owner, owner, "left")
    local = np.full(len(code), -1)
    local[known] = inside[at]
    named = [[] for _ in range(len(start) - 1)]
    for p, c in zip(owner.tolist(), (seen % (len(order) + 1)).tolist(), strict=True):
        named[p].append(labels[c])
    return local, named


class PeakFits:
    """Weighted least squares of cell means of many peaks at once, columns taken in order.

    ``CellFit`` for a stack of padded designs (peaks x cells x columns, weight 0
    where padded): a column explained by earlier ones is left out.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        w = n
        y = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
        within = (q - w * y * y).sum(axis=1)
        root = np.sqrt(w)
        target = y * root
        columns = x.shape[2]
        basis = np.zeros((len(x), columns, x.shape[1]))
        self.kept, self.r = np.zeros((len(x), columns), bool), np.zeros((len(x), columns, columns))
        self.rss, self.rank = np.zeros((len(x), columns)), np.zeros((len(x), columns))
        self.effect = np.zeros((len(x), columns))
        rest_y = target.copy()
        for j in range(columns):
            col = x[:, :, j] * root
            rest = col
            for _ in range(2):
                part = np.einsum("gkc,gc->gk", basis[:, :j], rest)
                rest = rest - np.einsum("gkc,gk->gc", basis[:, :j], part)
                self.r[:, :j, j] += part
            size, whole = np.linalg.norm(rest, axis=1), np.linalg.norm(col, axis=1)
            keep = size > 1e-7 * np.maximum(whole, 1e-300)
            unit = np.where(keep[:, None], rest / np.where(keep, size, 1.0)[:, None], 0.0)
            basis[:, j], self.kept[:, j] = unit, keep
            self.r[:, j, j] = np.where(keep, size, 1.0)
            self.r[~keep, :j, j] = 0.0
            self.effect[:, j] = (unit * target).sum(axis=1)
            rest_y = rest_y - unit * (unit * rest_y).sum(axis=1)[:, None]
            self.rss[:, j] = within + (rest_y * rest_y).sum(axis=1)
            self.rank[:, j] = self.kept[:, : j + 1].sum(axis=1)
        self.cells = w.sum(axis=1)

    def coefficients(self, columns: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimates and standard errors of some columns, and the degrees of freedom."""
        inverse = np.linalg.inv(self.r)
        df = self.cells - self.rank[:, -1]
        sigma2 = np.where(df > 0, self.rss[:, -1] / np.where(df > 0, df, 1.0), np.nan)
        beta = np.einsum("gij,gj->gi", inverse[:, columns], self.effect)
        spread = np.einsum("gij,gij,gj->gi", inverse[:, columns], inverse[:, columns], self.kept.astype(float))
        return beta, np.sqrt(np.maximum(spread * sigma2[:, None], 0)), df


def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(float)


def _stacks(start: np.ndarray, columns: np.ndarray):
    """Peaks with equally many design columns, at most about ``DESIGN_CELLS`` padded values at a time, with the places of their cells."""
    size = np.diff(start)
    for width in np.unique(columns).tolist():
        some = np.flatnonzero(columns == width)
        some = some[np.argsort(size[some], kind="stable")]
        step = max(1, DESIGN_CELLS // max(1, int(size[some].max()) * max(1, width)))
        for lo in range(0, len(some), step):
            peaks = some[lo : lo + step]
            real = np.arange(size[peaks].max())[None, :] < size[peaks][:, None]
            yield peaks, real, np.where(real, start[peaks][:, None] + np.arange(real.shape[1])[None, :], 0)


class _Rows:
    """Rows of ``TEST_SCHEMA`` as columns, with the number of their peak."""

    def __init__(self):
        self.columns = {c: [] for c in ("peak", "term", "deltaInt", "SE", "t", "p", "error")}

    def add(self, peak, term=None, deltaInt=math.nan, SE=math.nan, t=math.nan, p=math.nan, error=None) -> None:
        for c, v in zip(self.columns, (peak, term, deltaInt, SE, t, p, error), strict=True):
            self.columns[c].append(v)

    def done(self) -> dict:
        return {**self.columns, "peak": np.array(self.columns["peak"], int)}


def _fit_anova(start: np.ndarray, names: pa.Array, columns: list[pa.Array]) -> dict:
    code, named = _levels(start, names)
    x, center, n, s, q = (_numbers(c) for c in columns)
    z = x - center
    levels = np.array([len(v) for v in named], int)
    rows = _Rows()
    for p in np.flatnonzero(levels < 2).tolist():
        rows.add(p, error=ONE_TREATMENT)
    for peaks, real, at in _stacks(start, np.where(levels < 2, 0, levels)):
        t = int(levels[peaks[0]])
        if t < 2:
            continue
        powers = np.stack([z[at] ** k / 5.0 ** (k - 1) for k in range(1, 5)], axis=2)
        group = (code[at][:, :, None] == np.arange(1, t)[None, None, :]).astype(float)
        both = (powers[:, :, :, None] * group[:, :, None, :]).reshape(*at.shape, -1)
        design = np.concatenate([np.ones((*at.shape, 1)), powers, group, both], axis=2) * real[:, :, None]
        fit = PeakFits(design, *(np.where(real, v[at], 0.0) for v in (n, s, q)))
        ends = [4, 3 + t, design.shape[2] - 1]
        left = fit.cells - fit.rank[:, -1]
        with np.errstate(all="ignore"):
            sigma2 = fit.rss[:, -1] / left
            found = []
            for term, small, large in (("treatment", *ends[:2]), ("interaction", *ends[1:])):
                k = fit.rank[:, large] - fit.rank[:, small]
                f = np.where((k > 0) & (sigma2 > 0), (fit.rss[:, small] - fit.rss[:, large]) / k / sigma2, np.nan)
                found.append((term, f, dist.f_upper(f, k, left)))
        for i, p in enumerate(peaks.tolist()):
            if left[i] <= 0:
                rows.add(p, error="too few values")
            else:
                for term, f, tail in found:
                    rows.add(p, term, t=f[i], p=tail[i])
    return rows.done()


def _fit_matched(start: np.ndarray, names: pa.Array, columns: list[pa.Array]) -> dict:
    code, named = _levels(start, names)
    place, places = _levels(start, columns[0])
    n, s, q = (_numbers(c) for c in columns[1:])
    levels, fractions = np.array([len(v) for v in named], int), np.array([len(v) for v in places], int)
    rows = _Rows()
    for p in np.flatnonzero(levels < 2).tolist():
        rows.add(p, error=ONE_TREATMENT)
    for peaks, real, at in _stacks(start, np.where(levels < 2, 0, levels * 100_000 + fractions)):
        t, f = int(levels[peaks[0]]), int(fractions[peaks[0]])
        if t < 2:
            continue
        fraction = (place[at][:, :, None] == np.arange(1, f)[None, None, :]).astype(float)
        group = (code[at][:, :, None] == np.arange(1, t)[None, None, :]).astype(float)
        fit = PeakFits(np.concatenate([np.ones((*at.shape, 1)), fraction, group], axis=2) * real[:, :, None], *(np.where(real, v[at], 0.0) for v in (n, s, q)))
        beta, error, df = fit.coefficients(slice(f, None))
        with np.errstate(all="ignore"):
            stat = beta / error
            free = np.where(df > 0, df, np.nan)
            tail = 2 * dist.t_upper(np.abs(stat).ravel(), np.broadcast_to(free[:, None], stat.shape).ravel()).reshape(stat.shape)
        tail[df <= 0] = np.nan
        for i, p in enumerate(peaks.tolist()):
            for j, name in enumerate(named[p][1:]):
                if fit.kept[i, f + j]:
                    rows.add(p, name, beta[i, j], error[i, j], stat[i, j], tail[i, j])
    return rows.done()


def peak_anova(df: DataFrame, clusters: DataFrame, key: str = "protein", at: str = "standardFraction", value: str = "intensity_totalScaled", radius: float = 5.0) -> DataFrame:
    """Quartic of the fraction with treatment: F of treatment and of its interaction, per peak."""
    d = _around(df.where(F.col(value) > 0), clusters, key, at, radius)
    d = d.select(key, "peakCluster", "center", F.col(at).cast("double").alias("x"), "treatment", F.log2(value).alias("y"))
    cells = d.groupBy(key, "peakCluster", "center", "x", "treatment").agg(F.count(F.lit(1)).alias("_n"), F.sum("y").alias("_s"), F.sum(F.col("y") * F.col("y")).alias("_q"))

    return _per_peak(cells, key, ["x", "center", "_n", "_s", "_q"], _fit_anova)


def peak_t_fraction_matched(df: DataFrame, clusters: DataFrame, key: str = "protein", at: str = "standardFraction", value: str = "intensity_totalScaled", radius: float = 3.5) -> DataFrame:
    """Treatment effect with each whole fraction as a level, per peak."""
    d = _around(df.where(F.col(value).isNotNull()), clusters, key, at, radius)
    v = F.col(value)
    cells = d.groupBy(key, "peakCluster", F.col(at).cast("string").alias("frac"), "treatment").agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))

    return _per_peak(cells, key, ["frac", "_n", "_s", "_q"], _fit_matched)


def peak_areas(df: DataFrame, clusters: DataFrame, key: str = "protein", at: str = "standardFraction", value: str = "intensity_totalScaled", radius: float = 3.5) -> DataFrame:
    """Trapezoid area per sample within bounds all samples of the peak share."""
    d = _around(df.where(F.col(value).isNotNull()), clusters, key, at, radius).select(key, "peakCluster", "sample", "treatment", F.col(at).cast("double").alias("x"), F.col(value).alias("y"))
    span = d.groupBy(key, "peakCluster", "sample").agg(F.min("x").alias("a"), F.max("x").alias("b")).groupBy(key, "peakCluster").agg(F.ceil(F.max("a")).alias("lo"), F.floor(F.min("b")).alias("hi"))
    d = d.join(span, [key, "peakCluster"])
    w = Window.partitionBy(key, "peakCluster", "sample").orderBy("x")
    d = d.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where(F.col("x0").isNotNull())
    a, b = F.greatest("x0", "lo"), F.least("x", "hi")
    at_x = lambda p: F.col("y0") + (F.col("y") - F.col("y0")) * ratio(p - F.col("x0"), F.col("x") - F.col("x0"))
    piece = F.when(b > a, (at_x(a) + at_x(b)) / 2 * (b - a)).otherwise(0.0)
    return d.groupBy(key, "peakCluster", "sample", "treatment").agg(F.sum(piece).alias("areaUnderPeak"))


def peak_t_area(areas: DataFrame, key: str = "protein") -> DataFrame:
    """Treatment differences of the areas, from group counts, means and variances (first treatment as base)."""
    g = areas.groupBy(key, "peakCluster", "treatment").agg(F.count(F.lit(1)).alias("n"), F.avg("areaUnderPeak").alias("m"), F.coalesce(F.var_samp("areaUnderPeak"), F.lit(0.0)).alias("v"))
    pool = g.groupBy(key, "peakCluster").agg(F.sum((F.col("n") - 1) * F.col("v")).alias("rss"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.min(F.struct("treatment", "n", "m")).alias("base"))
    d = g.join(pool, [key, "peakCluster"]).where(F.col("treatment") != F.col("base.treatment"))
    se = F.sqrt(ratio(F.col("rss"), F.col("df")) * (1 / F.col("n") + 1 / F.col("base.n")))
    d = d.select(key, "peakCluster", F.col("treatment").alias("term"), (F.col("m") - F.col("base.m")).alias("deltaInt"), se.alias("SE"), "df")
    d = d.withColumn("t", ratio(F.col("deltaInt"), F.col("SE")))
    return d.withColumn("p", 2 * dist.t_tail(F.abs("t"), F.col("df").cast("double"))).drop("df")


def full_contrast(df: DataFrame, peaks: DataFrame, at: str = "cofmN_standardized") -> DataFrame:
    """Peak clusters of good peaks with all three tests side by side."""
    _, clusters = cluster_peaks(peaks.where("goodPeak").select("protein", at, "peakHeight"), ["protein"], at)
    clusters = cut(clusters)
    a = peak_anova(df, clusters)
    wide = a.where(F.col("term").isNotNull()).groupBy("protein", "peakCluster").pivot("term", ["treatment", "interaction"]).agg(F.first("p"))
    wide = wide.withColumnsRenamed({"treatment": "anova_treatment_p", "interaction": "anova_interaction_p"})
    keys = ["protein", "peakCluster"]
    m = peak_t_fraction_matched(df, clusters).where(F.col("term").isNotNull()).select(*keys, "term", F.col("deltaInt").alias("matched_delta"), F.col("p").alias("matched_p"))
    s = peak_t_area(peak_areas(df, clusters)).select(*keys, "term", F.col("deltaInt").alias("area_delta"), F.col("p").alias("area_p"))
    return clusters.join(wide, keys, "left").join(m.join(s, [*keys, "term"], "full"), keys, "left")


# --- co-elution -----------------------------------------------------------------

def windowed_pairs(
    df: DataFrame, peaks: DataFrame, value: str, metric: str = "correlation", outer: int = 6, peak_radius: int = 1, threshold: float = 0.90, known: DataFrame | None = None, prior_odds: float = 0.01
) -> DataFrame:
    """Alike protein pairs around every fraction where both have a good peak, in every sample.

    Profiles are copied to the windows their peaks belong to; blocks of a window
    are multiplied as matrices and only pairs over the threshold become rows.
    With ``known`` pairs, kernel densities of known and other scores in the
    window (above the threshold) give a likelihood ratio and posterior.
    """
    arrays, lo = profile_arrays(df, value)
    hi = df.agg(F.max("fraction")).first()[0]
    by = ["sample", "start"]
    good = peaks.where("goodPeak").select("sample", "protein", F.col("peakLocation").alias("_p")).distinct()
    at = good.withColumn("start", F.explode(F.sequence(F.col("_p") - peak_radius, F.col("_p") + peak_radius))).where(F.col("start").between(lo + outer, hi - outer))
    at = at.groupBy("sample", "protein", "start").agg(F.min("_p").alias("peak"))
    d = at.join(arrays, ["sample", "protein"]).select(*by, "protein", "peak", F.slice("x", F.col("start") - lo - outer + 1, F.lit(2 * outer + 1)).alias("v"))
    d = cut(d.withColumn("portion", F.aggregate("v", F.lit(0.0), lambda a, b: a + b)))
    mean = F.col("portion") / (2 * outer + 1) if metric == "correlation" else F.lit(0.0)
    u = d.select(*by, "protein", "portion", "peak", F.transform("v", lambda x: x - mean).alias("c"))
    u = u.withColumn("_n", F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, b: a + b * b))).where(F.col("_n") > 1e-12).select(*by, "protein", "portion", "peak", F.transform("c", lambda x: x / F.col("_n")).alias("u"))
    # portions and peaks come with the pairs, which are as many as the square of the profiles
    p = blocked_pairs(u, by, "protein", "u", vector_dot, threshold, carry=("portion", "peak"))
    p = p.select(
        *by, F.col("a").alias("protein1"), F.col("b").alias("protein2"), F.least("score", F.lit(1.0)).alias("r"),
        *[F.col(f"{side}_{c}").alias(f"prot{i}{c.title()}") for i, side in ((1, "a"), (2, "b")) for c in ("portion", "peak")],
    ).where(F.col("r") > threshold)
    p = p.withColumn("corScore", -F.log10(F.greatest(1 - F.col("r"), F.lit(1e-16)))).withColumn("log2Ratio", F.log2(F.col("prot1Portion") / F.col("prot2Portion")))
    if known is None:
        return p
    k = known.select(F.least("protein1", "protein2").alias("protein1"), F.greatest("protein1", "protein2").alias("protein2")).distinct().withColumn("_k", F.lit(True))
    p = cut(p.join(k, ["protein1", "protein2"], "left").withColumn("knownInteractor", F.coalesce("_k", F.lit(False))).drop("_k"))
    for flag, out in ((True, "interactorLL"), (False, "bgLL")):
        dens = cut(kernel_density(p.where(F.col("knownInteractor") == flag), by, "corScore", 0.2))
        p = density_at(p, by, "corScore", dens, 512, out)
    p = p.withColumn("llRatio", ratio(F.col("interactorLL"), F.col("bgLL"))).withColumn("_o", F.col("llRatio") * prior_odds)
    return p.withColumn("postProb", F.col("_o") / (1 + F.col("_o"))).drop("_o")


def coeluting_members(
    complexes: DataFrame, peaks: DataFrame, masses: DataFrame, calibration: DataFrame, at: str = "cofmN_standardized", max_distance: float = 2.0, mass_factor: float = 1.5,
    min_members: int = 2, completeness: float = 0.5,
) -> DataFrame:
    """Per sample, complex and cluster of member peaks: members together, heights, centres, completeness."""
    c = complexes.select("complex_id", "complex_name", "protein").distinct()
    size = c.groupBy("complex_id").agg(F.count(F.lit(1)).alias("nMembers"))
    by = ["sample", "complex_id"]
    p = c.join(peaks.where("goodPeak").select("sample", "protein", "peakLocation", "peakHeight", F.col(at).alias("center")), "protein").join(masses.select("protein", "mw"), "protein", "left")
    p = linkage_on_line(p, by, "peakLocation", max_distance, "peakCluster")
    at_loc = p.groupBy(*by, "peakLocation").agg(F.sum("mw").alias("_mw"))
    p = mass_to_fraction(p.join(at_loc, [*by, "peakLocation"]).withColumn("_m", mass_factor * F.col("_mw")), calibration, "_m", "_limit")
    p = p.where(F.coalesce(F.col("peakLocation") <= F.col("_limit"), F.lit(True)))
    out = p.groupBy(*by, "complex_name", "peakCluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("peakLocation")), lambda x: x.cast("string")), ";").alias("peakLocations"),
        F.min("peakLocation").alias("peakStart"), F.max("peakLocation").alias("peakEnd"),
        F.array_join(F.array_sort(F.collect_set("protein")), ";").alias("coelutingMembers"), F.countDistinct("protein").alias("nCoelutingMembers"),
        F.avg("peakHeight").alias("peakHeight_mean"), F.stddev_samp("peakHeight").alias("peakHeight_sd"), F.avg("center").alias("center_mean"), F.stddev_samp("center").alias("center_sd"),
    )
    out = out.join(size, "complex_id").withColumn("completeness", F.col("nCoelutingMembers") / F.col("nMembers")).withColumn("decoy", F.col("complex_name").contains("decoy"))
    return out.where((F.col("nCoelutingMembers") >= min_members) & (F.col("completeness") >= completeness))


def score_coelution(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of each co-eluting cluster of a sample from its best member pair correlations."""
    m = F.split("coelutingMembers", ";")
    one = found.select("sample", "complex_id", "complex_name", "decoy", "peakCluster", "peakStart", "peakEnd", "completeness", m.alias("_m"), F.explode(m).alias("protein1"))
    p = one.withColumn("protein2", F.explode(F.filter("_m", lambda x: x > F.col("protein1")))).drop("_m")
    best = pairs.groupBy("sample", "protein1", "protein2", "prot1Peak", "prot2Peak").agg(F.max("corScore").alias("corScore"))
    j = p.join(best, ["sample", "protein1", "protein2"]).where(F.col("prot1Peak").between(F.col("peakStart"), F.col("peakEnd")) & F.col("prot2Peak").between(F.col("peakStart"), F.col("peakEnd")))
    return j.groupBy("sample", "complex_id", "complex_name", "decoy", "peakCluster", "completeness").agg(*[f("corScore").alias(f"corScore_{n}") for n, f in (("sum", F.sum), ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])


def intensity_bins(df: DataFrame, bins: int = 30, value: str = "intensity") -> DataFrame:
    """Equal-count bins (1..bins) of total intensity per sample and protein."""
    s = cut(df.groupBy("sample", "protein").agg(F.sum(value).alias("sumInts")))
    ranks = attach(rank_table(s, [], "sumInts"), s.agg(F.count(F.lit(1)).alias("_n")))
    picks = []
    for i in range(1, bins + 1):
        target = (F.col("_n") - 1) * (i / bins)
        low = F.min(F.when(F.col("rank_max") > F.floor(target + 1e-9), F.col("sumInts")))
        high = F.min(F.when(F.col("rank_max") > F.ceil(target - 1e-9), F.col("sumInts")))
        picks.append(low + (F.max(target) - F.floor(F.max(target) + 1e-9)) * (high - low))
    edges = ranks.agg(F.array(*picks).alias("q"))
    d = attach(s, edges)
    return d.select("sample", "protein", "sumInts", (F.size(F.filter("q", lambda e: e < F.col("sumInts"))) + 1).alias("bin"))


def trace_tables(df: DataFrame, annotation: DataFrame, calibration: DataFrame, fractions: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide intensities, protein annotation, fraction masses) with the same proteins in each."""
    both = df.select("protein").distinct().join(annotation.select("protein").distinct(), "protein")
    wide = df.join(both, "protein", "left_semi").groupBy("sample", "protein").pivot("fraction", fractions).agg(F.sum("intensity")).na.fill(0.0)
    frac = df.sparkSession.createDataFrame([(f,) for f in fractions], "fraction int")
    return wide, annotation.join(both, "protein", "left_semi"), fraction_to_mass(frac, calibration, "fraction")
