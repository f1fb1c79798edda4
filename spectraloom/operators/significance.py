"""Significance labels, adjusted p-values, ROC tables, densities, group tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import distributions as dist
from spectraloom.functions.columns import INF, as_col, is_finite, log10_pos, ratio
from spectraloom.functions.ordered import add_rank, p_adjust_bh, running_totals
from spectraloom.functions.session import attach, cut

__all__ = ["p_adjust_bh"]


def define_significance(
    df: DataFrame, p_threshold: float = 0.05, fc_threshold: float = 1.0, p_column: str = "pvalue", out: str = "sig"
) -> DataFrame:
    fc = F.col("log2FC")
    hit = is_finite(fc) & (F.abs(fc) > fc_threshold) & (as_col(p_column) < p_threshold)
    return df.withColumn(
        out,
        F.when(fc == INF, "infiniteUp")
        .when(fc == -INF, "infiniteDown")
        .when(hit & (fc > 0), "up")
        .when(hit, "down")
        .otherwise("not"),
    )


def rank_volcano_hits(df: DataFrame, fc_threshold: float = 1.0, p_threshold: float = 0.05) -> DataFrame:
    """Distance from the origin of the volcano and its rank inside (Label, sig)."""
    fc, p = F.col("log2FC"), F.col("pvalue")
    d = df.withColumn("volcanoDistance", F.when(is_finite(fc), F.sqrt(fc * fc + F.pow(log10_pos(p), 2))))
    passing = (p < p_threshold) & (F.abs(fc) > fc_threshold) & F.col("volcanoDistance").isNotNull()
    d = d.withColumn("_d", F.when(passing, F.col("volcanoDistance")))
    return add_rank(d, ["Label", "sig"], "_d", "rankVolcano", "avg", descending=True).drop("_d")


def significance_counts(df: DataFrame, protein: str = "Protein") -> DataFrame:
    """Distinct proteins per Label and class, with stacked label positions."""
    counts = df.groupBy("Label", "sig").agg(F.countDistinct(protein).alias("n"))
    w = Window.partitionBy("Label").orderBy(F.col("sig").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("ypos", F.sum("n").over(w) - F.col("n") / 2)


def lower_ci(fc: Column, se: Column, df: Column, p: float = 0.025) -> Column:
    """Confidence bound nearest to zero, clipped at zero."""
    upper = 1 - p if p < 0.5 else p
    bound = F.signum(fc) * (F.abs(fc) - dist.t_inverse(F.lit(upper), df.cast("double")) * se)
    return F.when(F.signum(bound) != F.signum(fc), 0.0).otherwise(bound)


def p_above(fc: Column, se: Column, df: Column, threshold: float = 0.0) -> Column:
    return dist.t_tail((F.abs(fc) - threshold) / se, df.cast("double"))


def p_s0(fc: Column, se: Column, df: Column, s0: float = 0.0) -> Column:
    return dist.t_tail(F.abs(fc / (se + s0)), df.cast("double")) * 2


def _parts(r: Column) -> tuple[Column, Column]:
    s = F.split(r, "/")
    return s[0].cast("bigint"), s[1].cast("bigint")


def odds_ratio_from_ratios(gene_ratio: Column, bg_ratio: Column) -> Column:
    (k, n), (m, total) = _parts(gene_ratio), _parts(bg_ratio)
    return ratio(ratio(k, n - k), ratio(m - k, (total - m) - (n - k)))


def term_score(gene_ratio: Column, bg_ratio: Column) -> Column:
    (k, n), (m, _) = _parts(gene_ratio), _parts(bg_ratio)
    return ratio(k * k, n * m)


def term_jaccard(gene_ratio: Column, bg_ratio: Column) -> Column:
    (k, n), (m, _) = _parts(gene_ratio), _parts(bg_ratio)
    return ratio(k, m + n - k)


def mag_sig_score(fc: Column, p: Column, scale: float = 2.0) -> Column:
    magnitude = scale * F.abs(fc)
    return F.sqrt(magnitude * F.least(-log10_pos(p), magnitude))


def welch_against_background(df: DataFrame, keys: list[str], value: str, is_test: Column, conf: float = 0.95) -> DataFrame:
    """Two-sample Welch test of the flagged rows against the rest, per key."""
    v = as_col(value)
    a, b = F.when(is_test, v), F.when(~is_test, v)
    s = df.groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{g}") for g, c in (("t", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )
    return welch_from_moments(s, conf)


def welch_from_moments(s: DataFrame, conf: float = 0.95) -> DataFrame:
    """Add estimate, t, df, p and interval from n_/m_/v_ columns of t and b."""
    qa, qb = ratio(F.col("v_t"), F.col("n_t")), ratio(F.col("v_b"), F.col("n_b"))
    d = s.withColumn("_se2", qa + qb).withColumn("_qa", qa).withColumn("_qb", qb)
    d = d.withColumn("estimate", F.col("m_t") - F.col("m_b")).withColumn(
        "df",
        ratio(
            F.pow("_se2", F.lit(2)),
            ratio(F.pow("_qa", F.lit(2)), F.col("n_t") - 1) + ratio(F.pow("_qb", F.lit(2)), F.col("n_b") - 1),
        ),
    )
    d = d.withColumn("t", ratio(F.col("estimate"), F.sqrt("_se2")))
    half = dist.t_inverse(F.lit(1 - (1 - conf) / 2), F.col("df")) * F.sqrt("_se2")
    return (
        d.withColumn("p", 2 * dist.t_tail(F.abs("t"), F.col("df")))
        .withColumn("_half", half)
        .withColumn("ci_low", F.col("estimate") - F.col("_half"))
        .withColumn("ci_high", F.col("estimate") + F.col("_half"))
        .drop("_se2", "_qa", "_qb", "_half")
    )


def fisher_greater_log10(shared: Column, size_a: Column, size_b: Column, background: Column) -> Column:
    """One-sided 2x2 exact test: the hypergeometric upper tail."""
    return dist.hypergeom_log10(*[c.cast("double") for c in (shared, size_a, background, size_b)])


def roc_by_group(
    df: DataFrame,
    keys: list[str],
    score: str,
    label: str = "label",
    negatives: tuple[str, ...] = ("decoy", "unknown"),
    positives: tuple[str, ...] = ("interactor",),
    descending: bool = False,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Running true and false positive rates per distinct score.

    ``totals`` may give ``totalPositive`` / ``totalNegative`` per group.
    """
    pos = F.coalesce(F.col(label).isin(*positives), F.lit(False)).cast("bigint")
    neg = F.coalesce(F.col(label).isin(*negatives), F.lit(False)).cast("bigint")
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, score)
        .agg(F.sum(pos).alias("numPositive"), F.sum(neg).alias("numNegative"), F.count(F.lit(1)).alias("ties"))
    )
    run = running_totals(counts, keys, score, sums=["numPositive", "numNegative", "ties"], descending=descending)
    if totals is None:
        totals = df.groupBy(*keys).agg(F.sum(pos).alias("totalPositive"), F.sum(neg).alias("totalNegative"))
    joined = run.join(totals, keys, "left") if keys else attach(run, totals)
    return joined.select(
        *keys,
        (F.col("ties_run") - F.col("ties") + 1).alias("scoreRank"),
        score,
        "numPositive",
        "numNegative",
        F.col("numPositive_run").alias("cumulPositives"),
        F.col("numNegative_run").alias("cumulNegatives"),
        ratio(F.col("numPositive_run"), F.col("totalPositive")).alias("tpr"),
        ratio(F.col("numNegative_run"), F.col("totalNegative")).alias("fpr"),
    )


def roc(df: DataFrame, score: str, **options) -> DataFrame:
    return roc_by_group(df, [], score, **options)


def score_by_gold_standard(
    df: DataFrame,
    score: str,
    denom_decoy: float,
    denom_interactor: float,
    group: str = "treatment",
    label: str = "gs",
    pseudo: int = 1,
) -> DataFrame:
    """Log10 ratio of interactor to decoy recovery at each score, made monotone.

    A row's decoy count is the number of decoys scoring at least as high in its
    group, and likewise for interactors; the best ratio seen at any lower score
    carries upward.
    """
    df = cut(df)
    is_decoy = (F.col(label) == "decoy").cast("bigint")
    is_int = (F.col(label) == "interactor").cast("bigint")
    c = df.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.sum(is_decoy).alias("nd"), F.sum(is_int).alias("ni"))
    c = running_totals(c, [group], score, sums=["nd", "ni"], descending=True)
    c = c.withColumn("decoyCount", F.col("nd_run") + pseudo).withColumn("interactorCount", F.col("ni_run") + pseudo)
    c = c.withColumn("log10DecoyRate", log10_pos("decoyCount") - math.log10(denom_decoy)).withColumn(
        "log10IntRate", log10_pos("interactorCount") - math.log10(denom_interactor)
    )
    c = c.withColumn("_r", F.col("log10IntRate") - F.col("log10DecoyRate"))
    c = running_totals(c, [group], score, maxima=["_r"])
    c = c.select(
        group, score, "decoyCount", "log10DecoyRate", "interactorCount", "log10IntRate", F.col("_r_run").alias("log10RateRatioID")
    )
    return df.join(c, [group, score], "left")


def kernel_density(
    df: DataFrame,
    keys: list[str],
    value: str,
    bandwidth: float,
    bounds: tuple[float, float] = (-math.inf, math.inf),
    grid: int = 512,
    cut: float = 3.0,
    bins: int = 4096,
) -> DataFrame:
    """Gaussian density on an even grid, mass reflected at finite bounds.

    Values are first counted per fine bin (linear split between neighbours), so
    each group meets the grid with at most ``bins`` weighted points.
    """
    v = F.col(value)
    finite_lo, finite_hi = math.isfinite(bounds[0]), math.isfinite(bounds[1])
    span = df.where(v.isNotNull()).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    span = span.withColumn("_lo", F.col("_lo") - cut * bandwidth).withColumn("_hi", F.col("_hi") + cut * bandwidth)
    known = df.where(v.isNotNull())
    d = known.join(span, keys) if keys else attach(known, span)
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = (v - F.col("_lo")) / step
    j = F.floor(at)
    binned = (
        d.select(*keys, "_lo", "_hi", "_n", F.explode(F.array(F.struct(j.alias("j"), (1 - (at - j)).alias("w")), F.struct((j + 1).alias("j"), (at - j).alias("w")))).alias("e"))
        .groupBy(*keys, "_lo", "_hi", "_n", F.col("e.j").alias("j"))
        .agg(F.sum("e.w").alias("w"))
        .withColumn("x0", F.col("_lo") + F.col("j") * step)
    )
    lo = F.greatest(F.col("_lo"), F.lit(bounds[0])) if finite_lo else F.col("_lo")
    hi = F.least(F.col("_hi"), F.lit(bounds[1])) if finite_hi else F.col("_hi")
    points = binned.select(
        *keys, "_n", "x0", "w", lo.alias("_from"), hi.alias("_to"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")
    ).withColumn("x", F.col("_from") + F.col("i") * (F.col("_to") - F.col("_from")) / (grid - 1))

    def bump(x: Column) -> Column:
        return F.exp(-F.pow((F.col("x") - x) / bandwidth, 2) / 2)

    mass = bump(F.col("x0"))
    if finite_lo:
        mass = mass + bump(2 * bounds[0] - F.col("x0"))
    if finite_hi:
        mass = mass + bump(2 * bounds[1] - F.col("x0"))
    norm = bandwidth * math.sqrt(2 * math.pi)
    return points.groupBy(*keys, "i").agg(
        F.first("x").alias("x"), (F.sum(F.col("w") * mass) / F.first("_n") / norm).alias("density")
    )


def density_at(df: DataFrame, keys: list[str], value: str, density: DataFrame, grid: int, out: str) -> DataFrame:
    """Linear lookup of a ``kernel_density`` grid at each value; zero outside."""
    ends = density.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "density"))), lambda s: s["density"]).alias("_d"),
    )
    j = df.join(ends, keys, "left") if keys else attach(df, ends)
    pos = (F.col(value) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (grid - 1)
    cell = F.least(F.floor(pos), F.lit(grid - 2)).cast("int")
    inside = F.col(value).between(F.col("_x0"), F.col("_x1"))
    left, right = F.try_element_at("_d", cell + 1), F.try_element_at("_d", cell + 2)
    return j.withColumn(out, F.when(inside, left + (pos - cell) * (right - left)).otherwise(0.0)).drop("_x0", "_x1", "_d")
