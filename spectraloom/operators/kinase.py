"""Kinase activity from site fold changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import distributions as dist
from spectraloom.functions.columns import is_finite, pack_sorted_distinct, require_columns
from spectraloom.functions.ordered import exact_median, p_adjust_bh
from spectraloom.functions.session import attach
from spectraloom.operators.enrich import gsea

SITE_KEY = ["CTRL_GENE_NAME", "TARGET_GENE_NAME", "TARGET_RES", "TARGET_POS"]


def kinase_sites(table: DataFrame) -> DataFrame:
    """Kinase rows only; family ids stand in for an empty kinase gene name."""
    family = (F.col("CTRL_NS") == "FPLX") & (F.coalesce("CTRL_GENE_NAME", F.lit("")) == "")
    return table.where(F.col("CTRL_IS_KINASE")).withColumn("CTRL_GENE_NAME", F.when(family, F.col("CTRL_ID")).otherwise(F.col("CTRL_GENE_NAME")))


def kinase_sites_scored(table: DataFrame, min_score: float = 5.0) -> DataFrame:
    """Predicted kinase-substrate table over a score, residue and position split."""
    return table.where(F.col("networkin_score") > min_score).select(
        F.col("GENE").alias("CTRL_GENE_NAME"), F.col("SUB_GENE").alias("TARGET_GENE_NAME"),
        F.substring("SUB_MOD_RSD", 1, 1).alias("TARGET_RES"), F.expr("try_cast(substring(SUB_MOD_RSD, 2) AS int)").alias("TARGET_POS"),
    )


def enzyme_sites(table: DataFrame, kinases: DataFrame | None = None) -> DataFrame:
    """Enzyme-substrate table under the common column names, phosphorylation only, kinases only if listed."""
    t = table.where(F.col("modification") == "phosphorylation")
    if kinases is not None:
        t = t.join(kinases.select(F.col("symbol").alias("enzyme_genesymbol")).distinct(), "enzyme_genesymbol", "left_semi")
    return t.select(
        F.col("enzyme_genesymbol").alias("CTRL_GENE_NAME"), F.col("substrate_genesymbol").alias("TARGET_GENE_NAME"),
        F.col("residue_type").alias("TARGET_RES"), F.col("residue_offset").alias("TARGET_POS"), F.col("substrate").alias("TARGET_UP_ID"),
    )


def kinase_data_to_sets(sites: DataFrame) -> DataFrame:
    site = F.concat(F.col("TARGET_RES"), F.col("TARGET_POS").cast("string"))
    return sites.select(
        F.concat_ws("_", "TARGET_GENE_NAME", site).alias("gene"), F.col("CTRL_GENE_NAME").alias("kinase"), F.concat_ws("_", "TARGET_UP_ID", site).alias("protein")
    )


def set_z_scores(merged: DataFrame, term: str = "CTRL_GENE_NAME", site: str = "singleSite", by: list[str] | None = None) -> DataFrame:
    """Z of each term's mean fold change against the background columns ``bgMean, bgSD``.

    The mean for Z is over distinct (combination, fold change, site); the scale
    is the square root of the number of distinct combinations.
    """
    by = by or []
    flat = merged.groupBy(*by, term, "phSiteCombo", "log2FC", F.col(site).alias("_site"), "bgMean", "bgSD").agg(F.count(F.lit(1)).alias("_c"))
    s = flat.groupBy(*by, term).agg(
        F.avg("log2FC").alias("_m"), F.countDistinct("phSiteCombo").alias("N"), (F.sum(F.col("log2FC") * F.col("_c")) / F.sum("_c")).alias("meanLog2FC"),
        pack_sorted_distinct("_site").alias("sites"), F.first("bgMean").alias("bgMean"), F.first("bgSD").alias("bgSD"),
    )
    z = F.try_divide((F.col("_m") - F.col("bgMean")) * F.sqrt("N"), F.col("bgSD"))
    s = s.withColumn("Z", z).withColumn("pValue", dist.normal_two_sided("Z"))
    s = s.withColumn("sigScore", -F.log10(F.greatest("pValue", F.lit(1e-320))) * F.when(F.col("Z") < 0, -1).otherwise(1))
    return p_adjust_bh(s, "pValue", "fdr_BH", by).drop("_m")


def kinase_map(
    sites: DataFrame, kinase_data: DataFrame, by: list[str], outlier: float | None = 10.0, match_residue: bool = True, uniprot: bool = False
) -> DataFrame:
    """Clean site rows joined to kinase knowledge, with the background of all clean rows."""
    source = "uniprot" if uniprot else "Gene_Name"
    target = "TARGET_UP_ID" if uniprot else "TARGET_GENE_NAME"
    require_columns(sites, *by, "log2FC", "pos", "phSiteCombo", source, *(["aa"] if match_residue else []))
    keys = [target, *(["TARGET_RES"] if match_residue else []), "TARGET_POS"]
    known = kinase_data.select("CTRL_GENE_NAME", *keys).distinct()
    clean = sites.where(is_finite("log2FC"))
    if outlier is not None:
        clean = clean.where(F.abs("log2FC") < abs(outlier))
    background = clean.groupBy(*by).agg(F.avg("log2FC").alias("bgMean"), F.stddev_samp("log2FC").alias("bgSD"))
    cond = (F.col(source) == F.col(target)) & (F.col("pos") == F.col("TARGET_POS"))
    if match_residue:
        cond = cond & (F.col("aa") == F.col("TARGET_RES"))
    mapped = clean.join(known, cond).drop(*keys)
    return mapped.join(background, by) if by else attach(mapped, background)


def kinase_activity(sites: DataFrame, kinase_data: DataFrame, by: list[str] | None = None, **options) -> DataFrame:
    return set_z_scores(kinase_map(sites, kinase_data, by or [], **options), by=by or [])


def kinase_activity_by_label(sites: DataFrame, kinase_data: DataFrame, **options) -> DataFrame:
    """All Labels in one job; each has its own background."""
    return kinase_activity(sites, kinase_data, ["Label"], **options)


def kinase_sea(mapped: DataFrame, full: DataFrame | None = None, center: bool = False, **options) -> DataFrame:
    """Ranked-list score per kinase: one value per site combination, sets of combinations per kinase."""
    source = mapped if full is None else full
    scores = source.where(is_finite("log2FC")).groupBy(F.col("Label").alias("grp"), F.col("phSiteCombo").alias("gene")).agg(F.max("log2FC").alias("score"))
    if center:
        scores = scores.join(exact_median(scores, ["grp"], "score", "_med"), "grp").select("grp", "gene", (F.col("score") - F.col("_med")).alias("score"))
    sets = mapped.select(F.col("CTRL_GENE_NAME").alias("ont"), F.col("phSiteCombo").alias("gene")).distinct()
    return gsea(scores, sets, **options)


def kinase_matrix(scores: DataFrame, value: str, labels: list[str], max_fdr: float = 0.05, min_n: int = 2) -> DataFrame:
    """Kinases significant in any Label, wide over Labels."""
    sig = scores.where((F.col("fdr_BH") < max_fdr) & (F.col("N") >= min_n)).select("CTRL_GENE_NAME").distinct()
    return scores.join(sig, "CTRL_GENE_NAME", "left_semi").groupBy("CTRL_GENE_NAME").pivot("Label", labels).agg(F.first(value))
