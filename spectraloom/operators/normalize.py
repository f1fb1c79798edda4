"""Run normalization of peptide and protein intensities."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.columns import log2_pos
from spectraloom.functions.ordered import exact_median, exact_quantile
from spectraloom.functions.session import attach, cut, design_levels

#: columns that a polish takes: their effects are one array on the driver and in the tasks
MAX_LEVELS = 1_000_000


def _array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.ceil((n + 1) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def median_polish(
    df: DataFrame, row: str, column: str, value: str, eps: float = 0.01, max_rounds: int = 10
) -> tuple[float, dict, DataFrame]:
    """Tukey median polish of a long row x column table.

    Returns (overall, {column level: effect}, rows with their effect). A row is
    one record holding its at most #columns values, so row medians need no
    shuffle; column medians are exact distributed quantiles and only the
    column effects (one per level) reach the driver. Levels are numbered, and
    the effects go back as one array that a cell reads by its number.
    """
    levels = design_levels(df, column, MAX_LEVELS)
    if levels is None:
        raise ValueError(f"{column} has over {MAX_LEVELS} levels")
    spark, dtype = df.sparkSession, df.schema[column].dataType
    numbers = spark.createDataFrame([(lv, i) for i, lv in enumerate(levels, 1)], T.StructType([T.StructField("_level", dtype), T.StructField("c", T.IntegerType())]))
    cells = df.where(F.col(value).isNotNull()).groupBy(row, column).agg(F.max(value).alias("v")).join(numbers, F.col(column) == F.col("_level"))
    rows = cut(cells.groupBy(row).agg(F.collect_list(F.struct("c", "v")).alias("z"))).withColumn("r", F.lit(0.0))
    overall, effect, old = 0.0, dict.fromkeys(levels, 0.0), 0.0
    for _ in range(max_rounds):
        delta = _array_median(F.transform("z", lambda x: x["v"]))
        rows = rows.withColumn("_d", delta).select(
            row, F.transform("z", lambda x: F.struct(x["c"].alias("c"), (x["v"] - F.col("_d")).alias("v"))).alias("z"), (F.col("r") + F.col("_d")).alias("r")
        )
        rows = cut(rows)
        shift = statistics.median(effect.values())
        overall += shift
        flat = rows.select(F.explode("z").alias("x")).select(F.col("x.c").alias("c"), F.col("x.v").alias("v"))
        step = {levels[x["c"] - 1]: x["m"] for x in exact_median(flat, ["c"], "v", "m", stable=True).collect()}
        effect = {k: v - shift + step.get(k, 0.0) for k, v in effect.items()}
        moves = spark.createDataFrame([([float(step.get(k, 0.0)) for k in levels],)], "_moves array<double>")
        rows = attach(rows, moves).select(row, F.transform("z", lambda x: F.struct(x["c"].alias("c"), (x["v"] - F.element_at("_moves", x["c"])).alias("v"))).alias("z"), "r")
        mid = exact_median(rows.select("r"), [], "r", "m", stable=True).first()["m"]
        overall += mid
        rows = rows.withColumn("r", F.col("r") - F.lit(mid))
        new = rows.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.abs(x["v"])))).first()[0]
        if new == 0 or abs(new - old) < eps * new:
            break
        old = new
    return overall, effect, rows


def _offset_table(df: DataFrame, column: str, effect: dict, out: str) -> DataFrame:
    dtype = df.schema[column].dataType.simpleString()
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in effect.items()], f"`{column}` {dtype}, `{out}` double")


def normalize_median_polish(df: DataFrame, standards: list[str] | None = None) -> DataFrame:
    """``proteinID, featureID, runID, logIntensity`` with the run effect subtracted from all rows.

    The effect may be learnt from standard proteins only; none matching fails.
    """
    base = df if standards is None else df.where(F.col("proteinID").isin(standards))
    if standards is not None and base.isEmpty():
        raise ValueError("no feature matches the requested standards")
    _, effect, _ = median_polish(base, "featureID", "runID", "logIntensity")
    offsets = _offset_table(df, "runID", effect, "offset")
    d = df.join(offsets, "runID", "left")
    return d.withColumn("normLogIntensity", F.col("logIntensity") - F.col("offset")).drop("offset")


def normalize_table_median_polish(
    df: DataFrame, feature: list[str], run: str, protein: str, intensity: str = "Intensity", standards: list[str] | None = None
) -> DataFrame:
    """Same on a table of linear intensities; the old value is kept."""
    d = df.withColumns(
        {"proteinID": F.col(protein), "featureID": F.concat_ws("_", *[F.col(f"`{c}`").cast("string") for c in feature]), "runID": F.col(f"`{run}`"), "logIntensity": log2_pos(intensity)}
    )
    d = normalize_median_polish(d, standards)
    d = d.withColumn(f"{intensity}_prenormalization", F.col(intensity)).withColumn(intensity, F.pow(F.lit(2.0), "normLogIntensity"))
    return d.drop("proteinID", "featureID", "runID", "logIntensity", "normLogIntensity")


def _median_adjust(df: DataFrame, chosen: DataFrame, feature: list[str], by: list[str], intensity: str) -> DataFrame:
    """Multiply by 2^(overall median - group median) of log2 over the chosen features."""
    base = cut(df.join(chosen, feature, "left_semi").select(*[F.col(f"`{c}`") for c in by], log2_pos(intensity).alias("_l")).where(F.col("_l").isNotNull()))
    overall = exact_median(base, [], "_l", "_all", stable=True)
    per = exact_median(base, by, "_l", "_m", stable=True)
    adj = attach(per, overall).select(*[F.col(f"`{c}`") for c in by], (F.col("_all") - F.col("_m")).alias("adjustment"))
    return df.join(adj, by, "left").withColumn(intensity, F.col(intensity) * F.pow(F.lit(2.0), F.coalesce("adjustment", F.lit(0.0)))).drop("adjustment")


_ION = ["ProteinName", "PeptideSequence", "PrecursorCharge"]


def _seen_in_runs(df: DataFrame, feature: list[str], run: list[str], intensity: str, min_quantile: float, need) -> DataFrame:
    floor = exact_quantile(df.select(intensity), [], intensity, min_quantile, "_min", stable=True)
    cells = attach(df, floor).where(F.col(intensity) > F.col("_min"))
    runs = df.agg(F.countDistinct(*[F.col(f"`{r}`") for r in run]).alias("_runs"))
    counts = cells.groupBy(*[F.col(f"`{c}`") for c in feature]).agg(F.countDistinct(*[F.col(f"`{r}`") for r in run]).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    return attach(counts, runs).where(need(F.col("_n"), F.col("_rows"), F.col("_runs"))).drop("_n", "_rows", "_runs")


def normalize_complete_case(df: DataFrame, min_quantile: float = 0.0) -> DataFrame:
    """Scale each Condition and BioReplicate by features above the floor in every run."""
    run = ["BioReplicate", "Condition", "Run"]
    chosen = _seen_in_runs(df, _ION, run, "Intensity", min_quantile, lambda n, rows, runs: n == runs)
    return _median_adjust(df, chosen, _ION, ["Condition", "BioReplicate"], "Intensity")


def normalize_complete_case_maxquant(df: DataFrame, min_quantile: float = 0.0) -> DataFrame:
    """Same per raw file on evidence; contaminant and reversed features do not vote."""
    feature = ["Proteins", "Modified sequence", "Charge"]
    floor = exact_quantile(df.select("Intensity"), [], "Intensity", min_quantile, "_min", stable=True)
    good = attach(df.where((F.col("Proteins") != "") & ~F.col("Proteins").rlike("CON|REV")), floor).where(F.col("Intensity") > F.col("_min"))
    # the runs that count are those of the good rows, as columns of the wide table would be
    runs = good.agg(F.countDistinct("Raw file").alias("_runs"))
    counts = good.groupBy(*[F.col(f"`{c}`") for c in feature]).agg(F.countDistinct("Raw file").alias("_n"))
    chosen = attach(counts, runs).where(F.col("_n") == F.col("_runs")).drop("_n", "_runs")
    return _median_adjust(df, chosen, feature, ["Raw file"], "Intensity")


def normalize_nearly_complete(df: DataFrame, require: float = 0.5, min_quantile: float = 0.0) -> DataFrame:
    """Same with features having at least a share of the runs (rows are counted)."""
    run = ["BioReplicate", "Condition", "Run"]
    chosen = _seen_in_runs(df, _ION, run, "Intensity", min_quantile, lambda n, rows, runs: rows >= F.ceil(runs * require))
    return _median_adjust(df, chosen, _ION, ["Condition", "BioReplicate"], "Intensity")


def complete_median_centered(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Complete ions x samples in log2, columns shifted to the median of column medians."""
    cells = df.groupBy(F.concat_ws(".", *[F.col(c).cast("string") for c in _ION]).alias("ion"), F.concat_ws("_", "Condition", "Run").alias("sample")).agg(F.max("Intensity").alias("v"))
    cells = cells.select("ion", "sample", log2_pos("v").alias("logIntensity"))
    total = cells.agg(F.countDistinct("sample").alias("_runs"))
    full = attach(cells.where(F.col("logIntensity").isNotNull()).groupBy("ion").agg(F.count(F.lit(1)).alias("_n")), total).where(F.col("_n") == F.col("_runs"))
    d = cut(cells.join(full.select("ion"), "ion", "left_semi"))
    if not normalize:
        return d
    med = cut(exact_median(d, ["sample"], "logIntensity", "_m", stable=True))
    middle = med.agg(F.median("_m").alias("_all"))
    shift = attach(med, middle).select("sample", (F.col("_m") - F.col("_all")).alias("_s"))
    return d.join(shift, "sample").withColumn("logIntensity", F.col("logIntensity") - F.col("_s")).drop("_s")


def to_linear_matrix(df: DataFrame, row: str, column: str, value: str, require: float = 0.5) -> DataFrame:
    """Rows with enough values as shares of their largest linear value, zero where missing."""
    from spectraloom.operators.relational import complete_grid

    cells = df.where(F.col(value).isNotNull()).groupBy(row, column).agg(F.max(value).alias(value))
    total = df.agg(F.countDistinct(column).alias("_cols"))
    need = F.col("_cols") * require if require < 1.0 else F.lit(require)
    good = attach(cells.groupBy(row).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_max")), total).where(F.col("_n") >= need)
    d = cells.join(good.select(row, "_max"), row).withColumn("linear", F.pow(F.lit(2.0), F.col(value) - F.col("_max")))
    return complete_grid(d.select(row, column, "linear"), [row], column, "linear", 0.0)


def normalize_to_background(df: DataFrame, background: list[str], k: int = 5, rounds: int = 30, seed: int = 1) -> DataFrame:
    """Offsets from the part of the signal that known background proteins do not explain.

    The median profile of the background proteins is one fixed factor beside
    ``k`` free non-negative ones; what it explains is subtracted, values under
    2^-10 are dropped and the rest is median-polished for sample offsets.
    """
    from spectraloom.operators.models import factorize_nonnegative

    d = df.withColumn("_sample", F.concat_ws("_", "GROUP_ORIGINAL", "SUBJECT_ORIGINAL"))
    linear = cut(to_linear_matrix(d, "Protein", "_sample", "LogIntensities"))
    known = linear.where(F.col("Protein").isin(background))
    if known.isEmpty():
        raise ValueError("no known background protein in the table")
    profile = exact_median(known, ["_sample"], "linear", "h", stable=True)
    basis, coef = factorize_nonnegative(linear, "Protein", "_sample", "linear", k, rounds=rounds, seed=seed, fixed=profile.withColumnRenamed("_sample", "col"))
    free = basis.where(F.col("factor") < k).join(coef, "factor").groupBy("row", "col").agg(F.sum(F.col("w") * F.col("h")).alias("v"))
    free = free.where(F.col("v") >= math.pow(2, -10)).select(F.col("row").alias("Protein"), F.col("col").alias("_sample"), F.log2("v").alias("v"))
    _, effect, _ = median_polish(cut(free), "Protein", "_sample", "v")
    offsets = _offset_table(d, "_sample", effect, "normalizeOffset")
    return d.join(F.broadcast(offsets), "_sample", "left").withColumn("preNormalize", F.col("LogIntensities")).withColumn("LogIntensities", F.col("LogIntensities") - F.col("normalizeOffset")).drop("_sample")
