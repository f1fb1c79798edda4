"""Bait-prey scoring: imputation, robust Z, specificity, count models, gold standards, convergence."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import distributions as dist
from spectraloom.functions.columns import pack_sorted_distinct, ratio
from spectraloom.functions.ordered import add_order, ecdf_table, exact_quantile, running_totals
from spectraloom.functions.session import attach, cut, spread
from spectraloom.operators.graph import hop_distances, one_edge_per_node, spanning_forest
from spectraloom.operators.relational import FEW_NAMES, complete_grid, dense_index, level_pairs, meeting, permuted_index, permuted_sets, shared_counts
from spectraloom.operators.significance import welch_from_moments  # noqa: F401  the plans take it from here


# --- imputation and robust Z ----------------------------------------------------

def _huber(x: np.ndarray, y: np.ndarray, rounds: int = 20, k: float = 1.345) -> tuple[np.ndarray, np.ndarray]:
    """Huber regression by reweighting, scale from the median absolute residual."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        resid = y - x @ beta
        scale = np.median(np.abs(resid)) / 0.6745
        if scale <= 0:
            break
        w = np.minimum(1.0, k * scale / np.maximum(np.abs(resid), 1e-300))
        new = np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        moved = y - x @ new
        done = np.sqrt(np.sum((resid - moved) ** 2) / max(1e-20, np.sum(resid**2))) <= 1e-4
        beta = new
        if done:
            break
    return beta, y - x @ beta


def _seeded_normal(*keys: Column | str) -> Column:
    """Standard normal from row keys, so a draw does not depend on partitions."""
    def unit(salt: int) -> Column:
        return (F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(2**52)) + 0.5) / float(2**52)

    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * math.pi * unit(2))


#: cells of the padded tables that a step over many preys holds at a time
CELLS = 2_000_000


def _padded(lists: pa.Array, dtype=float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length from a list array, and which cells are real."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    real = np.arange(n.max(initial=0))[None, :] < n[:, None]
    out = np.zeros(real.shape, dtype)
    out[real] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, real


def _codes(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct names in a list array, and the number of the name in every cell (-1: null)."""
    named = lists.flatten().dictionary_encode()
    return named.dictionary, named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(int)


def _starts(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(int))])


def _portions(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of alike length, padded to at most about ``CELLS`` cells at a time."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = len(order)
        while stop - start > 1 and (stop - start) * max(1, lengths[order[stop - 1]]) > CELLS:
            stop = start + max(1, (stop - start) // 2)
        yield order[start:stop]
        start = stop


def _row_medians(x: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Median of the chosen cells of each row; nan without any."""
    n = use.sum(axis=1)
    s = np.sort(np.where(use, x, np.inf), axis=1)
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, max(0, x.shape[1] - 1))
    r = np.arange(len(x))
    return np.where(n > 0, (s[r, low] + s[r, high]) / 2, np.nan) if x.shape[1] else np.full(len(x), np.nan)


def _huber_lines(m: np.ndarray, y: np.ndarray, use: np.ndarray, sloped: bool, rounds: int = 20, k: float = 1.345) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_huber`` of every row: a line on ``m``, or a level, over the chosen cells. Intercepts, slopes, residuals."""

    def solve(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = w.sum(axis=1)
        at_y = (w * y).sum(axis=1) / total
        slope = np.zeros(len(y))
        at_m = (w * m).sum(axis=1) / total
        if sloped:
            dm = np.where(use, m - at_m[:, None], 0.0)
            slope = (w * dm * (y - at_y[:, None])).sum(axis=1) / (w * dm * dm).sum(axis=1)
        level = at_y - slope * at_m
        return level, slope, np.where(use, y - level[:, None] - slope[:, None] * m, 0.0)

    y, m = np.where(use, y, 0.0), np.where(use, m, 0.0)
    level, slope, resid = solve(use.astype(float))
    live = np.ones(len(y), bool)
    for _ in range(rounds):
        scale = _row_medians(np.abs(resid), use) / 0.6745
        live &= scale > 0
        if not live.any():
            break
        w = np.where(use, np.minimum(1.0, k * scale[:, None] / np.maximum(np.abs(resid), 1e-300)), 0.0)
        w[~live] = use[~live]
        a, b, moved = solve(w)
        done = np.sqrt(((resid - moved) ** 2).sum(axis=1) / np.maximum(1e-20, (resid**2).sum(axis=1))) <= 1e-4
        level, slope, resid = np.where(live, a, level), np.where(live, b, slope), np.where(live[:, None], moved, resid)
        live &= ~done
    return level, slope, resid


def _fit_missing(y: np.ndarray, m: np.ndarray, real: np.ndarray, low: float, offset: float, min_sd: float) -> tuple[np.ndarray, np.ndarray]:
    """Prediction and SD of every cell from its bait's missing replicates; a row is a prey, nan in ``y`` is missing."""
    seen = real & ~np.isnan(y)
    part = seen & (m > 0)
    n = part.sum(axis=1)
    lowest, highest = np.where(part, m, np.inf).min(axis=1, initial=np.inf), np.where(part, m, -np.inf).max(axis=1, initial=-np.inf)
    floor = np.where(seen, y, np.inf).min(axis=1, initial=np.inf)
    level = np.where(np.isfinite(floor), np.minimum(floor - offset, low), low)
    slope, sd = np.zeros(len(y)), np.full(len(y), min_sd)
    one = n == 1
    level[one] = np.where(part, y, 0.0).sum(axis=1)[one]

    def put(rows: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        use, resid = part[rows], fit[2]
        level[rows], slope[rows] = fit[0], fit[1]
        mean = resid.sum(axis=1) / n[rows]
        std = np.sqrt(np.where(use, (resid - mean[:, None]) ** 2, 0.0).sum(axis=1) / (n[rows] - 1))
        around = 1.4826 * _row_medians(np.abs(resid - _row_medians(resid, use)[:, None]), use)
        sd[rows] = np.maximum(min_sd, np.minimum(std, around))

    falls = np.zeros(len(y), bool)
    if len(rows := np.flatnonzero((n > 1) & (lowest < highest))):
        fit = _huber_lines(m[rows], y[rows], part[rows], True)
        down = fit[1] < 0
        falls[rows[down]] = True
        put(rows[down], tuple(f[down] for f in fit))
    if len(rows := np.flatnonzero((n > 1) & ~falls)):
        put(rows, _huber_lines(m[rows], y[rows], part[rows], False))
    return level[:, None] + slope[:, None] * m, np.broadcast_to(sd[:, None], y.shape)


def _records(df: DataFrame) -> DataFrame:
    """One record a prey, its rows in ``_l``; rows without a prey lie apart, in small ones.

    Rows that lie by prey already, as those of a grid do, are not dealt out again.
    """
    apart = F.when(F.col("preyProtein").isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(100_000))).alias("_apart")
    return df.groupBy("preyProtein", apart).agg(F.collect_list(F.struct(*df.columns)).alias("_l")).drop("_apart")


def impute_missing_by_prey(df: DataFrame, floor: float | None = None, offset: float = 2.0, min_sd: float = 0.33, seed: int = 42) -> DataFrame:
    """Fill missing log2 intensities per prey from how many replicates each bait misses.

    A robust line of intensity on the number missing is used when it falls;
    else a robust mean, a single value, or the low end of the prey. A prey has
    at most one row per run. Adds ``predicted, SD, replaceNA``. A prey is one
    record, and the lines of all preys of a batch are fitted at once.
    """
    columns = ["preyProtein", "run", *[c for c in df.columns if c not in ("preyProtein", "run")], "predicted", "SD", "replaceNA"]
    rows = _imputed(df, floor, offset, min_sd, seed).select("preyProtein", F.explode("_l").alias("_r"))
    return rows.select("preyProtein", *[F.col(f"_r.{c}").alias(c) for c in columns[1:]])


def _imputed(df: DataFrame, floor: float | None = None, offset: float = 2.0, min_sd: float = 0.33, seed: int = 42) -> DataFrame:
    """The records of ``impute_missing_by_prey``: a prey's rows with what is added to them."""
    if floor is None:
        floor = exact_quantile(df.select("log2Intensity"), [], "log2Intensity", 0.01, "q").first()["q"]
    low = float(floor)

    @F.arrow_udf("array<struct<predicted: double, SD: double>>")
    def fit(ys: pa.Array, gone: pa.Array, baits: pa.Array) -> pa.Array:
        start, (names, code) = _starts(ys), _codes(baits)
        cell = np.repeat(np.arange(len(ys)), np.diff(start)) * (len(names) + 1) + code + 1
        _, pair = np.unique(cell, return_inverse=True)
        number = np.bincount(pair, gone.flatten().to_numpy(zero_copy_only=False))[pair]
        y = ys.flatten().to_numpy(zero_copy_only=False)
        predicted, sd = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for some in _portions(np.diff(start)):
            values, real = _padded(ys.take(pa.array(some)))
            at = start[some][:, None] + np.arange(values.shape[1])[None, :]
            missing = np.zeros(values.shape)
            missing[real] = number[at[real]]
            p, s = _fit_missing(values, missing, real, low, offset, min_sd)
            predicted[at[real]], sd[at[real]] = p[real], s[real]
        there = ~np.isnan(y)
        return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.StructArray.from_arrays([pa.array(predicted, mask=there), pa.array(sd, mask=there)], ["predicted", "SD"]))

    # rows without a bait take no part: they are unknown, and of no bait's replicates
    value = F.transform("_l", lambda r: F.coalesce(F.when(r["bait"].isNotNull(), r["log2Intensity"].cast("double")), F.lit(float("nan"))))
    gone = F.transform("_l", lambda r: r["log2Intensity"].isNull().cast("double"))
    d = _records(df).select("preyProtein", F.arrays_zip(F.col("_l").alias("row"), fit(value, gone, F.col("_l.bait")).alias("fit")).alias("_l"))

    def filled(c: Column) -> Column:
        row = c["row"]
        named = row["preyProtein"].isNotNull() & row["bait"].isNotNull() & row["run"].isNotNull()
        predicted, sd = (F.when(named, c["fit"][x]) for x in ("predicted", "SD"))
        draw = F.greatest(predicted, F.lit(low)) + sd * _seeded_normal(row["preyProtein"], row["run"], F.lit(seed))
        return F.struct(*[row[x].alias(x) for x in df.columns], predicted.alias("predicted"), sd.alias("SD"), F.coalesce(row["log2Intensity"], draw).alias("replaceNA"))

    return d.select("preyProtein", F.transform("_l", filled).alias("_l"))


def exclude_bait_as_prey(df: DataFrame) -> DataFrame:
    """Flag rows where the prey is the bait, by whichever name columns are present."""
    same = F.lit(False)
    for a, b in (("preyGene", "bait"), ("baitGene", "preyGene"), ("baitProtein", "preyProtein")):
        if a in df.columns and b in df.columns:
            same = same | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return df.withColumn("excludeGlobally", same)


_BACKGROUND = ("n_b", "m_b", "v_b", "median_exc", "mad_exc")


def _without_groups(value: np.ndarray, group: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Count, mean, variance, median and MAD of the known cells of each row that are not of the row's own group."""
    use = ~np.isnan(value) & (group != own[:, None])
    n = use.sum(axis=1)
    middle = _row_medians(value, use)
    apart = np.where(use, value - middle[:, None], 0.0)
    with np.errstate(all="ignore"):
        shift = apart.sum(axis=1) / n
        spread = np.where(use, (apart - shift[:, None]) ** 2, 0.0).sum(axis=1) / (n - 1)
    return [n, middle + shift, np.where(n > 1, spread, np.nan), middle, 1.4826 * _row_medians(np.abs(apart), use)]


_TESTED = ("median_exc", "mad_exc", "t_test_p", "t_log2FC", "t_lowerCI")


def _tests_of_cells(values: pa.Array, filled: pa.Array, groups: pa.Array, baits: pa.Array) -> pa.Array:
    """Per cell of each prey: median and MAD of the prey's filled values outside the cell's exclude group, and Welch's test of its bait's values in the group against them."""
    start, (names, code), (bait_names, bait) = _starts(filled), _codes(groups), _codes(baits)
    prey, cell = np.repeat(np.arange(len(filled)), np.diff(start)), np.diff(start)
    group = prey * (len(names) + 1) + code + 1
    _, first, back = np.unique(group, return_index=True, return_inverse=True)
    flat, known = filled.flatten().to_numpy(zero_copy_only=False), [np.full(len(first), np.nan) for _ in _BACKGROUND]
    of = prey[first]
    for some in _portions(cell[of]):
        width = int(cell[of[some]].max(initial=0))
        real = np.arange(width)[None, :] < cell[of[some]][:, None]
        at = np.where(real, start[of[some]][:, None] + np.arange(width)[None, :], 0)
        found = _without_groups(np.where(real, flat[at], np.nan), code[at], code[first[some]])
        for column, x in zip(known, found, strict=True):
            column[some] = x
    _, cells, own = np.unique(group * (len(bait_names) + 1) + bait + 1, return_index=True, return_inverse=True)
    v = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    there = ~np.isnan(v)
    n_b, m_b, v_b, middle, around = (x[back[cells]] for x in known)
    with np.errstate(all="ignore"):
        n_t = np.bincount(own, there)
        m_t = np.bincount(own, np.where(there, v, 0.0)) / n_t
        v_t = np.where(n_t > 1, np.bincount(own, np.where(there, (v - m_t[own]) ** 2, 0.0)) / (n_t - 1), np.nan)
        # as welch_from_moments: nan stands for what is unknown or divided by zero
        estimate, qa, qb = m_t - m_b, v_t / n_t, v_b / n_b
        error = np.sqrt(qa + qb)
        spread = qa**2 / (n_t - 1) + qb**2 / (n_b - 1)
        df = np.where((n_b > 1) & (spread > 0), (qa + qb) ** 2 / spread, np.nan)
        t = np.where(error > 0, estimate / error, np.nan)
    p, half = np.full(len(df), np.nan), np.full(len(df), np.nan)
    ok = np.flatnonzero(~np.isnan(df))
    half[ok] = dist.t_quantile(1 - (1 - 0.95) / 2, df[ok]) * error[ok]
    ok = ok[~np.isnan(t[ok])]
    p[ok] = 2 * dist.t_upper(np.abs(t[ok]), df[ok])
    found = (x[own] for x in (middle, around, p, estimate, estimate - half))
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.StructArray.from_arrays([pa.array(x, mask=np.isnan(x)) for x in found], list(_TESTED)))


def zmadex(df: DataFrame, value: str = "log2Intensity", filled: str = "replaceNA") -> DataFrame:
    """Robust Z and Welch test of each row against the other exclude groups of its prey.

    A prey's rows (at most one a run) are one record; the background of each of
    its exclude groups is what is left of them without the group's own, computed
    for all preys of a batch at once. Rows are dealt out by prey at most once
    and stay there: no join is needed.
    """
    if "excludeGlobally" not in df.columns:
        df = exclude_bait_as_prey(df)
    return _scored(_records(df), df.columns, value, filled)


def _scored(preys: DataFrame, columns: list[str], value: str = "log2Intensity", filled: str = "replaceNA") -> DataFrame:
    """``zmadex`` of records of preys, whose rows have ``columns``."""
    nan = F.lit(float("nan"))
    usable = F.transform("_l", lambda r: F.coalesce(F.when(~r["excludeGlobally"] & r["excludeGroup"].isNotNull(), r[filled].cast("double")), nan))
    plain = F.transform("_l", lambda r: F.coalesce(r[value].cast("double"), nan))
    kind = f"array<struct<{', '.join(f'{c}: double' for c in _TESTED)}>>"
    tests = F.arrow_udf(_tests_of_cells, kind)(plain, usable, F.col("_l.excludeGroup"), F.col("_l.bait"))
    cells = preys.select("preyProtein", F.explode(F.arrays_zip(F.col("_l").alias("row"), tests.alias("t"))).alias("_c"))
    keys = ["preyProtein", "bait", "excludeGroup"]
    named = F.col("preyProtein").isNotNull() & F.col("_c.row.bait").isNotNull() & F.col("_c.row.excludeGroup").isNotNull()
    own = [F.col(f"_c.row.{c}").alias(c) for c in [*keys[1:], *(c for c in columns if c not in keys)]]
    d = cells.select("preyProtein", *own, *[F.when(named, F.col(f"_c.t.{c}")).alias(c) for c in _TESTED])
    return d.withColumn("Zmadex", ratio(F.col(value) - F.col("median_exc"), F.col("mad_exc")))


def empirical_p(df: DataFrame, control: str = "control") -> DataFrame:
    """Upper-tail p of Zmadex against the control group's values; zeros become half the smallest p."""
    d = cut(df)
    # p of the distinct values, which meet the rows once
    share = cut(ecdf_table(d.where(F.col("excludeGroup") == control).select("Zmadex"), d, [], "Zmadex", "_cdf").select("Zmadex", (1 - F.col("_cdf")).alias("p_Z")))
    least = share.where(F.col("p_Z") > 0).agg(F.min("p_Z").alias("_least"))
    share = attach(share, least).select(F.col("Zmadex").alias("_w"), F.when(F.col("p_Z") == 0, F.col("_least") / 2).otherwise(F.col("p_Z")).alias("p_Z"))
    return d.join(share, F.col("Zmadex") == F.col("_w"), "left").drop("_w")


def compute_zmadex(df: DataFrame, seed: int = 42) -> DataFrame:
    d = df if "excludeGlobally" in df.columns else exclude_bait_as_prey(df)
    columns = [*d.columns, "predicted", "SD", "replaceNA"]
    return empirical_p(_scored(_imputed(d, seed=seed), columns))


# --- specificity ----------------------------------------------------------------

def specificity(counts: DataFrame) -> DataFrame:
    """Share of a prey's counts found with each bait."""
    by = counts.groupBy("prey", "bait").agg(F.sum("spc").alias("_b"))
    total = counts.groupBy("prey").agg(F.sum("spc").alias("_t"))
    return by.join(total, "prey").select("prey", "bait", ratio(F.col("_b"), F.col("_t")).alias("specificity"))


def specificity_permutation(counts: DataFrame, n_perm: int = 1000, seed: int = 1) -> DataFrame:
    """p of each specificity: share of shuffled (permutation, bait) values at least as high.

    ``counts`` is complete (prey x run); every bait has the same number of runs.
    """
    runs = cut(counts.select("run", "bait").distinct())
    reps = runs.groupBy("bait").agg(F.count(F.lit(1)).alias("n")).select("n").distinct().count()
    if reps != 1:
        raise ValueError("baits differ in their number of runs")
    place = cut(dense_index(runs, "run", "idx"))
    size = place.count()
    order = [r["bait"] for r in place.orderBy("idx").select("bait").collect()]
    number = {b: i for i, b in enumerate(dict.fromkeys(order))}
    bait_of, n_bait = np.array([number[b] for b in order], np.int64), len(number.keys() - {None})

    def hits(spots: pa.Array, values: pa.Array, seeds: pa.Array, totals: pa.Array, shares: pa.Array) -> pa.Array:
        at, start, limit = spots.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), _starts(spots), _starts(shares)
        flat, total = values.flatten().to_numpy(zero_copy_only=False).astype(float), totals.to_numpy(zero_copy_only=False).astype(float)
        keys, real = seeds.flatten().to_numpy(zero_copy_only=False).reshape(len(spots), -1), shares.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros(len(real), np.int64)
        for i in range(len(spots)):
            own, share = at[start[i] : start[i + 1]], real[limit[i] : limit[i + 1]]
            moved = bait_of[permuted_sets(own, keys[i], size)] + np.arange(n_perm)[:, None] * len(number)
            drawn = np.bincount(moved.ravel(), np.tile(flat[start[i] : start[i + 1]], n_perm), n_perm * len(number))
            null = np.sort(drawn / total[i])
            out[limit[i] : limit[i + 1]] = len(null) - np.searchsorted(null, share, "left")
        return pa.ListArray.from_arrays(pa.array(limit, pa.int32()), pa.array(out))

    # the runs, which the driver has seen, go to the rows; a prey's baits, cells and totals are gathered in one pass
    spots = F.broadcast(place.groupBy("run").agg(F.collect_list("idx").alias("_at")))
    rows = counts.where(F.col("prey").isNotNull()).join(spots, "run", "left")
    cell = F.when(F.col("spc") != 0, F.transform("_at", lambda i: F.struct(i.alias("idx"), F.col("spc").cast("double").alias("spc"))))
    by = rows.groupBy("prey", "bait").agg(F.sum("spc").alias("_b"), F.sum(F.col("spc").cast("double")).alias("_d"), F.flatten(F.collect_list(cell)).alias("_c"))
    preys = by.groupBy("prey").agg(F.sum("_b").alias("_n"), F.sum("_d").alias("_t"), F.flatten(F.collect_list("_c")).alias("_l"), F.collect_list(F.struct("bait", "_b")).alias("_s"))
    shares = F.transform("_s", lambda x: F.struct(x["bait"].alias("bait"), ratio(x["_b"], F.col("_n")).alias("specificity")))
    preys = spread(preys.withColumn("_s", F.filter(shares, lambda x: x["specificity"].isNotNull())).where(F.size("_s") > 0), "prey")
    # a prey is one record: its permutations are drawn and counted where it lies
    seeds = F.transform(F.sequence(F.lit(1), F.lit(n_perm)), lambda p: F.xxhash64("prey", p, F.lit(seed)))
    n = F.arrow_udf(hits, "array<bigint>")("_l.idx", "_l.spc", seeds, "_t", "_s.specificity")
    rows = preys.select("prey", F.explode(F.arrays_zip(F.col("_s").alias("s"), n.alias("n"))).alias("_x"))
    reached = F.when(F.col("_x.s.specificity") <= 0, n_perm * n_bait).otherwise(F.col("_x.n"))
    return rows.select("prey", F.col("_x.s.bait").alias("bait"), F.col("_x.s.specificity").alias("specificity"), (reached / (n_perm * n_bait)).alias("pvalue"))


# --- spectral count model -------------------------------------------------------

def _ln_gamma(z: Column) -> Column:
    """ln Gamma by Stirling's series after a shift of eight, z > 0."""
    s = z + 8.0
    series = 1 / (12 * s) - 1 / (360 * F.pow(s, F.lit(3.0))) + 1 / (1260 * F.pow(s, F.lit(5.0)))
    shift = z
    for i in range(1, 8):
        shift = shift * (z + float(i))
    return (s - 0.5) * F.ln(s) - s + 0.5 * math.log(2 * math.pi) + series - F.ln(shift)


def log_generalized_poisson(x: Column, mean: Column, omega: Column) -> Column:
    l1 = mean * (1 - omega)
    t = l1 + x * omega
    return F.ln(l1) + (x - 1) * F.ln(t) - t - _ln_gamma(x + 1.0)


def _over_dispersion(mean: Column, var: Column) -> Column:
    return F.greatest(F.when(var > mean, 1 - F.sqrt(mean / var)).otherwise(0.1), F.lit(0.1))


def pseudo_control_stats(counts: DataFrame, control: str, fake: str = "-fake$") -> DataFrame:
    """Background per (run, prey) from ``-fake`` runs, spread from the real controls over a filled grid."""
    real, fakes = counts.where(~F.col("run").rlike(fake)), counts.where(F.col("run").rlike(fake))
    ctl = real.where(F.col("bait").rlike(control))
    runs = ctl.agg(F.countDistinct("run").alias("_n"))
    s = attach(ctl.groupBy("prey").agg(F.sum("spc").alias("_s"), F.sum(F.col("spc") * F.col("spc")).alias("_q")), runs)
    m = F.col("_s") / F.col("_n")
    v = ratio(F.col("_q") - F.col("_n") * m * m, F.col("_n") - 1)
    s = s.select("prey", m.alias("_m"), v.alias("_v")).select("prey", F.greatest(F.when(F.col("_v") > F.col("_m"), 1 - F.sqrt(ratio(F.col("_m"), F.col("_v")))).otherwise(0.1), F.lit(0.1)).alias("omega"))
    # preys never seen in a control have a mean and variance of zero there
    return fakes.select(
        F.regexp_replace("run", fake, "").alias("run"), F.regexp_replace("bait", fake, "").alias("bait"), "prey", F.col("spc").cast("double").alias("mean")
    ).join(s, "prey", "left").withColumn("omega", F.coalesce("omega", F.lit(0.1)))


def saint_spc(
    interactions: DataFrame, baits: DataFrame, preys: DataFrame, pseudo: DataFrame | None = None, fold: float = 5.0,
    beta1: float | None = None, max_rounds: int = 15,
) -> tuple[DataFrame, float]:
    """Probability that each bait-prey count comes from a true interaction.

    Counts are completed over run x prey, compared with control counts of the
    prey (or run-specific pseudo-controls) under generalized Poisson models.
    The prior is re-estimated in closed form from one aggregate per round:
    with A the summed share of true replicates and B the number of pairs,
    ``b = ln(A / (B - A))``. Returns (bait-prey table, beta1); ``treatCounts`` and
    ``controlMean`` hold one value a replicate, packed in run order.
    """
    grid = complete_grid(interactions.groupBy("prey", "run").agg(F.sum("spc").alias("spc")), ["prey"], "run", "spc", 0)
    # a design table goes to the grid, whose rows stay where they lie by prey
    baits = cut(baits.select("run", "bait", "treatment"))
    baits = F.broadcast(baits) if baits.count() <= FEW_NAMES else baits
    d = grid.join(baits, "run").join(preys.select("prey", "preyGene"), "prey", "left")
    d = d.withColumn("spc", F.when(F.col("bait") == F.col("preyGene"), 0).otherwise(F.col("spc")).cast("double"))
    ctl = d.where(F.col("treatment") == "C").groupBy("prey").agg(F.avg("spc").alias("_m"), F.var_samp("spc").alias("_v"))
    ctl = ctl.withColumn("_m", F.greatest("_m", F.lit(0.1))).select("prey", F.col("_m").alias("controlMean"), _over_dispersion(F.col("_m"), F.col("_v")).alias("controlOmega"))
    t = d.where(F.col("treatment") == "T").join(ctl, "prey", "left")
    if pseudo is not None:
        p = pseudo.select("run", "prey", F.col("mean").alias("_pm"), F.col("omega").alias("_po"))
        source = F.when(F.col("_pm").isNotNull(), "pseudoControls").otherwise("experimentalControls")
        t = t.join(p, ["run", "prey"], "left").withColumns({"controlSource": source, "controlMean": F.greatest(F.coalesce("_pm", "controlMean"), F.lit(0.1)), "controlOmega": F.coalesce("_po", "controlOmega")}).drop("_pm", "_po")
    else:
        t = t.withColumn("controlSource", F.lit("experimentalControls"))
    mean, true = F.col("controlMean"), F.col("controlMean") * fold
    t = t.withColumns(
        {
            "foldChange": F.col("spc") / mean,
            "lpTrue": log_generalized_poisson(F.least(F.col("spc"), true), true, F.lit(0.1)),
            "lpFalse": log_generalized_poisson(F.greatest(F.col("spc"), mean), mean, F.col("controlOmega")),
        }
    )
    # the replicates of a bait and prey are one record, so that a round is one sum over records
    columns = ("run", "preyGene", "spc", "controlMean", "controlOmega", "controlSource", "foldChange", "lpTrue", "lpFalse")
    pairs = cut(t.groupBy("bait", "prey").agg(F.collect_list(F.struct(*columns)).alias("_l")))

    def mean_of(f: Callable[[Column], Column], ordered: bool = False) -> Column:
        known = F.filter(F.transform("_l", f), lambda x: x.isNotNull())
        known = F.array_sort(known) if ordered else known
        return ratio(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))

    def totals(z: Callable[[Column], Column]) -> tuple[float, int, float]:
        likely = mean_of(lambda r: F.when(z(r), r["lpTrue"]).otherwise(r["lpFalse"]))
        per = pairs.where(F.array_max("_l.spc") > 0).select(mean_of(lambda r: z(r).cast("double")).alias("_a"), likely.alias("_l"))
        a, b, ll = per.agg(F.sum("_a"), F.count(F.lit(1)), F.sum("_l")).first()
        return a or 0.0, b, ll or 0.0

    if beta1 is None:
        beta1 = 0.0
        a, b, ll = totals(lambda r: r["foldChange"] > 2)
        old = None
        new = a * beta1 - b * math.log1p(math.exp(beta1)) + ll
        for _ in range(max_rounds):
            old = new
            a, b, ll = totals(lambda r: F.lit(beta1) + r["lpTrue"] > r["lpFalse"])
            beta1 = 15.0 if a >= b else (-15.0 if a <= 0 else max(-15.0, min(15.0, math.log(a / (b - a)))))
            new = a * beta1 - b * math.log1p(math.exp(beta1)) + ll
            if new >= old and math.expm1(min(new - old, 700.0)) < 1e-3:
                break
    prior = math.exp(beta1)
    def score(r: Column) -> Column:
        chance = prior / (prior + F.exp(F.least(r["lpFalse"] - r["lpTrue"], F.lit(700.0))))
        return F.when((r["spc"] <= 1) | (r["spc"] < r["controlMean"]), 0.0).otherwise(chance)

    # a record may hold several names of its prey
    named = pairs.select("bait", "prey", "_l", F.explode(F.array_distinct("_l.preyGene")).alias("preyGene"))
    named = named.withColumn("_l", F.filter("_l", lambda r: r["preyGene"].eqNullSafe(F.col("preyGene"))))
    # the runs of a bait are its replicates, so these lists are as long as the design;
    # scores are added in their order, so that equal replicates tie whatever the order of the rows
    by_run = F.array_sort(F.transform("_l", lambda r: F.struct(r["run"].alias("run"), r["spc"].cast("bigint").cast("string").alias("spc"), F.format_string("%.1f", r["controlMean"]).alias("mean"))))
    out = named.select(
        "bait", "prey", "preyGene", mean_of(lambda r: r["spc"]).alias("avgSpec"), by_run.alias("_runs"), mean_of(score, ordered=True).alias("avgScore"), mean_of(lambda r: r["foldChange"]).alias("foldChange"),
        F.array_max("_l.controlOmega").alias("controlOmega"), F.array_join(F.array_sort(F.array_distinct("_l.controlSource")), "|").alias("controlSource"),
    )
    packed = lambda c: F.array_join(F.transform("_runs", lambda r: r[c]), "|")
    out = out.withColumns({"treatCounts": packed("spc"), "controlMean": packed("mean")}).drop("_runs")
    return bfdr(out, "avgScore"), beta1


def bfdr(df: DataFrame, score: str) -> DataFrame:
    """1 - mean of the strictly better scores; 0 for the best."""
    d = cut(df)
    s = d.groupBy(score).agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.col(score) * F.col("c"))
    r = running_totals(s, [], score, sums=["c", "s"], descending=True)
    r = r.select(score, F.when(F.col("c_run") == F.col("c"), 0.0).otherwise(1 - ratio(F.col("s_run") - F.col("s"), F.col("c_run") - F.col("c"))).alias("bfdr"))
    return d.join(r, score, "left")


# --- gold standards -------------------------------------------------------------

def corum_pairs(complexes: DataFrame, members: str = "subunits_gene_name", ordered: bool = True, alias: DataFrame | None = None) -> DataFrame:
    """Member pairs of each complex: every ordered pair and self, or ``gene1 < gene2``."""
    # rows of one complex are brought together, so its pairs are distinct as they come and are never gathered
    c = complexes.select("complex_id", "complex_name", F.split(members, ";").alias("_m")).groupBy("complex_id", "complex_name").agg(F.collect_set("_m").alias("_sets"))
    one = c.select("complex_id", "complex_name", "_sets", F.explode(F.array_distinct(F.flatten("_sets"))).alias("gene1"))
    with_one = F.array_distinct(F.flatten(F.filter("_sets", lambda s: F.array_contains(s, F.col("gene1")))))
    second = with_one if ordered else F.filter(with_one, lambda x: x > F.col("gene1"))
    p = one.select("complex_id", "complex_name", "gene1", F.explode(second).alias("gene2"))
    if alias is None:
        return p
    for side in ("gene1", "gene2"):
        a = alias.select(F.col("alias").alias(side), F.col("symbol").alias("_s"))
        p = p.join(a, side, "left").withColumn(side, F.coalesce("_s", side)).drop("_s")
    return p.distinct()


def _named(links: DataFrame, info: DataFrame | None) -> DataFrame:
    if info is None:
        return links.select(F.col("protein1").alias("gene1"), F.col("protein2").alias("gene2"))
    names = info.select("string_id", "preferred_name")
    a, b = names.select(F.col("string_id").alias("protein1"), F.col("preferred_name").alias("gene1")), names.select(F.col("string_id").alias("protein2"), F.col("preferred_name").alias("gene2"))
    return links.join(a, "protein1").join(b, "protein2").select("gene1", "gene2")


def gold_standard_pairs(
    links: DataFrame, complexes: DataFrame | None, baits: DataFrame | None = None, preys: DataFrame | None = None, genes: DataFrame | None = None,
    info: DataFrame | None = None, threshold: float = 600, simplify: str | None = None,
) -> DataFrame:
    """Known interactions with packed sources, between baits and preys or within a gene set.

    ``simplify`` = ``forest`` keeps one spanning forest, ``matching`` one edge per node.
    """
    s = _named(links.where(F.col("combined_score") > threshold), info)
    if complexes is not None:
        c = corum_pairs(complexes, ordered=baits is not None).select("gene1", "gene2").distinct()
    between = baits is not None
    if not between:
        s = s.select(F.least("gene1", "gene2").alias("gene1"), F.greatest("gene1", "gene2").alias("gene2"))
    d = s.distinct().withColumn("source", F.lit("string"))
    if complexes is not None:
        d = c.withColumn("source", F.lit("corum")).unionByName(d)
    left, right = (baits, preys) if between else (genes, genes)
    d = d.join(left.select(F.col("gene").alias("gene1")).distinct(), "gene1", "left_semi").join(right.select(F.col("gene").alias("gene2")).distinct(), "gene2", "left_semi")
    d = d.where(~F.col("gene1").startswith("KRT") & ~F.col("gene2").startswith("KRT"))
    d = d.groupBy("gene1", "gene2").agg(pack_sorted_distinct("source").alias("source"))
    if simplify is None:
        return d
    d = cut(d)
    edges = d.select(F.col("gene1").alias("src"), F.col("gene2").alias("dst"))
    kept = spanning_forest(edges) if simplify == "forest" else one_edge_per_node(edges, [F.xxhash64("src", "dst")])
    return d.join(kept.select(F.col("src").alias("gene1"), F.col("dst").alias("gene2")), ["gene1", "gene2"], "left_semi")


def decoy_pairs(
    links: DataFrame, baits: DataFrame, preys: DataFrame, info: DataFrame | None = None, threshold: float = 600, min_hops: int = 5, ordered: bool = True
) -> DataFrame:
    """Bait-prey pairs in the network farther than ``min_hops`` apart; unreachable counts as far.

    For each bait the near nodes are one array; far preys are the rest of the
    network's preys (the gene universe, checked to be at most 100,000).
    """
    e = _named(links.where(F.col("combined_score") > threshold), info).where(~F.col("gene1").isNull() & ~F.col("gene2").isNull())
    e = cut(e.select(F.col("gene1").alias("src"), F.col("gene2").alias("dst")).distinct())
    nodes = e.select("src").union(e.select("dst")).distinct().where(~F.col("src").startswith("KRT")).select(F.col("src").alias("node"))
    b = cut(nodes.join(baits.select(F.col("gene").alias("node")).distinct(), "node", "left_semi"))
    p = nodes.join(preys.select(F.col("gene").alias("node")).distinct(), "node", "left_semi")
    near = hop_distances(e, min_hops, b).groupBy("source").agg(F.collect_set("node").alias("_near"))
    every = p.agg(F.collect_set("node").alias("_p")).select(
        F.when(F.size("_p") <= 100_000, F.col("_p")).otherwise(F.raise_error(F.lit("more than 100000 preys in the network")).cast("array<string>")).alias("_p")
    )
    d = attach(near, every).select(F.col("source").alias("gene1"), F.explode(F.array_except("_p", "_near")).alias("gene2"))
    return d if ordered else d.where(F.col("gene1") < F.col("gene2"))


# --- convergence of bait sets ---------------------------------------------------

PROTEOME = 11169  # fixed value: background size of the overlap test


def _with_fisher(pairs: DataFrame, sizes: DataFrame, groups: list[str], background: int, other_sizes: DataFrame | None = None) -> DataFrame:
    """Overlap test of pairs ``a, b, shared``; the tail is computed once per distinct set of counts."""
    a = sizes.select(*groups, F.col("bait").alias("a"), F.col("n").alias("na"))
    b = (sizes if other_sizes is None else other_sizes).select(*groups, F.col("bait").alias("b"), F.col("n").alias("nb"))
    d = cut(pairs.join(a, [*groups, "a"]).join(b, [*groups, "b"]).withColumns({"_lo": F.least("na", "nb"), "_hi": F.greatest("na", "nb")}))
    counts = d.select("shared", "_lo", "_hi").distinct()
    p = dist.hypergeom_log10(F.col("shared").cast("double"), F.col("_lo").cast("double"), F.lit(float(background)), F.col("_hi").cast("double"))
    tails = counts.select("shared", "_lo", "_hi", F.pow(F.lit(10.0), p).alias("fisherP"))
    return d.join(tails, ["shared", "_lo", "_hi"]).select(*groups, F.col("a").alias("bait1"), F.col("b").alias("bait2"), "shared", "fisherP")


def _prey_counts(bait_prey: DataFrame, groups: list[str]) -> DataFrame:
    return bait_prey.groupBy(*groups, "bait").agg(F.countDistinct("prey").alias("n"))


def prey_overlap_fisher(bait_prey: DataFrame, groups: list[str] | None = None, background: int = PROTEOME) -> DataFrame:
    """One-sided overlap test of every bait pair; pairs without overlap have p = 1.

    Shared preys come from an index by prey; the pairs without any are what is
    left of all pairs.
    """
    groups = groups or []
    known = cut(bait_prey.where("bait is not null and prey is not null").select(*groups, "bait", "prey").distinct())
    shared = shared_counts(known, groups, "bait", "prey")
    pairs = level_pairs(known, "bait", groups=groups).join(shared, [*groups, "a", "b"], "left").na.fill(0, ["shared"])
    return _with_fisher(pairs, _prey_counts(known, groups), groups, background)


def prey_overlap_fisher_between(bait_prey1: DataFrame, bait_prey2: DataFrame, background: int = PROTEOME) -> DataFrame:
    """Only pairs across the two sets, which alone are formed; baits in both count for the first."""
    one = cut(bait_prey1.where("bait is not null and prey is not null").select("bait", "prey").distinct())
    two = bait_prey2.where("bait is not null and prey is not null").join(one.select("bait").distinct(), "bait", "left_anti")
    two = cut(two.select("bait", "prey").distinct())
    pairs = meeting(one.select(F.col("bait").alias("a")).distinct(), two.select(F.col("bait").alias("b")).distinct(), "a", "b")
    pairs = pairs.join(shared_counts(one, [], "bait", "prey", two), ["a", "b"], "left").na.fill(0, ["shared"])
    return _with_fisher(pairs, _prey_counts(one, []), [], background, _prey_counts(two, []))


def prey_size_windows(bait_prey: DataFrame, pool: int = 100) -> DataFrame:
    """For each prey count 1..max, the smallest radius whose window holds more than ``pool`` baits.

    Baits up to each count are running totals over the counts; the radius is
    found by halving, all counts at once, with two lookups of totals a round.
    Where no radius is enough it is the largest count.
    """
    spark = bait_prey.sparkSession
    per = cut(bait_prey.groupBy("bait").agg(F.countDistinct("prey").alias("countPrey")).groupBy("countPrey").agg(F.count("*").alias("n")))
    most = per.agg(F.max("countPrey")).first()[0] or 0
    line = spark.range(0, most + 1).select(F.col("id").alias("countPrey")).join(per, "countPrey", "left").na.fill(0, ["n"])
    line = cut(running_totals(line, [], "countPrey", sums=["n"]).select("countPrey", "n", F.col("n_run").alias("upto")))
    upper, lower = line.select(F.col("countPrey").alias("_u"), F.col("upto").alias("_high")), line.select(F.col("countPrey").alias("_l"), F.col("upto").alias("_low"))
    # the radius lies in lo..hi; hi = most means that none is enough
    state = line.where("countPrey > 0").select("countPrey", "n", F.lit(0).cast("bigint").alias("lo"), F.lit(most).cast("bigint").alias("hi"))
    for turn in range(int(most).bit_length()):
        mid = F.expr("(lo + hi) div 2")
        asked = state.withColumns({"_m": mid, "_u": F.least(F.col("countPrey") + mid, F.lit(most)), "_l": F.greatest(F.col("countPrey") - mid, F.lit(1).cast("bigint")) - 1})
        found = asked.join(upper, "_u").join(lower, "_l").withColumn("_enough", F.col("_high") - F.col("_low") > pool)
        state = found.select("countPrey", "n", F.when(F.col("_enough") | (F.col("lo") >= F.col("hi")), F.col("lo")).otherwise(F.col("_m") + 1).alias("lo"), F.when(F.col("_enough"), F.col("_m")).otherwise(F.col("hi")).alias("hi"))
        if turn % 4 == 3:
            state = cut(state)
    return state.select("countPrey", F.col("n").alias("numBaitsWithCP"), F.col("hi").alias("windowSize"))


def size_matched_sample(baits: DataFrame, background: DataFrame, samples: int, seed: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """For each sample and bait an unused background bait of similar prey count.

    ``baits`` has ``bait, countPrey, windowRadius``; ``background`` has ``bait,
    countPrey``. Candidates are numbered by prey count, so a bait's window is a
    run of numbers and its seeded order of candidates a keyed permutation of
    that run: a round holds one row per sample and bait, whatever the number of
    candidates. A candidate keeps its best bidder; the others try their next.
    Baits whose window is used up stay without.
    """
    c = background.select(F.col("bait").alias("cand"), "countPrey").distinct()
    if exclude is not None:
        c = c.join(exclude.select(F.col("bait").alias("cand")).distinct(), "cand", "left_anti")
    numbered = cut(add_order(c, [F.col("countPrey"), F.col("cand")], "idx"))
    most = numbered.agg(F.max("countPrey")).first()[0] or 0
    # how many candidates have at most each count
    per = numbered.groupBy("countPrey").agg(F.count("*").alias("n"))
    line = baits.sparkSession.range(0, most + 1).select(F.col("id").alias("countPrey")).join(per, "countPrey", "left").na.fill(0, ["n"])
    line = cut(running_totals(line, [], "countPrey", sums=["n"]).select("countPrey", F.col("n_run").alias("upto")))
    low = F.least(F.greatest(F.col("countPrey") - F.col("windowRadius"), F.lit(1)), F.lit(most + 1)).cast("bigint") - 1
    high = F.least(F.greatest(F.col("countPrey") + F.col("windowRadius"), F.lit(0)), F.lit(most)).cast("bigint")
    b = baits.select("bait", low.alias("_l"), high.alias("_h")).join(line.select(F.col("countPrey").alias("_l"), F.col("upto").alias("first")), "_l")
    b = b.join(line.select(F.col("countPrey").alias("_h"), F.col("upto").alias("last")), "_h").select("bait", "first", (F.col("last") - F.col("first")).alias("width")).where("width > 0")
    free = b.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("turn", F.lit(0).cast("bigint"))
    taken = None
    while True:
        free = cut(free.where("turn < width"))
        if free.isEmpty():
            break
        place = F.col("first") + 1 + permuted_index(F.col("turn"), F.xxhash64("sample", "bait", F.lit(seed)), F.col("width"))
        bids = free.select("sample", "bait", place.alias("idx"))
        if taken is not None:
            bids = bids.join(taken.select("sample", "idx"), ["sample", "idx"], "left_anti")
        won = bids.groupBy("sample", "idx").agg(F.min(F.struct(F.xxhash64("sample", "bait", "idx", F.lit(seed)).alias("h"), "bait")).alias("y"))
        won = cut(won.select("sample", F.col("y.bait").alias("bait"), "idx"))
        taken = won if taken is None else cut(taken.unionByName(won))
        free = free.join(won.select("sample", "bait"), ["sample", "bait"], "left_anti").withColumn("turn", F.col("turn") + 1)
    if taken is None:
        return c.select(F.lit(0).alias("sample"), F.col("cand").alias("bait"), "cand").limit(0)
    return taken.join(numbered, "idx").select("sample", "bait", "cand")


def convergence_test(bait_prey: DataFrame, background: DataFrame, samples: int = 1000, pool: int = 100, seed: int = 1, proteome: int = PROTEOME) -> DataFrame:
    """Share of bait pairs with p < 0.05: sample 0 is the actual set, 1..n are size-matched draws, all in one job."""
    windows = prey_size_windows(background, pool).select("countPrey", F.col("windowSize").alias("windowRadius"))
    own = bait_prey.groupBy("bait").agg(F.countDistinct("prey").alias("countPrey")).join(windows, "countPrey", "left")
    top = windows.agg(F.max("countPrey").alias("_m"), F.max_by("windowRadius", "countPrey").alias("_r"))
    own = attach(own, top).withColumn("windowRadius", F.coalesce("windowRadius", F.abs(F.col("countPrey") - F.col("_m")) + F.col("_r")))
    bg = background.groupBy("bait").agg(F.countDistinct("prey").alias("countPrey"))
    drawn = size_matched_sample(own, bg, samples, seed)
    sets = drawn.select("sample", F.col("cand").alias("bait")).join(background.select("bait", "prey").distinct(), "bait")
    every = bait_prey.select(F.lit(0).alias("sample"), "bait", "prey").unionByName(sets.select("sample", "bait", "prey"))
    known = cut(every.where("bait is not null and prey is not null").distinct())
    # pairs without overlap have p = 1, so they only count in the number of pairs
    sizes = cut(_prey_counts(known, ["sample"]))
    p = _with_fisher(shared_counts(known, ["sample"], "bait", "prey"), sizes, ["sample"], proteome)
    low = p.groupBy("sample").agg(F.count_if(F.col("fisherP") < 0.05).alias("_low"))
    total = sizes.groupBy("sample").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))
    return total.where("pairs > 0").join(low, "sample", "left").select("sample", (F.coalesce("_low", F.lit(0)) / F.col("pairs")).alias("portion"), "pairs")


def bioplex_pairs(table: DataFrame) -> DataFrame:
    return table.select(F.col("`Bait Symbol`").alias("bait"), F.col("`Prey Symbol`").alias("prey"))
