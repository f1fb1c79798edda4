"""Non-negative factorization over many ranks and starts in one job, with divergence loss.

Every (rank, start) is a factorization of its own with coefficients of rank x
columns, a design-sized object. Rows stay where they are, one dense array each,
and are read once a round for all factorizations still moving: a task solves its
rows against each set of coefficients and adds up what the coefficients' update
needs; Spark adds the tasks' sums, one row per factorization comes back. No row
state is kept between rounds, so a lost task is just run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.session import cut, design_levels, shuffle_width

#: multiplicative steps that solve rows against given coefficients
INNER = 20
#: rows solved together
ROWS = 2_000
TINY = 1e-12


def _solve_rows(x: np.ndarray, h: np.ndarray, steps: int = INNER) -> np.ndarray:
    """Row weights with least divergence of ``x`` from ``w h``, by multiplicative steps from an even start."""
    weight = np.maximum(h.sum(axis=1), TINY)
    w = np.repeat(x.sum(axis=1, keepdims=True) / (len(h) * weight.mean()), len(h), axis=1)
    for _ in range(steps):
        w *= (x / np.maximum(w @ h, TINY)) @ h.T / weight
    return w


def divergence(x: np.ndarray, fit: np.ndarray) -> float:
    """Generalized Kullback-Leibler divergence."""
    fit = np.maximum(fit, TINY)
    return float(np.where(x > 0, x * np.log(np.maximum(x, TINY) / fit), 0.0).sum() - x.sum() + fit.sum())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def factorization_scan(
    df: DataFrame, row: str, column: str, value: str, ranks: list[int] | None = None, starts: int = 24, rounds: int = 60, seed: int = 1, tolerance: float = 1e-4
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fits ``rank, start, divergence, rounds, best``; basis and coefficients of each rank's best start).

    ``ranks`` are 1 to 20 unless given, none over the number of columns. Values
    must not be negative; a missing cell is zero, several values of a
    cell add up, null rows, columns and values are left out. A factorization
    stops when a round lowers its divergence by less than ``tolerance`` of it.
    Basis: ``rank, row, factor, w``; coefficients: ``rank, factor, col, h``.
    """
    spark = df.sparkSession
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col(value).isNotNull())
    levels = design_levels(cells, column)
    if levels is None:
        raise ValueError(f"{column} is not a design factor")
    width = len(levels)
    ranks = ranks if ranks is not None else list(range(1, min(20, width) + 1))
    dtype = cells.schema[column].dataType
    numbers = spark.createDataFrame(list(enumerate(levels)), T.StructType([T.StructField("_i", T.IntegerType()), T.StructField("_name", dtype)]))
    added = cells.join(numbers, F.col(column) == F.col("_name")).groupBy(F.col(row).alias("row"), "_i").agg(F.sum(F.col(value).cast("double")).alias("_x"))
    sparse = added.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_x"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    rows = cut(sparse.select("row", dense.alias("x")).repartition(shuffle_width(spark)))

    rng = np.random.default_rng(seed)
    mean = float(rows.agg(F.avg(F.aggregate("x", F.lit(0.0), lambda a, b: a + b))).first()[0] or 0.0) / max(1, width)
    coefficients = {(k, s): rng.random((k, width)) * mean + TINY for k in ranks for s in range(starts)}
    last = dict.fromkeys(coefficients, np.inf)
    used = dict.fromkeys(coefficients, 0)
    active = list(coefficients) if width else []
    for turn in range(rounds):
        now = {key: coefficients[key] for key in active}

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = {key: [np.zeros_like(h), np.zeros(len(h)), 0.0] for key, h in now.items()}
            for batch in batches:
                x = _matrix(batch.column("x"), width)
                for start in range(0, len(x), ROWS):
                    part = x[start : start + ROWS]
                    for key, h in now.items():
                        w = _solve_rows(part, h)
                        fit = np.maximum(w @ h, TINY)
                        t = total[key]
                        t[0] += w.T @ (part / fit)
                        t[1] += w.sum(axis=0)
                        t[2] += divergence(part, fit)
            keys = list(now)
            packed = [np.concatenate([total[k][0].ravel(), total[k][1], [total[k][2]]]) for k in keys]
            yield pa.record_batch([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array(packed, pa.list_(pa.float64()))], names=["rank", "start", "sums"])

        def add(table: pa.Table) -> pa.Table:
            whole = np.sum([np.asarray(v) for v in table.column("sums").to_pylist()], axis=0)
            return pa.table([table.column("rank").slice(0, 1), table.column("start").slice(0, 1), pa.array([whole], pa.list_(pa.float64()))], names=["rank", "start", "sums"])

        schema = "rank int, start int, sums array<double>"
        for r in rows.select("x").mapInArrow(sums, schema).groupBy("rank", "start").applyInArrow(add, schema).toLocalIterator():
            key, got = (r["rank"], r["start"]), np.array(r["sums"])
            k = key[0]
            used[key] = turn + 1
            settled = last[key] - got[-1] <= tolerance * max(abs(last[key]), TINY) and np.isfinite(last[key])
            last[key] = got[-1]
            if settled:
                active.remove(key)
            else:
                coefficients[key] = np.maximum(coefficients[key] * got[: k * width].reshape(k, width) / np.maximum(got[k * width : -1, None], TINY), TINY)
        if not active:
            break

    best = {k: min(range(starts), key=lambda s, k=k: (last[(k, s)], s)) for k in ranks} if starts else {}
    fits = [(k, s, float(last[(k, s)]), used[(k, s)], best[k] == s) for k, s in coefficients]
    chosen = {k: coefficients[(k, s)] for k, s in best.items()}

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            for k, h in chosen.items():
                w = _solve_rows(x, h, 10 * INNER)
                names = batch.column("row").take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.record_batch([pa.array(np.full(w.size, k, np.int32)), names, pa.array(np.tile(np.arange(k, dtype=np.int32), len(x))), pa.array(w.ravel())], names=["rank", "row", "factor", "w"])

    kind = df.schema[row].dataType.simpleString()
    basis = rows.mapInArrow(solve, f"rank int, row {kind}, factor int, w double")
    entries = [(k, i, lv, float(h[i, j])) for k, h in chosen.items() for i in range(k) for j, lv in enumerate(levels)]
    fields = [T.StructField("rank", T.IntegerType()), T.StructField("factor", T.IntegerType()), T.StructField("col", dtype), T.StructField("h", T.DoubleType())]
    return (
        spark.createDataFrame(fits, "rank int, start int, divergence double, rounds int, best boolean"), basis, spark.createDataFrame(entries, T.StructType(fields)),
    )
