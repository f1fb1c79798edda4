"""Column-level building blocks shared by all operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.session import attach

INF = float("inf")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, with every missing name, when a required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}; have: {', '.join(df.columns)}")
    return df


def as_col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# --- missing and infinite values -------------------------------------------------

def is_finite(c: str | Column) -> Column:
    """True for numbers; false for null, NaN and both infinities."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def is_infinite(c: str | Column) -> Column:
    return F.coalesce(F.abs(as_col(c)) == F.lit(INF), F.lit(False)) & ~F.isnan(as_col(c))


def nan_to_null(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(F.isnan(c), None).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """Division that gives null instead of an error at zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log2_pos(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.log2(c))


def log10_pos(c: str | Column) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.log10(c))


def round_to(c: str | Column, digits: int = 6) -> Column:
    return F.round(as_col(c), digits)


# --- names ----------------------------------------------------------------------

def resolve_alias(df: DataFrame, pattern: str, new_name: str) -> DataFrame:
    """Rename the single column that matches ``pattern`` to ``new_name``."""
    hits = [c for c in df.columns if re.fullmatch(pattern, c)]
    if len(hits) != 1:
        raise ValueError(f"expected one column matching {pattern!r}, found {hits}")
    return df.withColumnRenamed(hits[0], new_name)


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


# --- packed strings -------------------------------------------------------------

def unpack(c: str | Column, sep: str = ";") -> Column:
    """Packed string to array; the separator is literal."""
    return F.split(as_col(c), re.escape(sep))


def pack_sorted_distinct(c: str | Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_set(as_col(c))), sep)


def pack_ordered(value: str | Column, *order: str | Column, sep: str = ";") -> Column:
    """Packed string in an explicit order (collected lists have none)."""
    fields = [as_col(o).alias(f"o{i}") for i, o in enumerate(order)] + [as_col(value).alias("v")]
    rows = F.array_sort(F.collect_list(F.when(as_col(value).isNotNull(), F.struct(*fields))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), sep)


# --- strings --------------------------------------------------------------------

def count_literal(c: str | Column, token: str) -> Column:
    c = as_col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))) / len(token)).cast("int")


def locate_all(c: str | Column, token: str) -> Column:
    """1-based positions of every non-overlapping occurrence of a literal."""
    parts = F.split(as_col(c), re.escape(token), -1)
    starts = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1),
        F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("at")),
        lambda acc, part: F.struct(
            (acc["end"] + F.length(part) + len(token)).alias("end"),
            F.concat(acc["at"], F.array(acc["end"] + F.length(part) + 1)).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return starts


def chained_replace(c: str | Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Apply literal replacements one after another."""
    c = as_col(c)
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def base_name(c: str | Column) -> Column:
    return F.substring_index(as_col(c), "/", -1)


def capitalize_first(c: str | Column) -> Column:
    c = as_col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


# --- row selection --------------------------------------------------------------

def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, chosen by an explicit order.

    ``min_by`` over a struct keeps this a partial + final aggregate: a hot key
    is reduced on the map side and never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[as_col(c) for c in rest]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r")
    )
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def first_match_lookup(
    df: DataFrame, on: list[str], table: DataFrame, table_on: list[str], order: list[Column], values: list[str]
) -> DataFrame:
    """Keep every row of ``df`` and attach the first matching lookup row."""
    lookup = first_row(table.select(*dict.fromkeys([*table_on, *values, *_order_names(table, order)])), table_on, order)
    lookup = lookup.select(*[F.col(t).alias(f"_k{i}") for i, t in enumerate(table_on)], *values)
    cond = [as_col(o) == F.col(f"_k{i}") for i, o in enumerate(on)]
    joined = df.join(lookup, on=_all(cond), how="left")
    return joined.drop(*[f"_k{i}" for i in range(len(table_on))])


def _order_names(table: DataFrame, order: list[Column]) -> list[str]:
    return list(table.columns)


def _all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def update_join(df: DataFrame, table: DataFrame, on: list[str], column: str, order: list[Column]) -> DataFrame:
    """Overwrite ``column`` where the table has a match; the last match wins."""
    last = first_row(table.select(*table.columns), on, [o for o in order]).select(*on, F.col(column).alias("_new"))
    base = df if column in df.columns else df.withColumn(column, F.lit(None))
    return (
        base.join(last, on, "left")
        .withColumn(column, F.coalesce(F.col("_new"), F.col(column)))
        .drop("_new")
        .select(*base.columns)
    )


def group_scalar(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregate-then-join: the aggregate combines on the map side and the join of
    a hot group is split by adaptive skew handling, whereas a window would sort
    the whole group in one task.
    """
    stats = df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])
    return df.join(stats, keys, "left") if keys else attach(df, stats)


ColumnMap = Callable[[Column], Column]
