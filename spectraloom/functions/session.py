"""Session helpers: lineage cuts and bounded lists of design levels."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master
    (tests) may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spectraloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def design_levels(df: DataFrame, column: str, limit: int = 20_000) -> list | None:
    """Sorted distinct levels of a design factor (runs, conditions, fractions).

    At most ``limit + 1`` values reach the driver. ``None`` means the factor is
    larger than that and the caller has to stay with a join.
    """
    rows = (
        df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        return None
    return sorted(r[0] for r in rows)


def literal_array(values: list, data_type: str) -> Column:
    if not values:
        return F.expr(f"cast(array() as array<{data_type}>)")
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{data_type}>")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery."""
    names = one_row.columns
    out = df.withColumn("_row", one_row.select(F.struct(*names).alias("_row")).scalar())
    return out.select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key at full width before a grouped Python step.

    The groups are small in bytes but costly to compute, so adaptive coalescing
    would put them all into one task; a set width is left alone, and the
    grouping reuses it without another exchange.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)
