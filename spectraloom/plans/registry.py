"""Query registry: name -> callable, SQL, inventory rows covered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Registered:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    module: str


REGISTRY: dict[str, Registered] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``ids`` lists inventory rows."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Registered(name, tuple(ids.split()), lambda spark, sf: fn(Tables(spark, sf)), sql, fn.__module__.rsplit('.', 1)[-1])
        return fn

    return wrap


class Tables:
    """Lazy access to the driver tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
