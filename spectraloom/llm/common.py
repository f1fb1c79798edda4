"""Shared helpers of the training-data operators: staged tables, keys, vectorised words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.session import checkpoint_dir, shuffle_width

__all__ = ["Words", "chunks", "checkpoint_dir", "factorize", "free_names", "lines_of", "mix", "new_folder", "row_key", "segments", "shuffle_width", "staged", "text_bytes", "words"]

#: bytes of text that one vectorised step holds at once; a single longer text is its own step
CHUNK_BYTES = 500_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there, columns can be pruned on reading, and a lost
    executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with leading underscores until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16-byte key of a document row: its id and its whole text.

    Rows equal in both are one document given twice and share every decision;
    a null id and a null text have keys of their own.
    """
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), F.col(text)), F.lit("")))))


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


# --- vectorised words over UTF-8 buffers -----------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every segment ``values[start:end]``, from one prefix array."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of bounded text size, that of all ``columns`` together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        total = np.cumsum(size + 64)
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of a slice of texts: ``start``/``end`` bytes, ``doc`` (row), 64-bit ``hash``."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lower: bool):
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw, self.docs = raw, len(bounds) - 1
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(raw)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = bounds[1:][bounds[1:] > 0] - 1
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        self.hash = segments(raw, self.start, self.end)
        self.bounds = np.searchsorted(self.doc, np.arange(self.docs + 1))


def words(column: pa.Array, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space, with their hashes."""
    raw, bounds = text_bytes(column)
    return Words(raw, bounds, lower)


def factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distinct values, by hashing."""
    import pandas as pd

    codes, distinct = pd.factorize(values)
    return codes.astype(np.int64), np.asarray(distinct)
