"""Document fingerprints from prefix polynomial hashes.

For every text two prefix arrays are kept, modulo 2^64 and modulo 2^31 - 1 (the
second guards against the strings that fool a power of two). The hash of any span is a difference of two prefixes times an
inverse power, so equality of spans costs O(1) and the longest common extension
of two places a binary search. A fingerprint lists the text's length, its whole
hash and the 64 smallest mixed hashes of all spans of 16 code points; likeness
of two fingerprints is the Jaccard similarity estimated from those (exact while
both texts have at most 64 different spans).

Rows meet their successor in id order through range buckets: the first row of a
bucket also travels to the bucket before it. Ties in doc_id follow the text's
digest, null ids come last, and the row after the last is the first. Null text
is empty text; two empty texts have likeness 1, an empty and another text 0. A
text shorter than 16 is one span. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import mix, powers, shuffle_width

PRIME, BASE = (1 << 31) - 1, 998_244_353
SPAN, KEPT = 16, 64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix_edited long, same_prefix_next long"


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime, without a division."""
    p, shift = np.uint64(PRIME), np.uint64(31)
    x = (x & p) + (x >> shift)
    x = (x & p) + (x >> shift)
    return np.where(x >= p, x - p, x)


@lru_cache(maxsize=32)
def _table(base: int, size: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime."""
    out = np.ones(size, np.uint64)
    done, step = 1, base
    while done < size:
        n = min(done, size - done)
        out[done : done + n] = reduced(out[:n] * np.uint64(step))
        done, step = done + n, step * step % PRIME
    return out


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = n = len(points)
        size = 1 << max(16, (n + 1).bit_length())
        up, self.down = powers(size - 1)
        with np.errstate(over="ignore"):
            self.wide = np.zeros(n + 1, np.uint64)
            np.cumsum(points * up[:n], out=self.wide[1:])
        self.small_down = _table(pow(BASE, -1, PRIME), size)
        x = points * _table(BASE, size)[:n]
        s = np.zeros(n + 1, np.uint64)
        np.cumsum((x & np.uint64(PRIME)) + (x >> np.uint64(31)), out=s[1:])
        self.small = reduced(s)

    def windows(self, width: int) -> np.ndarray:
        """Hashes modulo 2^64 of all spans of ``width``, or of the whole text if it is shorter."""
        width = min(width, self.n)
        m = self.n - width + 1 if self.n else 0
        with np.errstate(over="ignore"):
            return (self.wide[width : width + m] - self.wide[:m]) * self.down[:m]

    def span(self, start: int, end: int) -> int:
        """95-bit hash of the span ``[start, end)``, the same wherever the span stands."""
        wide = (self.wide.item(end) - self.wide.item(start)) * self.down.item(start) & 0xFFFFFFFFFFFFFFFF
        return wide << 31 | (self.small.item(end) - self.small.item(start)) * self.small_down.item(start) % PRIME

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(other_start, other_start + length)

    def common_extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """Length of the longest common extension from two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, other_start, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """The smallest mixed span hashes (48 bits), ascending."""
        h = mix(self.windows(SPAN)) >> np.uint64(16)
        if len(h) > 4 * KEPT:
            near = np.partition(h, 4 * KEPT - 1)[: 4 * KEPT]
            near.sort()
            few = near[np.concatenate([[True], near[1:] != near[:-1]])]
            if len(few) >= KEPT:
                return few[:KEPT]
        return np.unique(h)[:KEPT]

    def fingerprint(self) -> str:
        return f"{self.n}:{self.span(0, self.n):024x}:" + self.sketch().astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Similarity, 0 to 1, of two fingerprints."""
    if a == b:
        return 1.0
    one, two = ([x[i : i + 12] for i in range(x.rindex(":") + 1, len(x), 12)] for x in (a, b))
    least = sorted({*one, *two})[:KEPT]
    return len({*one}.intersection(two, least)) / len(least) if least else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_successors(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.md5("text")).withColumn("_at", F.col("doc_id").cast("double"))
    n = max(2, 2 * shuffle_width(spark))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("_at")).approxQuantile("_at", [i / n for i in range(1, n)], 0.25 / n)))
    splits = [float("-inf"), *(bounds or [0.0]), float("inf")]
    d = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep").transform(d).withColumn("bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(len(splits)))).drop("_at", "_bucket")
    # one row per bucket
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    first = sorted(d.groupBy("bucket").agg(F.min(order).alias("first")).collect(), key=lambda r: r["bucket"])
    targets = [(first[i - 1]["bucket"], r["first"]["doc_id"], r["first"]["digest"]) for i, r in enumerate(first)]
    tails = F.broadcast(spark.createDataFrame(targets, "target int, _id long, _digest string"))
    tail = d.join(tails, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    every = d.select("bucket", F.lit(0).alias("tail"), "doc_id", "digest", "text").unionByName(tail.select(F.col("target").alias("bucket"), F.lit(1).alias("tail"), "doc_id", "digest", "text"))
    every = every.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "digest")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for bucket, is_tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True):
                here = PrefixHash(text)
                now = (bucket, is_tail, doc_id, text, here, here.fingerprint())
                if last is not None and last[0] == bucket and not last[1]:
                    rows.append(_row(last, now))
                last = now
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return every.select("bucket", "tail", "doc_id", "text").mapInArrow(pair, RESULT)


def _row(row: tuple, after: tuple) -> tuple:
    doc_id, text, own, mark = row[2:]
    following_text, following, following_mark = after[3:]
    new_text = edited(text, following_text)
    new = PrefixHash(new_text)
    new_mark = new.fingerprint()
    return (
        doc_id, own.n, hashlib.sha256(new_text.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark,
        likeness(mark, new_mark), likeness(mark, following_mark), own.common_extension(0, new, 0), own.common_extension(0, following, 0),
    )
