"""Packing documents into fixed windows by non-negative least squares over length combinations.

A document's ids are cut at the window; full windows stand alone and a rest
shorter than the window stays. The rests are known by their length histogram
(at most ``window - 1`` numbers). Shallow combinations of two or three lengths
that fill a window exactly are enumerated, repeat counts are solved against the
histogram by non-negative least squares and rounded down, and the n-th rest of a
length gets its place from those counts alone. What rounding leaves over is laid
end to end and cut at the window; the last, partial window is cut into powers of
two, which need no padding.

Only the histogram and one number per input partition are gathered; no task
sees more than its own rows. Null text is empty text (one end id); rows with
the same id are packed separately; an empty table gives no piece. Other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import chunks, staged
from spectraloom.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
REST = "part int, place long, doc_id long, doc_tokens long, full_before long, full_crc array<long>, rest int, rest_ids binary"


def narrow(ids: np.ndarray) -> bytes:
    """Two bytes per id where they all fit, else four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def widened(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * size else "<u4").astype("<u4")


def combinations(histogram: np.ndarray, window: int, common: int = 80) -> list[tuple[int, ...]]:
    """Pairs and triples of lengths that fill ``window``; triples take two of the ``common`` most frequent lengths."""
    have = np.flatnonzero(histogram)
    found = [(int(a), window - int(a)) for a in have if a <= window - a and histogram[window - a]]
    top = sorted(have[np.argsort(-histogram[have], kind="stable")][:common].tolist())
    triples = {tuple(sorted((a, b, window - a - b))) for i, a in enumerate(top) for b in top[i:] if window - a - b > 0 and histogram[window - a - b]}
    return found + sorted(triples)


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 80) -> np.ndarray:
    """Repeat counts: non-negative least squares by coordinate descent, rounded down and made feasible."""
    left = histogram.astype(float)
    x = np.zeros(len(combos))
    uses = [{a: c.count(a) for a in c} for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, use in enumerate(uses):
            step = sum(n * left[a] for a, n in use.items()) / sum(n * n for n in use.values())
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, n in use.items():
                    left[a] -= n * step
        if moved < 0.25:
            break
    free, counts = histogram.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    wanted = np.floor(x + 1e-9).astype(np.int64)
    # rounded counts first, then what is still free, most repeated first
    for most in (wanted, np.full(len(combos), np.iinfo(np.int64).max)):
        for j in np.argsort(-x, kind="stable"):
            n = min(int(most[j]), *(int(free[a]) // m for a, m in uses[j].items()))
            if n > 0:
                counts[j] += n
                for a, m in uses[j].items():
                    free[a] -= n * m
    return counts


class Plan:
    """Where the n-th rest of each length goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        combos = combinations(histogram, window)
        counts = solve(histogram, combos)
        slots: dict[int, list[tuple[int, int, int]]] = {}
        self.filled = 0
        for combo, count in zip(combos, counts.tolist(), strict=True):
            if count:
                offset = 0
                for a in combo:
                    slots.setdefault(a, []).append((count, self.filled, offset))
                    offset += a
                self.filled += count
        self.bound = {a: np.cumsum([s[0] for s in v]) for a, v in slots.items()}
        self.slots = slots
        taken = np.zeros(len(histogram), np.int64)
        for a, b in self.bound.items():
            taken[a] = b[-1]
        self.taken = taken
        lengths = np.arange(len(histogram)) * (histogram - taken)
        self.base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.stream = int(lengths.sum())
        whole, tail = divmod(self.stream, window)
        #: ends of the sequences in the stream of leftovers: windows, then the powers of two of the rest
        powers = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        self.tail_ends = whole * window + np.cumsum(powers, dtype=np.int64)
        self.whole = whole
        self.sequences = self.filled + whole + len(powers)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of the ``rank``-th rest of ``length``."""
        if rank < self.taken[length]:
            k = int(np.searchsorted(self.bound[length], rank, "right"))
            count, first, offset = self.slots[length][k]
            return [(0, length, first + rank - (int(self.bound[length][k]) - count), offset)]
        at = int(self.base[length] + (rank - self.taken[length]) * length)
        out, done = [], 0
        while done < length:
            now = at + done
            if now < self.whole * self.window:
                n, offset = divmod(now, self.window)
                end = (n + 1) * self.window
            else:
                k = int(np.searchsorted(self.tail_ends, now, "right"))
                n, end = self.whole + k, int(self.tail_ends[k])
                offset = now - (int(self.tail_ends[k - 1]) if k else self.whole * self.window)
            size = min(length - done, end - now)
            out.append((done, size, self.filled + n, offset))
            done += size
        return out


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece; every id of every document lies in exactly one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, full_before, end = TaskContext.get().partitionId(), 0, 0, np.array([end_id], np.uint32)
        for batch in chunks(batches, 1_000_000):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode(batch.column("text").to_pylist()), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                full = len(ids) // window
                crc = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(full)]
                rest = ids[full * window :]
                rows.append((part, place, doc_id, len(ids), full_before, crc, len(rest), narrow(rest)))
                place, full_before = place + 1, full_before + full
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "place", "doc_id", "doc_tokens", "full_before", "full_crc", "rest", "rest_ids"])

    rests = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, REST), "rests")
    counts = staged(rests.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n")), "rest-counts")
    histogram = np.zeros(window, np.int64)
    for row in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[row["rest"]] = row["n"]
    plan = Plan(histogram, window)

    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    # one row per input partition
    full = rests.groupBy("part").agg(F.max(F.col("full_before") + F.size("full_crc")).alias("full"))
    full = full.select("part", F.coalesce(F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_ahead"))
    within = F.row_number().over(Window.partitionBy("part", "rest").orderBy("place")) - 1
    placed = rests.join(ranked, ["part", "rest"]).withColumn("rank", F.col("rank_before") + within).join(F.broadcast(full), "part")
    placed = placed.select("doc_id", "doc_tokens", (F.col("full_ahead") + F.col("full_before")).alias("full_at"), "full_crc", "rest", "rest_ids", "rank")

    def place_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for i, crc in enumerate(r["full_crc"]):
                    rows.append((r["doc_id"], i * window, window, crc, r["doc_tokens"], plan.sequences + r["full_at"] + i, 0))
                at, ids = len(r["full_crc"]) * window, widened(r["rest_ids"], r["rest"])
                for start, size, sequence, offset in plan.pieces(r["rest"], r["rank"]) if r["rest"] else ():
                    rows.append((r["doc_id"], at + start, size, zlib.crc32(ids[start : start + size].tobytes()), r["doc_tokens"], sequence, offset))
            if rows:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])

    return placed.mapInArrow(place_pieces, PIECE)
