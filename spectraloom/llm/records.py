"""Token-ID output as length-delimited binary records with a separate offset index.

A record is framed as::

    8 bytes  payload length, little-endian
    4 bytes  masked crc32 of those 8 bytes
    payload  8 bytes document id, 1 byte (1: the id is null), 1 byte (bytes per
             token id: 2, or 4 where an id needs them), the token ids
    4 bytes  masked crc32 of the payload
    1 byte   0x0A

The mask rotates a checksum by 15 bits and adds a constant, so that the
checksum of data that holds checksums stays apart from them. Files are written
by Spark's text sink (bytes pass unchanged), so a retried task leaves one
committed file; part numbers follow document id order. The index is a Parquet
table beside them with one row per record (part, position, offset, length,
doc_id, n_tokens), from which a shuffled reader fetches single records.

Nulls: a null text is an empty one; null ids come first. Rows with the same id
are separate records. An empty table gives no record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import chunks, shuffle_width
from spectraloom.llm.tokens import encoder

MASK_ADD = 0xA282EAD8
HEAD, TAIL = 12, 5
#: text that goes into one file, about; a file is read as one value
FILE_TEXT_BYTES = 16_000_000
ENTRY = "part string, position long, offset long, length long, doc_id long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    payload = struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload)) + b"\n"


def unframe(data: bytes, offset: int) -> tuple[int | None, np.ndarray, int]:
    """Document id, token ids and length of the frame at ``offset``; raises if a checksum fails."""
    head = data[offset : offset + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, offset + 8)[0] != masked(head):
        raise ValueError(f"broken record length at byte {offset}")
    size = struct.unpack("<Q", head)[0]
    payload = data[offset + HEAD : offset + HEAD + size]
    if len(payload) < size or struct.unpack_from("<I", data, offset + HEAD + size)[0] != masked(payload):
        raise ValueError(f"broken record at byte {offset}")
    doc_id, missing, width = struct.unpack_from("<qBB", payload)
    return None if missing else doc_id, np.frombuffer(payload, f"<u{width}", offset=10).astype("<u4"), HEAD + size + TAIL


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encode every whole text, append ``end_id`` and write frames in ascending id order to ``path``/data."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for part in chunks(batches, 1_000_000):
            ids = encoder(vocabulary).encode(part.column("text").to_pylist())
            rows = [frame(d, np.concatenate([x, end])) for d, x in zip(part.column("doc_id").to_pylist(), ids, strict=True)]
            yield pa.record_batch([pa.array(rows, pa.binary())], names=["record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(2 * shuffle_width(docs.sparkSession), -(-size // FILE_TEXT_BYTES))
    # texts are sorted, not frames: dealing out by range reads its input twice, and encoding is the dear part;
    # the digest parts the rows of one id over files
    ordered = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(files, "doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")


def _files(spark: SparkSession, path: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(name.alias("part"), "content")


def _walk(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """The sink ends each frame with its own line feed after the frame's, which is skipped."""
    offset = 0
    while offset < len(content):
        doc_id, ids, size = unframe(content, offset)
        yield offset, size, doc_id, ids
        offset += size + 1


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Write the offset index of the records under ``path`` and return it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                found = [(part, n, o, s, d, len(i)) for n, (o, s, d, i) in enumerate(_walk(content.as_py()))]
                if found:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), [pa.string()] + [pa.int64()] * 5, strict=True)], names=["part", "position", "offset", "length", "doc_id", "n_tokens"])

    _files(spark, path).mapInArrow(scan, ENTRY).write.parquet(f"{path}/index")
    return spark.read.schema(ENTRY).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read frames back through the index: part, position, doc_id, n_tokens, ids (binary)."""
    index = spark.read.schema(ENTRY).parquet(f"{path}/index")
    wanted = index.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("position", "offset"))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content, places in zip(batch.column("part").to_pylist(), batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
                content, rows = content.as_py(), []
                for place in places:
                    doc_id, ids, _ = unframe(content, place["offset"])
                    rows.append((part, place["position"], doc_id, len(ids), ids.tobytes()))
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["part", "position", "doc_id", "n_tokens", "ids"])

    return _files(spark, path).join(wanted, "part").mapInArrow(fetch, "part string, position long, doc_id long, n_tokens long, ids binary")


def record_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, ids_crc32 of the records under ``path``.

    The files are walked frame by frame with every checksum tested; starts come
    from running sums inside a file plus the totals of the files before it (the
    index gives those; one row per file).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                rows, before = [], 0
                for _, _, doc_id, ids in _walk(content.as_py()):
                    rows.append((part, doc_id, before, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string()] + [pa.int64()] * 4, strict=True)], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    index = spark.read.schema(ENTRY).parquet(f"{path}/index")
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    read = _files(spark, path).mapInArrow(digest, "part string, doc_id long, before long, n_tokens long, ids_crc32 long")
    return read.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
