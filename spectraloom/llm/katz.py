"""Katz backoff scores: Good-Turing discounted n-gram counts of any order (trigrams by default).

    P_m(w | h) = d(c(h, w)) c(h, w) / c(h)     if h, w was seen
               = alpha(h) P_(m-1)(w | h')      otherwise, h' without its first word
    P_1(w)     = d(c(w)) c(w) / N, and one unknown type gets what the discounts free

alpha(h) makes every row sum to one exactly. Discounts follow Good-Turing counts
up to 5 where they are sound, else an absolute discount, for every order by
itself; a history without any discounted count gets one more in its denominator.
The start of a document is a history of its own at every order; the second token
has a history of one word after the start, and so on.

Texts become blocks of at most about ``BLOCK_TOKENS`` tokens (a longer text is a
block alone) with a local vocabulary, written once, bucketed by block. Order by
order, a block sends its distinct n-grams (number of the history, number of the
word, training count, probability at the order below) to buckets; a bucket adds
up the counts, sums per history, and answers each block, which evaluates the
order from the answers and goes on to the next. A n-gram travels once per block
however often it occurs, and those of a frequent history are spread over all
buckets, so nothing grows with the frequency of one key. The number of buckets
follows the number of tokens (``BUCKET_GRAMS`` n-grams each), so what a task
holds does not grow with the corpus. Besides a few counts of counts, only the
sums of those frequent histories (at most ``4 x buckets`` an order) are gathered.

Null text is empty text: one end token. A document is held out when crc32 of
its id as text leaves 2 modulo 7; a null id is not. Rows with the same id are
separate documents. Without training tokens every word is the unknown type.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import chunks, factorize, mix, new_folder, shuffle_width, staged, words

ORDER = 3
CUT = 5
#: tokens of a block, and n-grams that a bucket gets from all blocks, about
BLOCK_TOKENS = 1_000_000
BUCKET_GRAMS = 1_000_000
#: bytes of text turned into tokens at once
SLICE_BYTES = 500_000
END = np.uint64(0x0E4D0E4D0E4D0E4D)
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Discount ratios for counts 1..CUT, from the numbers of types that occur 1..CUT+1 times."""
    n = np.asarray(counts_of_counts, float)
    r = np.arange(1, CUT + 1)
    if (n > 0).all():
        last = (CUT + 1) * n[CUT] / n[0]
        if last < 1:
            d = ((r + 1) * n[1:] / (r * n[:-1]) - last) / (1 - last)
            if ((d > 0) & (d < 1)).all():
                return d
    share = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 else 0.5
    return (r - share) / r


def discounted(count: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    c = np.asarray(count, np.int64)
    return np.where(c <= CUT, np.concatenate([[0.0], ratio])[np.minimum(c, CUT)], 1.0) * c


class Unigrams:
    """The lower order: totals and probabilities."""

    def __init__(self, total: int, types: int, counts_of_counts: np.ndarray):
        self.total, self.types = total, types
        self.ratio = discounts(counts_of_counts)
        free = float((np.arange(1, CUT + 1) * np.asarray(counts_of_counts, float)[:CUT] * (1 - self.ratio)).sum())
        self.extra = 0 if free > 1e-9 or not total else 1
        self.unknown = (free if free > 1e-9 else 1.0) / (total + self.extra) if total else 1.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.ratio) / max(1, self.total + self.extra), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.types + 1.0))


BLOCK = "block string, tokens long, doc_id array<long>, held array<boolean>, length binary, vocabulary binary, ids binary"


def _blocks(docs: DataFrame, name: str) -> DataFrame:
    """The blocks as a table bucketed by block, so that joins with answers do not move them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, hashes, size, number = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            codes, vocabulary = factorize(np.concatenate(hashes))
            # frequent words get small ids
            order = np.argsort(-np.bincount(codes), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            columns = [
                pa.array([f"{TaskContext.get().partitionId()}-{number}"]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[held_out(d) for d in ids]], pa.list_(pa.bool_())),
                *(pa.array([x], pa.binary()) for x in (squeeze(np.array(lengths, np.int64)), vocabulary[order].astype(np.uint64).tobytes(), squeeze(rank[codes]))),
            ]
            return pa.record_batch(columns, names=[c.split()[0] for c in BLOCK.split(", ")])

        for part in chunks(batches, SLICE_BYTES):
            w = words(part.column("text"), lower=True)
            count = np.diff(w.bounds) + 1
            if ids and size + int(count.sum()) > BLOCK_TOKENS:
                yield flush()
                ids, lengths, hashes, size, number = [], [], [], 0, number + 1
            hashes.append(np.insert(w.hash, w.bounds[1:], END))
            lengths += count.tolist()
            ids += part.column("doc_id").to_pylist()
            size += int(count.sum())
        if ids:
            yield flush()

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, BLOCK)
    spark = docs.sparkSession
    made.write.format("parquet").option("path", new_folder(spark, name)).bucketBy(shuffle_width(spark), "block").saveAsTable(name)
    return spark.table(name)


class Block:
    """One block in a task: tokens, which of them train, and the n-grams of the order reached."""

    def __init__(self, row: dict, buckets: int):
        self.block, self.doc_id, self.buckets = row["block"], row["doc_id"], buckets
        self.length = unsqueeze(row["length"], "<i8")
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.ids = unsqueeze(row["ids"], "<u4").astype(np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.train = np.repeat(~np.array(row["held"], bool), self.length)
        # order 1: n-gram numbers of tokens, and what the words' buckets know of them
        self.gram = self.ids
        self.bucket = (self.vocabulary % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        self._bound()

    def _bound(self) -> None:
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.bucket, minlength=self.buckets))])

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """Buckets that this block has n-grams of, with the n-grams in bucket order."""
        for k in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield k, self.order[self.bounds[k] : self.bounds[k + 1]]

    def trained(self) -> np.ndarray:
        return np.bincount(self.gram[self.train], minlength=len(self.bucket))

    def hear(self, answers: list[dict]) -> None:
        """Counts and numbers of the n-grams from their buckets' answers."""
        self.count, self.number = np.zeros(len(self.bucket), np.int64), np.zeros(len(self.bucket), np.uint64)
        for a in answers:
            at = self.order[self.bounds[a["bucket"]] : self.bounds[a["bucket"] + 1]]
            self.count[at] = unsqueeze(a["counts"], "<u4")
            if a["numbers"] is not None:
                self.number[at] = unsqueeze(a["numbers"], "<u8")

    def words_heard(self, answers: list[dict], unigrams: Unigrams) -> None:
        self.hear(answers)
        self.word_count, self.word_number = self.count, self.number
        self.p = unigrams.probability(self.count)
        end = np.flatnonzero(self.vocabulary == END)
        # the start of a document is as frequent as its end
        self.documents = int(self.count[end[0]]) if len(end) else 0

    def longer(self, hot: float) -> None:
        """Go on to n-grams one word longer: the n-gram before a token is its history."""
        histories, size = len(self.count), len(self.vocabulary)
        before = np.empty(len(self.ids), np.int64)
        before[1:] = self.gram[:-1]
        before[self.begin] = histories
        lower = self.gram
        self.gram, code = factorize(before * size + self.ids)
        self.first, self.second = code // size, code % size
        self.lower = np.empty(len(code), np.int64)
        self.lower[self.gram] = lower
        self.low = self.p[self.lower]
        # a word's probability follows from its count, which packs better
        self.low_sent = self.count[self.lower].astype("<u4") if self.word_count is self.count else self.low
        self.history_number = np.append(self.number + np.uint64(1), np.uint64(0))
        self.history_count = np.append(self.count, self.documents)
        one, two = self.history_number[self.first], self.word_number[self.second]
        self.hot = self.history_count > hot
        self.hot[histories] = True
        key = mix(np.where(self.hot[self.first], one * np.uint64(0x9E3779B97F4A7C15) + two, one))
        self.bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        self.order = np.lexsort((self.second, self.first, self.bucket))
        self._bound()

    def runs(self, at: np.ndarray) -> np.ndarray:
        """Where the histories of n-grams in bucket order begin."""
        first = self.first[at]
        return np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))

    def evaluate(self, answers: list[dict], ratio: np.ndarray, frequent: dict[int, list]) -> None:
        """Probabilities of this order's n-grams, from the answers and the order below."""
        self.hear(answers)
        n = len(self.history_count)
        per, mass = np.zeros((n, CUT)), np.zeros(n)
        for a in answers:
            at = self.order[self.bounds[a["bucket"]] : self.bounds[a["bucket"] + 1]]
            names = self.first[at][self.runs(at)]
            per[names] = unsqueeze(a["per"], "<u4").reshape(-1, CUT)
            mass[names] = unsqueeze(a["mass"], "<f8")
        for k in np.flatnonzero(self.hot):
            if (known := frequent.get(int(self.history_number[k]))) is not None:
                per[k], mass[k] = known
        free = per @ (np.arange(1, CUT + 1) * (1 - ratio))
        plus = (free <= 1e-9) & (self.history_count > 0)
        below = self.history_count + plus
        left = np.where(plus, 1.0, free) / np.maximum(below, 1)
        alpha = np.where(self.history_count > 0, left / np.maximum(1 - mass, 1e-300), 1.0)
        self.p = np.where(self.count > 0, discounted(self.count, ratio) / np.maximum(below[self.first], 1), alpha[self.first] * self.low)


def _replay(row: dict, buckets: int, unigrams: Unigrams, levels: list[tuple[np.ndarray, dict[int, list]]], hot: float) -> Block:
    """A block with all orders evaluated that have been answered."""
    b = Block(row, buckets)
    b.words_heard(row["answers1"], unigrams)
    for m, (ratio, frequent) in enumerate(levels, 2):
        b.longer(hot)
        b.evaluate(row[f"answers{m}"], ratio, frequent)
    return b


ANSWER = "block string, bucket int, counts binary, numbers binary, per binary, mass binary, facts array<long>, history long"
_ANSWER = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("numbers", pa.binary()), ("per", pa.binary()), ("mass", pa.binary()), ("facts", pa.list_(pa.int64())), ("history", pa.int64())])


def _answers(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ANSWER)


def _blobs(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [unsqueeze(x, kind) for x in table.column(name).to_pylist()]


def _facts_of(total: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[1 : CUT + 2].tolist()


def _sum_words(buckets: int):
    def add(table: pa.Table) -> pa.Table:
        bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        parts = _blobs(table, "words", "<u8")
        codes, distinct = factorize(np.concatenate(parts))
        total = np.bincount(codes, np.concatenate(_blobs(table, "trained", "<u4"))).astype(np.int64)
        number = np.arange(len(distinct), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        out, at = [{"facts": [int(total.sum()), int((total > 0).sum()), *_facts_of(total)]}], 0
        for block, part in zip(blocks, parts, strict=True):
            own = codes[at : at + len(part)]
            at += len(part)
            out.append({"block": block, "bucket": bucket, "counts": squeeze(total[own].astype("<u4")), "numbers": squeeze(number[own])})
        return _answers(out)

    return add


def _facts(answers: DataFrame) -> list[int]:
    """Sums of the buckets' facts, place by place (a handful of numbers)."""
    rows = answers.where("block is null and facts is not null").select(F.posexplode("facts").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def _sum_grams(buckets: int, unigrams: Unigrams | None, numbered: bool):
    def add(table: pa.Table) -> pa.Table:
        bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
        firsts, sizes, seconds = _blobs(table, "firsts", "<u8"), _blobs(table, "sizes", "<u4"), _blobs(table, "seconds", "<u8")
        history, names = factorize(np.concatenate([np.repeat(f, n) for f, n in zip(firsts, sizes, strict=True)]))
        word, _ = factorize(np.concatenate(seconds))
        codes, _ = factorize(history * (int(word.max()) + 1) + word)
        total = np.bincount(codes, np.concatenate(_blobs(table, "trained", "<u4"))).astype(np.int64)
        place = np.empty(len(total), np.int64)
        place[codes[::-1]] = np.arange(len(codes))[::-1]
        # per history: how many of its n-grams occur 1..CUT times, and the mass below of those seen
        of, seen = history[place], total > 0
        per = np.stack([np.bincount(of[total == r], minlength=len(names)) for r in range(1, CUT + 1)], axis=1)
        low = np.concatenate(_blobs(table, "lows", "<u4" if unigrams else "<f8"))[place][seen]
        mass = np.bincount(of[seen], unigrams.probability(low) if unigrams else low, len(names))
        number = np.arange(len(total), dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        out, at = [{"facts": _facts_of(total)}], 0
        often: set[int] = set()
        for block, first, size, spread in zip(blocks, firsts, sizes, _blobs(table, "spread", "<u1"), strict=True):
            count = int(size.sum())
            own, mine = codes[at : at + count], history[at + np.cumsum(size) - size]
            at += count
            often.update(mine[spread > 0].tolist())
            out.append({"block": block, "bucket": bucket, "counts": squeeze(total[own].astype("<u4")), "numbers": squeeze(number[own]) if numbered else None, "per": squeeze(per[mine].astype("<u4")), "mass": squeeze(mass[mine])})
        out += [{"history": int(names[k]), "per": squeeze(per[k].astype("<u4")), "mass": squeeze(mass[k : k + 1])} for k in often]
        return _answers(out)

    return add


def score(docs: DataFrame, order: int = ORDER, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    The scores are written; the table of blocks is dropped again.
    """
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    try:
        return staged(_scores(_blocks(docs, name), order, bucket_grams), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scores(blocks: DataFrame, order: int, bucket_grams: int) -> DataFrame:
    spark = blocks.sparkSession
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-tokens // bucket_grams))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, buckets)
            trained = b.trained().astype("<u4")
            some = list(b.slices())
            yield pa.record_batch([
                pa.array([k for k, _ in some], pa.int32()), pa.array([b.block] * len(some)), pa.array([squeeze(b.vocabulary[at]) for _, at in some], pa.binary()), pa.array([squeeze(trained[at]) for _, at in some], pa.binary()),
            ], names=["bucket", "block", "words", "trained"])

    sent = blocks.mapInArrow(send_words, "bucket int, block string, words binary, trained binary")
    answers = staged(_by_bucket(sent, buckets).applyInArrow(_sum_words(buckets), ANSWER), "order1")
    facts = _facts(answers) or [0] * (CUT + 3)
    unigrams = Unigrams(facts[0], facts[1], np.array(facts[2:]))
    hot = unigrams.total / (4 * buckets)
    levels: list[tuple[np.ndarray, dict[int, list]]] = []
    known = _heard(blocks, answers, 1)
    for m in range(2, order + 1):
        done = list(levels)

        def send_grams(batches: Iterator[pa.RecordBatch], done=done) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                b = _replay(row, buckets, unigrams, done, hot)
                b.longer(hot)
                trained, out = b.trained().astype("<u4"), []
                for k, at in b.slices():
                    runs = b.runs(at)
                    first = b.first[at][runs]
                    out.append([
                        k, squeeze(b.history_number[first]), squeeze(np.diff(np.append(runs, len(at))).astype("<u4")), squeeze(b.hot[first].astype("<u1")),
                        squeeze(b.word_number[b.second[at]]), squeeze(b.low_sent[at]), squeeze(trained[at]),
                    ])
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array([b.block] * len(out)), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "block", "firsts", "sizes", "spread", "seconds", "lows", "trained"])

        sent = known.mapInArrow(send_grams, "bucket int, block string, firsts binary, sizes binary, spread binary, seconds binary, lows binary, trained binary")
        answers = staged(_by_bucket(sent, buckets).applyInArrow(_sum_grams(buckets, unigrams if m == 2 else None, m < order), ANSWER), f"order{m}")
        ratio = discounts(np.array(_facts(answers) or [0] * (CUT + 1)))
        # histories more frequent than a quarter of a bucket's share, and the start of a document: at most 4 x buckets + 1
        frequent: dict[int, list] = {}
        for r in answers.where("history is not null").select("history", "per", "mass").toLocalIterator():
            per, mass = unsqueeze(r["per"], "<u4").astype(np.int64), float(unsqueeze(r["mass"], "<f8")[0])
            old = frequent.get(r["history"])
            frequent[r["history"]] = [per, mass] if old is None else [old[0] + per, old[1] + mass]
        levels.append((ratio, frequent))
        known = _heard(known, answers, m)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _scored(_replay(row, buckets, unigrams, levels, hot), unigrams)

    return known.mapInArrow(evaluate, SCORE)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch of blocks is not turned into Python objects at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_bucket(sent: DataFrame, buckets: int):
    """Groups of buckets spread evenly: adaptive coalescing would go by compressed bytes."""
    return sent.repartition(buckets, "bucket").groupBy("bucket")


def _heard(blocks: DataFrame, answers: DataFrame, m: int) -> DataFrame:
    """Blocks with the answers of order m; blocks lie in buckets already, answers come to them."""
    fields = ["bucket", "counts", "numbers", *(["per", "mass"] if m > 1 else [])]
    told = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(f"answers{m}"))
    return blocks.join(told.hint("merge"), "block")


def _scored(b: Block, unigrams: Unigrams) -> pa.RecordBatch:
    docs = len(b.length)
    doc = np.repeat(np.arange(docs), b.length)
    count = b.word_count[b.ids]
    known, base, value = (np.bincount(doc, x, docs) for x in (count > 0, unigrams.base(count), np.log10(b.p)[b.gram]))
    return pa.record_batch([
        pa.array(b.doc_id, pa.int64()), pa.array((~b.train[b.begin]).tolist(), pa.bool_()), pa.array(b.length), pa.array(known.astype(np.int64)), pa.array([unigrams.total] * docs, pa.int64()), pa.array(base), pa.array(value),
    ], names=[c.split()[0] for c in SCORE.split(", ")])
