"""Phrase collocations from count streams joined in lockstep in prefix and in suffix order.

Per language (null: ``und``) the texts, A-Z lower-cased, are split into pieces
at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A stream
holds the phrases of one length with their counts. The stream of m words meets
the stream of m - 1 words twice, each time as a sort-merge join on sorted keys:

* in prefix order on the first m - 1 words, which brings the counts of every
  beginning (the left counts);
* in suffix order on the last m - 1 words, which brings the counts of every
  ending (the right counts).

The same two orders, read the other way, give a phrase its extensions: the
largest count of a stream-m phrase that begins or ends with it. No phrase table
is hashed or held in memory by a join, and a skewed key is a run of sorted rows
that adaptive execution may split.

Counting. A phrase that occurs ``least`` times has only parts that do, so the
stream of m words is counted from places whose two parts of m - 1 words are
frequent. A bit filter of the frequent parts thins the places before the
shuffle. It never rejects a frequent part, so it saves work and changes no
count; its size follows the number of parts up to ``FILTER_BITS`` (32 MB), and
a fuller filter only lets more places pass. Slices of text are counted before
they leave the task, and Spark adds up again before the shuffle, so a word or a
language that makes up a third of all rows costs one row a task.

Scores are whole numbers: floor(10^6 a^2 / (l r)) over decimals of 38 digits,
exact to counts of 10^16. The lowest-scoring cut counts, ties to the first.

Null and empty texts have no words. Repeated rows count each time. Ties in the
ranking go by count, then by the bytes of the phrase. Other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import chunks, factorize, mix, segments, staged, text_bytes

LEAST, TOP, LONGEST, COVER_PERCENT = 10, 2000, 3, 50
SCALE = 1_000_000
#: largest size of the filter of frequent parts, in bits
FILTER_BITS = 1 << 28
#: bytes of text counted at once before rows leave the task
SLICE_BYTES = 1_000_000
#: a ranking is cut down within this many parts of a language first, then within fewer
RANK_PARTS = (4096, 64, 1)

_BREAK, _SPACE = 2, 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[np.frombuffer(b" \t", np.uint8)] = _SPACE
_CLASS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _hashes(words: pa.Array) -> np.ndarray:
    raw, bounds = text_bytes(words)
    return segments(raw, bounds[:-1], bounds[1:])


def _join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase, from the hashes of its language and its words."""
    with np.errstate(over="ignore"):
        h = parts[0]
        for p in parts[1:]:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p)
    return h


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]


class _Filter:
    """Bits of the frequent phrases of one length."""

    def __init__(self, words: np.ndarray, size: int):
        self.words, self.size = words, size

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in _bits(h, self.size):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _filter(stream: DataFrame, length: int) -> _Filter:
    """The filter of a stream; at most ``FILTER_BITS / 64`` numbers reach the driver."""
    size = min(FILTER_BITS, 1 << max(12, int(16 * stream.count()).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, bounds = text_bytes(b.column("phrase"))
            gaps = np.flatnonzero(raw == 32)
            # words of a phrase are parted by single spaces: length - 1 of them each
            inner = gaps.reshape(b.num_rows, length - 1)
            starts, ends = np.column_stack([bounds[:-1], inner + 1]), np.column_stack([inner, bounds[1:]])
            h = _join_hashes([_hashes(b.column("lang")), *[segments(raw, starts[:, i], ends[:, i]) for i in range(length)]])
            at = np.concatenate(_bits(h, size))
            yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    got = stream.select("lang", "phrase").mapInArrow(place, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[got["slot"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return _Filter(words, size)


class _Slice:
    """Words of a slice: codes into its distinct words, language, and whether the next word goes on."""

    def __init__(self, part: pa.RecordBatch):
        raw, bounds = text_bytes(part.column("text"))
        raw = np.insert(raw, bounds[1:], 10)
        bounds = bounds + np.arange(len(bounds))
        kind = _CLASS[raw]
        inside = kind == 0
        edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        coded = _strings(_LOWER[raw[inside]], np.cumsum(end - start)).dictionary_encode()
        self.code, self.words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        piece = np.cumsum(kind == _BREAK)[start]
        self.goes_on = np.append(piece[1:] == piece[:-1], False)[: len(start)]
        langs = part.column("lang").cast(pa.large_string()).fill_null("und").dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.searchsorted(bounds, start, "right") - 1]

    def frequent(self, filters: list[_Filter]) -> list[np.ndarray]:
        """Per length, the first places of phrases that may be frequent."""
        lang, word = _hashes(self.langs), _hashes(self.words)
        h, found = _join_hashes([lang[self.lang], word[self.code]]), []
        places = np.arange(len(self.code))
        for m, f in enumerate(filters, 1):
            if m > 1:
                places = self.longer(places, m - 1)
                h = _join_hashes([lang[self.lang[places]], *[word[self.code[places + i]] for i in range(m)]])
            places = places[f.may_hold(h)]
            found.append(places)
        return found

    def longer(self, places: np.ndarray, m: int) -> np.ndarray:
        """Of the first places of phrases of m words, those that have another such phrase one word on."""
        has = np.zeros(len(self.code) + 1, bool)
        has[places] = True
        return places[self.goes_on[places] & has[places + 1]]


def _count(docs: DataFrame, filters: list[_Filter]) -> DataFrame:
    """lang, phrase, a: counts of the phrases one word longer than the last filter's."""
    m = len(filters) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SLICE_BYTES):
            s = _Slice(part)
            places = np.arange(len(s.code))
            if filters:
                places = s.longer(s.frequent(filters)[-1], m - 1)
            key = s.lang[places]
            for i in range(m):
                # distinct keys are numbered again before the next word, so they stay below 2^63
                key, _ = factorize(key * len(s.words) + s.code[places + i])
            if not len(places):
                continue
            counts = np.bincount(key)
            first = np.empty(len(counts), np.int64)
            first[key[::-1]] = places[::-1]
            phrase = s.words.take(pa.array(s.code[first]))
            if m > 1:
                phrase = pc.binary_join_element_wise(phrase, *[s.words.take(pa.array(s.code[first + i])) for i in range(1, m)], pa.scalar(" ", pa.large_string()))
            lang = s.langs.take(pa.array(s.lang[first]))
            yield from pa.Table.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(counts)], names=["lang", "phrase", "a"]).to_batches(max_chunksize=50_000)

    return docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _joined(stream: DataFrame, shorter: DataFrame, m: int) -> DataFrame:
    """A stream of m words with the counts of its beginnings and endings, from the stream of m - 1."""
    begins = F.substring_index("phrase", " ", m - 1).alias("head")
    ends = F.substring_index("phrase", " ", 1 - m).alias("tail")
    before = shorter.select("lang", F.col("phrase").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
    after = shorter.select("lang", F.col("phrase").alias("tail"), F.concat("tails", F.array("a")).alias("tails"))
    return stream.select("*", begins, ends).join(before.hint("merge"), ["lang", "head"]).join(after.hint("merge"), ["lang", "tail"]).select("lang", "phrase", "a", "heads", "tails", "head", "tail")


def _score(cut: int, m: int) -> Column:
    """floor(SCALE a a / (l r)) of the cut after ``cut`` words; 38 digits hold the products."""
    whole, left, right = (c.cast("decimal(20,0)") for c in (F.col("a"), F.col("heads")[cut - 1], F.col("tails")[m - cut - 1]))
    return F.call_function("div", whole * whole * F.lit(SCALE).cast("decimal(7,0)"), left * right)


def streams(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language (lang, n), and per length the frequent phrases with the counts of their parts."""
    none = F.array().cast("array<long>")
    counted = staged(_count(docs, []), "words")
    out = [staged(counted.where(F.col("a") >= least).select("*", none.alias("heads"), none.alias("tails")), "stream1")]
    filters: list[_Filter] = []
    for m in range(2, longest + 1):
        filters.append(_filter(out[-1], m - 1))
        frequent = _count(docs, filters).where(F.col("a") >= least)
        out.append(staged(_joined(frequent, out[-1], m), f"stream{m}"))
    return counted.groupBy("lang").agg(F.sum("a").alias("n")), out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover_percent: int = COVER_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words."""
    totals, found = streams(docs, least, longest)
    kept = []
    for m in range(2, longest + 1):
        phrases = found[m - 1]
        cuts = F.array(*[F.struct(_score(k, m).alias("score"), F.lit(k).alias("cut"), F.col("heads")[k - 1].alias("l"), F.col("tails")[m - k - 1].alias("r")) for k in range(1, m)])
        scored = phrases.select("lang", "phrase", "a", F.array_min(cuts).alias("best"))
        if m < longest:
            longer = found[m].select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
            scored = scored.join(longer.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover_percent * F.col("a"), F.lit(True)))
        kept.append(scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score"))
    ranked = kept[0]
    for k in kept[1:]:
        ranked = ranked.unionByName(k)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for parts in RANK_PARTS:
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part")
        best = Window.partitionBy("lang", "part").orderBy(*order)
        ranked = ranked.select("lang", "phrase", "a", "l", "r", "score", part).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
