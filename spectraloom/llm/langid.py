"""Language spans: script ranges narrow the candidates, Viterbi over words labels the text.

A word is a run of letters (and the marks on them) of one script. Its score
under a language is the log probability of its letters, each seen with its two
neighbours (word edges count as neighbours), with additive smoothing. A language
is a candidate for a word if at least ``SCRIPT_SHARE`` of the language's letters
were of the word's script; if no language is, all are. Viterbi finds the best
sequence of languages over the words of a text, where every change costs
``SWITCH``: a foreign word or two stay in their span, a foreign sentence becomes
a span of its own. The language with most letters in its spans is the text's
(ties: the first by name); the score is its share of the letters.

Fitting takes about ``PER_LANGUAGE`` whole documents a language, drawn by a hash
of id and text. The model is one table of ``FEATURES`` numbers a language (128
KB), so what reaches the driver and the tasks is bounded by the number of
languages and not by the rows. Scores and spans cover every document and every
whole text. Viterbi walks all texts of a slice in step, so its cost follows the
words of the slice and the length of its longest text.

Null text, empty text and text without a letter get ``und``, score 0 and no
span; so does every text if nothing was learned. Rows with a null language or
text teach nothing. Repeated rows are scored each. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import chunks, factorize, mix, segments, shuffle_width, staged

#: labelled documents a language from which the model is fitted, about
PER_LANGUAGE = 5_000
BROADCAST_LANGUAGES = 100_000
FEATURES = 1 << 15
SMOOTHING = 0.1
SCRIPT_SHARE = 0.01
SWITCH = 10.0
UNKNOWN = "und"
#: bytes of text in a slice, divided by a quarter of the number of languages
SLICE_BYTES = 8_000_000

#: fixed values: code point ranges of scripts, after the Unicode block names
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0xFF66, 0xFF9F)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
#: script of letters in no range, and of marks that belong to the letter before them
OTHER, INHERITED = len(SCRIPTS), len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is part of a word, its script, its lower case."""
    every = range(0x110000)
    letter = np.array([unicodedata.category(chr(c))[0] in "LM" for c in every])
    lower = np.arange(0x110000, dtype=np.uint32)
    cased = [c for c in every if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c)]
    lower[cased] = [ord(chr(c).lower()) for c in cased]
    script = np.full(0x110000, OTHER, np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = i
    script[[c for c in every if script[c] == OTHER and unicodedata.category(chr(c))[0] == "M"]] = INHERITED
    return letter, script, lower


class Runs:
    """Words of a list of texts: start, end (places in all texts joined), script, text number, distinct number."""

    def __init__(self, texts: list[str | None]):
        letter, script, lower = _code_points()
        size = np.array([len(t or "") + 1 for t in texts], np.int64)
        points = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le"), "<u4")
        inside, kind = letter[points], script[points]
        own = kind != INHERITED
        if not own.all():
            kind = kind[np.maximum.accumulate(np.where(own, np.arange(len(points)), 0))]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (kind[1:] != kind[:-1])
        self.start = np.flatnonzero(first)
        after = np.append(inside[1:] & ~first[1:], False)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.points, self.script = lower[points], np.minimum(kind[self.start], OTHER)
        self.begins = np.cumsum(size) - size
        self.text = np.searchsorted(self.begins, self.start, "right") - 1
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.length = self.end - self.start
        code, _ = factorize(mix(segments(self.points, self.start, self.end)))
        self.code = code
        self.example = np.empty(code.max() + 1 if len(code) else 0, np.int64)
        self.example[code[::-1]] = np.arange(len(code))[::-1]

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the letters of some words, and where each word's begin."""
        length = self.length[words]
        begin = np.cumsum(length) - length
        at = np.repeat(self.start[words] - begin, length) + np.arange(length.sum())
        here = self.points[at].astype(np.uint64)
        before, behind = self.points[at - 1].astype(np.uint64), self.points[np.minimum(at + 1, len(self.points) - 1)].astype(np.uint64)
        before[begin] = 0
        behind[begin + length - 1] = 0
        with np.errstate(over="ignore"):
            h = mix((before << np.uint64(42)) ^ (here << np.uint64(21)) ^ behind)
        return (h & np.uint64(FEATURES - 1)).astype(np.int64), begin


@dataclass
class LanguageModel:
    """Log probabilities (language, feature) and which languages are candidates for a script."""

    langs: list[str]
    log_p: np.ndarray
    candidate: np.ndarray

    def emission(self, runs: Runs) -> np.ndarray:
        """Score of every word under every language; languages that are no candidates are out of reach."""
        example = runs.example
        feature, begin = runs.features(example)
        of_word = np.empty((len(example), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            of_word[:, i] = np.add.reduceat(self.log_p[i][feature], begin) if len(example) else 0
        of_word[~self.candidate[runs.script[example]]] -= 1e6
        return of_word[runs.code]


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that do not teach: crc32 of the id as text leaves 2 modulo 4. A null id teaches."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Model of the languages of labelled documents (columns doc_id, text, lang)."""
    labelled = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    # one row a language: sent to the texts, which do not move, unless there are absurdly many
    sizes = staged(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(sizes, "lang").where(place * F.col("rows") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in chunks(batches):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                r = Runs([t for t, own in zip(texts, langs, strict=True) if own == lang])
                seen = total.setdefault(lang, np.zeros(FEATURES + OTHER + 1, np.int64))
                if len(r.start):
                    feature, _ = r.features(np.arange(len(r.start)))
                    seen += np.bincount(feature, minlength=len(seen)) + np.bincount(FEATURES + r.script.astype(np.int64), r.length, len(seen)).astype(np.int64)
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["lang", "feature", "n"])

    spread = sample.repartition(shuffle_width(docs.sparkSession))
    got = spread.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    coded = got["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    counts = np.zeros((len(langs), FEATURES + OTHER + 1))
    number = np.array([langs.index(x) for x in names], np.int64)
    if langs:
        counts[number[coded.indices.to_numpy()], got["feature"].to_numpy()] = got["n"].to_numpy()
    letters, scripts = counts[:, :FEATURES] + SMOOTHING, counts[:, FEATURES:]
    candidate = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    candidate[~candidate.any(axis=1)] = True
    return LanguageModel(langs, np.log(letters / letters.sum(axis=1, keepdims=True)).astype(np.float32), candidate)


def best_path(emission: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word, for all texts in step; text i has the words ``bounds[i]:bounds[i+1]``."""
    words, states = emission.shape
    path = np.zeros(words, np.int64)
    count = np.diff(bounds)
    order = np.argsort(-count, kind="stable")
    count, first = count[order], bounds[:-1][order]
    if not words:
        return path
    active = np.searchsorted(-count, -np.arange(count[0]), "left")
    came = np.empty((words, states), np.int16)
    own = np.arange(states, dtype=np.int16)
    total = emission[first[: active[0]]].astype(np.float64)
    for t in range(1, count[0]):
        k = active[t]
        at, now = first[:k] + t, total[:k]
        best = now.argmax(axis=1)
        jump = now[np.arange(k), best] - switch
        stays = now >= jump[:, None]
        came[at] = np.where(stays, own, best[:, None])
        total[:k] = np.where(stays, now, jump[:, None]) + emission[at]
    state = total.argmax(axis=1)
    for t in range(count[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        path[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return path


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def _labelled(part: pa.RecordBatch, model: LanguageModel, switch: float) -> pa.RecordBatch:
    texts, n, most = part.column("text").to_pylist(), part.num_rows, len(model.langs)
    label, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
    runs = Runs(texts)
    if most and len(runs.start):
        path = best_path(model.emission(runs), runs.bounds, switch)
        letters = np.bincount(runs.text * most + path, runs.length, n * most).reshape(n, most)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        for i in np.flatnonzero(total):
            label[i] = model.langs[best[i]]
        score = letters[np.arange(n), best] / np.maximum(1, total)
        begin = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (runs.text[1:] != runs.text[:-1])]))
        last = np.append(begin[1:], len(path)) - 1
        base = runs.begins[runs.text[begin]]
        for i, start, end, state in zip(runs.text[begin].tolist(), (runs.start[begin] - base).tolist(), (runs.end[last] - base).tolist(), path[begin].tolist(), strict=True):
            spans[i].append({"start": start, "end": end, "lang": model.langs[state]})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    columns = [part.column("doc_id"), part.column("held_out"), pa.array(label, pa.string()), pa.array(score), pa.array(spans, kind)]
    return pa.record_batch(columns, names=["doc_id", "held_out", "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (code points, end exclusive) of every row."""
    most = max(250_000, SLICE_BYTES * 4 // max(4, len(model.langs)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, most):
            yield _labelled(part, model, switch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(label, RESULT)
