"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark items are the terms; their document frequencies are
counted over the whole corpus. A randomised SVD of TF-IDF passages (subspace
iteration whose products are summed over all passages of all documents, with the
items themselves at equal total weight) gives a latent space. Windows of at most ``SPREAD`` times an item's length slide over every
whole document, with as many widths as the item lengths need; prefix sums of
term vectors make each window's latent vector one difference. Windows whose
cosine with an item reaches the item's limit are candidates: ``COSINE``, or less
where the item itself, shifted, edited and set among words that spread like the
corpus, does not reach it. So are places that share a run of ``RUN`` words with an item,
whatever their cosine. A candidate counts if the longest common subsequence
covers ``LCS_SHARE`` of the item's words, and at least half of the answer's
words occur: the item's ``answer`` where the benchmark has that column, else its
rarest words.

Items go to the tasks in blocks of ``BLOCK``, so a large benchmark takes more
passes, not more memory. Inside a block every ``SHARED`` items of about one
length have a space of their own, so that the rank suffices for any number of
items. A block codes the texts once, as numbers of its items' words; every turn
of its spaces reads these numbers.

Null text is empty text and matches nothing; items without words match nothing;
items with a null id are kept under the null id. Words are lower-cased (A-Z) and
compared whole. Rows with the same id are separate documents. Other columns are
ignored. Without items, or without documents, the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from spectraloom.llm.common import Words, chunks, factorize, segments, staged, words

RANK, OVERSAMPLE, TURNS = 64, 16, 2
PASSAGE, BLOCK, SHARED = 64, 4_000, 200
#: passages multiplied at once, terms whose sums are added up together
ROWS, STRIPE = 128, 256
#: words of a shared run; trials and shares of kept words for an item's limit
RUN, TRIALS, KEPT = 8, 48, (1.0, 0.8)
STRIDES, SPREAD, COSINE, LCS_SHARE = 4, 1.25, 0.7, 0.6
ANSWER_WORDS = 6
#: least idf, as a share of that of a word in no document
FLOOR = 0.2
#: bytes of text whose prefix sums are held at once
SLICE = 400_000
MATCH = "doc_id long, item_id long, cosine double, lcs double, place long"


@dataclass
class Space:
    """Terms, their latent vectors and the items that share them."""

    terms: np.ndarray
    item_ids: list
    item_words: list[np.ndarray]
    answers: list[set]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    queries: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    masks: list[dict] = field(default_factory=list)
    #: least cosine of a candidate, per item
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: per run length: sorted hashes of the runs, their items and places
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: per class of lengths: which terms are answer words of its items, and the least number of them in a confirmed window
    signs: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.terms, hashes)


def _find(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return at, terms[at] == hashes


def _items(rows: list[Row]) -> Space:
    w = words(pa.array([r["text"] for r in rows], pa.string()), lower=True)
    lists = [w.hash[w.bounds[i] : w.bounds[i + 1]] for i in range(len(rows))]
    given = words(pa.array([r["answer"] for r in rows], pa.string()), lower=True)
    answers = [set(given.hash[given.bounds[i] : given.bounds[i + 1]].tolist()) for i in range(len(rows))]
    keep = [i for i, x in enumerate(lists) if len(x)]
    lists = [lists[i] for i in keep]
    masks = []
    for x in lists:
        m: dict[int, int] = {}
        for j, h in enumerate(x.tolist()):
            m[h] = m.get(h, 0) | 1 << j
        masks.append(m)
    terms = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    return Space(terms, [rows[i]["item_id"] for i in keep], lists, [answers[i] for i in keep], masks=masks, runs=_runs(lists))


def _runs(lists: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for size in {min(RUN, len(x)) for x in lists}:
        some = [i for i, x in enumerate(lists) if min(RUN, len(x)) == size]
        item = np.concatenate([np.full(len(lists[i]) - size + 1, i) for i in some])
        at = np.concatenate([np.arange(len(lists[i]) - size + 1) for i in some])
        hashes = np.concatenate([segments(lists[i], np.arange(len(lists[i]) - size + 1), np.arange(size, len(lists[i]) + 1)) for i in some])
        order = np.argsort(hashes, kind="stable")
        out[size] = hashes[order], item[order], at[order]
    return out


def _coded(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Every document as its number of words, the known words of each of its passages, and these words as numbers of ``terms``.

    A text is cut into passages of ``PASSAGE`` words, the last one shorter; all are kept.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = words(part.column("text"), lower=True)
            at, known = _find(terms, w.hash)
            size = np.diff(w.bounds)
            pieces = -(-size // PASSAGE)
            last = np.concatenate([[0], np.cumsum(pieces)])
            piece = last[w.doc] + (np.arange(len(w.hash)) - w.bounds[w.doc]) // PASSAGE
            held = np.concatenate([[0], np.cumsum(np.bincount(w.doc[known], minlength=w.docs))])
            columns = [
                pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(last, pa.int32()), pa.array(np.bincount(piece[known], minlength=last[-1]), pa.int32())),
                pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(at[known], pa.int32())),
            ]
            yield pa.record_batch(columns, names=["words", "pieces", "terms"])

    return staged(docs.select("text").mapInArrow(code, "words long, pieces array<int>, terms array<int>"), "passages")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _document_frequencies(coded: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Documents, and documents per term, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for part in batches:
            held, term = _flat(part.column("terms"))
            _, pair = factorize(np.repeat(np.arange(part.num_rows), held) * size + term)
            total += np.bincount(pair % size, minlength=size)
            rows += part.num_rows
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], rows), pa.int64())], names=["term", "n"])

    df, n = np.zeros(size), 0
    for r in coded.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        if r["term"] < 0:
            n = r["n"]
        else:
            df[r["term"]] = r["n"]
    return n, df


def _counted(row: np.ndarray, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) with their counts; rows stay in order."""
    codes, pair = factorize(row * size + term)
    return pair // size, pair % size, np.bincount(codes, minlength=len(pair))


def _weighted(row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of unit TF-IDF rows, and the rows' lengths before."""
    value = count * idf[term]
    norm = np.sqrt(np.bincount(row, value**2, rows))
    return value / np.maximum(norm[row], 1e-12), norm


def _blocks(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, basis: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, terms, dense matrix and its product with ``basis`` of every ``ROWS`` sparse rows; ``row`` ascends."""
    single = basis.astype(np.float32)
    edges = np.searchsorted(row, np.append(np.arange(0, rows, ROWS), rows))
    for k, (start, stop) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        used, at = np.unique(term[start:stop], return_inverse=True)
        x = np.zeros((min(ROWS, rows - k * ROWS), len(used)), np.float32)
        x[row[start:stop] - k * ROWS, at] = value[start:stop]
        yield k * ROWS, used, x, x @ single[used]


def _gram(row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int, basis: np.ndarray) -> np.ndarray:
    """Transposed sparse matrix times (sparse matrix times ``basis``)."""
    out = np.zeros_like(basis)
    for _, used, x, product in _blocks(row, term, value, rows, basis):
        out[used] += x.T @ product
    return out


def _corpus_sums(coded: DataFrame, spaces: list[Space], owns: list[np.ndarray], bases: list[np.ndarray], moments: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per space, over all passages: the product of their TF-IDF rows' Gram matrix and the basis, and with ``moments`` those of their word vectors.

    A task adds up its passages; the sums of all tasks are added up in stripes of
    ``STRIPE`` terms. The moments are of p, a passage's sum of idf times basis
    rows, and n, its words: sums of n, n², p, n p and p pᵀ.
    """
    idfs = [space.idf for space in spaces]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros_like(b) for b in bases]
        extra = [np.zeros(2 + 2 * b.shape[1] + b.shape[1] ** 2) for b in bases]
        for part in batches:
            pieces, known = _flat(part.column("pieces"))
            _, term = _flat(part.column("terms"))
            row = np.repeat(np.arange(len(known)), known)
            size = np.full(len(known), PASSAGE)
            some = pieces > 0
            size[np.cumsum(pieces)[some] - 1] = (part.column("words").to_numpy()[some] - 1) % PASSAGE + 1
            for own, idf, basis, total, sums in zip(owns, idfs, bases, totals, extra, strict=True):
                at = own[term]
                r, t, count = _counted(row[at >= 0], at[at >= 0], len(idf))
                value, norm = _weighted(r, t, count, len(known), idf)
                for first, used, x, product in _blocks(r, t, value, len(known), basis):
                    total[used] += x.T @ product
                    if moments:
                        n = size[first : first + len(product)].astype(float)
                        p = product * norm[first : first + len(product), None]
                        sums += np.concatenate([[n.sum(), n @ n], p.sum(0), n @ p, (p.T @ p).ravel()])
        number = TaskContext.get().partitionId()
        for k, (total, sums) in enumerate(zip(totals, extra, strict=True)):
            blocks = [total[i : i + STRIPE].tobytes() for i in range(0, len(total), STRIPE)] + [sums.tobytes()] * moments
            yield pa.record_batch([pa.array([k] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([number] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["space", "stripe", "task", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(x) for x in pdf.sort_values("task")["sums"]))
        return pdf.iloc[:1][["space", "stripe"]].assign(sums=total.tobytes())

    parts = coded.mapInArrow(multiply, "space int, stripe int, task int, sums binary").groupBy("space", "stripe").applyInPandas(add, "space int, stripe int, sums binary").collect()
    found = {(r["space"], r["stripe"]): np.frombuffer(r["sums"]) for r in parts}
    products, extra = [], []
    for k, basis in enumerate(bases):
        stripes = -(-len(basis) // STRIPE)
        products.append(np.concatenate([found[k, i] for i in range(stripes)]).reshape(basis.shape) if found else np.zeros_like(basis))
        extra.append(found.get((k, stripes), np.zeros(2 + 2 * basis.shape[1] + basis.shape[1] ** 2)))
    return products, extra


def fit_spaces(docs: DataFrame, spaces: list[Space]) -> list[Space]:
    """IDF over all documents, then per space the latent vectors of the terms by randomised SVD over all their passages."""
    terms = np.unique(np.concatenate([space.terms for space in spaces]))
    coded = _coded(docs, terms)
    n, df = _document_frequencies(coded, len(terms))
    owns, items, bases = [], [], []
    for space in spaces:
        at = np.searchsorted(terms, space.terms)
        own = np.full(len(terms), -1)
        own[at] = np.arange(len(at))
        owns.append(own)
        # words of many documents weigh least, but no word weighs nothing: an item that sits in a third of all rows has only such words
        space.idf = np.maximum(np.log((n + 1) / (df[at] + 1)), FLOOR * np.log(n + 2))
        row = np.repeat(np.arange(len(space.item_words)), [len(x) for x in space.item_words])
        r, t, count = _counted(row, space.find(np.concatenate(space.item_words))[0], len(space.terms))
        items.append((r, t, _weighted(r, t, count, len(space.item_words), space.idf)[0], len(space.item_words)))
        size = min(RANK + OVERSAMPLE, len(space.terms))
        bases.append(np.linalg.qr(np.random.default_rng(3).standard_normal((len(space.terms), size)))[0])
    rows = coded.agg(F.sum(F.size("pieces"))).first()[0] or 0

    def products(moments: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
        found, sums = _corpus_sums(coded, spaces, owns, bases, moments)
        # the items weigh as much as all passages
        return [x + max(1.0, rows / len(space.item_words)) * _gram(*own, basis) for x, space, own, basis in zip(found, spaces, items, bases, strict=True)], sums

    for _ in range(TURNS):
        bases = [np.linalg.qr(x)[0] for x in products()[0]]
    for space, own, basis, product, sums in zip(spaces, owns, bases, *products(True), strict=True):
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, np.argsort(-values)[:RANK]]
        _place(space, basis @ turn, df[own >= 0])
        space.limits = _limits(space, *_spread(sums, turn))
        space.signs = _signs(space)
    return spaces


def _place(space: Space, right: np.ndarray, df: np.ndarray) -> None:
    """Vectors of the terms and items, and the answers that the benchmark does not give."""
    space.vectors = np.ascontiguousarray(space.idf[:, None] * right, np.float32)
    queries = np.stack([space.vectors[space.find(x)[0]].sum(0) for x in space.item_words])
    space.queries = np.ascontiguousarray(queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9), np.float32)
    for i, x in enumerate(space.item_words):
        if not space.answers[i]:
            distinct = np.unique(x)
            rare = distinct[np.argsort(df[space.find(distinct)[0]], kind="stable")[:ANSWER_WORDS]]
            space.answers[i] = set(rare.tolist())


def _spread(sums: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector of a word of the corpus, and a root of the covariance, per word, of its passages."""
    width = len(turn)
    n, nn = sums[:2]
    p, np_, pp = sums[2 : 2 + width] @ turn, sums[2 + width : 2 + 2 * width] @ turn, turn.T @ sums[2 + 2 * width :].reshape(width, width) @ turn
    mean = p / max(n, 1.0)
    values, axes = np.linalg.eigh((pp - np.outer(np_, mean) - np.outer(mean, np_) + nn * np.outer(mean, mean)) / max(n, 1.0))
    return mean, axes * np.sqrt(np.maximum(values, 0))


def _classes(sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Window width (the longest), stride (from the shortest) and items of every class: lengths within a factor of ``SPREAD``."""
    rest = np.unique(sizes)
    while len(rest):
        low, width = int(rest[0]), int(rest[rest <= SPREAD * rest[0]][-1])
        yield width, max(1, low // STRIDES), np.flatnonzero((sizes >= low) & (sizes <= width))
        rest = rest[rest > width]


def _signs(space: Space) -> list[tuple[np.ndarray, int]]:
    out = []
    for _, _, items in _classes(np.array([len(x) for x in space.item_words])):
        flags, need = np.zeros(len(space.terms), bool), []
        for i in items.tolist():
            at, known = space.find(np.array(sorted(space.answers[i]), np.uint64))
            flags[at[known]] = True
            # answer words that are in no item's text cannot be counted here, so they count as there
            need.append(-(-len(space.answers[i]) // 2) - int((~known).sum()))
        out.append((flags, min(need)))
    return out


def _limits(space: Space, mean: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Least cosine of every item with windows that hold it, shifted by up to half a stride and with words replaced.

    The other words of a window are drawn as the corpus spreads: ``mean`` and
    ``root`` are those of all its passages.
    """
    rng, out = np.random.default_rng(11), np.full(len(space.item_words), COSINE)
    for width, stride, items in _classes(np.array([len(x) for x in space.item_words])):
        for i in items.tolist():
            x = space.item_words[i]
            begin = rng.integers(-(stride // 2), stride // 2 + 1, TRIALS)[:, None]
            place, share = np.arange(len(x)), np.resize(KEPT, TRIALS)[:, None]
            own = (place >= begin) & (place < begin + width) & (rng.random((TRIALS, len(x))) < share)
            # an item with fewer words left than counts is none
            own = own[own.sum(1) >= LCS_SHARE * len(x)]
            other = (width - own.sum(1))[:, None]
            p = own @ space.vectors[space.find(x)[0]] + other * mean + np.sqrt(other) * (rng.standard_normal((len(own), len(mean))) @ root.T)
            cosine = p @ space.queries[i] / np.maximum(np.linalg.norm(p, axis=1), 1e-6)
            out[i] = min(COSINE, cosine.min(initial=COSINE))
    return out


def common_subsequence(mask: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word step per word of ``other``."""
    v = full = (1 << size) - 1
    for h in other:
        m = mask.get(h)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _windows(bounds: np.ndarray, width: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    per_doc = np.where(size > 0, -(-np.maximum(size - width, 0) // stride) + 1, 0)
    doc = np.repeat(np.arange(len(size)), per_doc)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = bounds[doc] + turn * stride
    return doc, start, np.minimum(start + width, bounds[doc + 1])


def _run_hits(w: Words, space: Space, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, item, first and last place of the windows where an item would stand by a run that it shares with the text."""
    sizes = np.array([len(x) for x in space.item_words])
    for size, (hashes, item, at) in space.runs.items():
        start = np.flatnonzero(before[size:] - before[:-size] == size)
        start = start[start + size <= w.bounds[w.doc[start] + 1]]
        if not len(start):
            continue
        h = segments(w.hash, start, start + size)
        first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        n = last - first
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        place = np.repeat(start, n)
        doc = w.doc[place]
        pair = np.unique(np.stack([doc, item[k], np.maximum(place - at[k], w.bounds[doc])]), axis=1)
        yield pair[0], pair[1], pair[2], np.minimum(pair[2] + sizes[pair[1]], w.bounds[pair[0] + 1])


def _surroundings(bounds: np.ndarray, doc, start, end):
    """First and last place of what a window is confirmed on: a quarter of it more on both sides."""
    more = (end - start) // STRIDES
    return np.maximum(bounds[doc], start - more), np.minimum(bounds[np.add(doc, 1)], end + more)


def match_slice(w: Words, space: Space) -> list[tuple[int, int, float, float, int]]:
    """(row, item, cosine, share of the item's words, first word) of every confirmed pair of a slice."""
    at, known = space.find(w.hash)
    count = np.concatenate([[0], np.cumsum(known)])
    # windows that can be confirmed at all, by the words and answer words in their surroundings; the others need no vector
    able, covered = [], np.zeros(len(w.hash) + 1, np.int64)
    classes = list(_classes(np.array([len(x) for x in space.item_words])))
    for (width, stride, items), (flags, need) in zip(classes, space.signs, strict=True):
        marks = np.concatenate([[0], np.cumsum(known & flags[at])])
        doc, start, end = _windows(w.bounds, width, stride)
        first, last = _surroundings(w.bounds, doc, start, end)
        least = min(len(space.item_words[i]) for i in items)
        some = (count[end] - count[start] >= min(2, width)) & (marks[last] - marks[first] >= need) & (count[last] - count[first] >= LCS_SHARE * least - 1e-9)
        able.append((doc[some], start[some], end[some]))
    runs = list(_run_hits(w, space, count))
    for _, start, end in [*able, *((doc, s, e) for doc, _, s, e in runs)]:
        np.add.at(covered, start, 1)
        np.add.at(covered, end, -1)
    known &= np.cumsum(covered[:-1]) > 0
    place = np.flatnonzero(known)
    before = np.concatenate([[0], np.cumsum(known)])
    prefix = np.zeros((len(place) + 1, space.vectors.shape[1]), np.float32)
    np.cumsum(space.vectors[at[place]], axis=0, out=prefix[1:])
    found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}

    def add(doc: np.ndarray, item: np.ndarray, cosine: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        for x in zip(doc.tolist(), item.tolist(), cosine.tolist(), start.tolist(), end.tolist(), strict=True):
            found.setdefault(x[:2], []).append(x[2:])

    for (_, _, items), (doc, start, end) in zip(classes, able, strict=True):
        queries = np.ascontiguousarray(space.queries[items].T)
        limits = space.limits[items].astype(np.float32)
        for i in range(0, len(doc), 8192):
            s, e = start[i : i + 8192], end[i : i + 8192]
            p = prefix[before[e]] - prefix[before[s]]
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", p, p)), 1e-6)
            product = p @ queries
            r, c = np.nonzero(product >= limits * norm[:, None])
            add(doc[i + r], items[c], product[r, c] / norm[r], s[r], e[r])
    for doc, item, s, e in runs:
        p = prefix[before[e]] - prefix[before[s]]
        cosine = np.einsum("ij,ij->i", p, space.queries[item]) / np.maximum(np.linalg.norm(p, axis=1), 1e-6)
        add(doc, item, cosine, s, e)
    out = []
    for (d, item), hits in found.items():
        size, best = len(space.item_words[item]), None
        for cosine, s, e in sorted(hits, reverse=True):
            s, e = (int(x) for x in _surroundings(w.bounds, d, s, e))
            window = w.hash[s:e].tolist()
            if 2 * len(space.answers[item].intersection(window)) < len(space.answers[item]):
                continue
            share = common_subsequence(space.masks[item], size, window) / size
            if share >= LCS_SHARE:
                best = (cosine, share, s - int(w.bounds[d]))
                break
        if best:
            out.append((d, item, *best))
    return out


def _spaces(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Space]]:
    """The fitted spaces of every block of items."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where("text is not null")
    blocks = -(-items.count() // BLOCK)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        rows.sort(key=lambda r: len(r["text"].split()))
        parts = -(-len(rows) // SHARED)
        spaces = [_items(rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]) for k in range(parts)]
        spaces = [space for space in spaces if space.item_words]
        if spaces:
            yield fit_spaces(docs, spaces)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, cosine, lcs (share), place (word)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_search(d, spaces) for spaces in _spaces(d, benchmark)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCH)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns kept."""
    for spaces in list(_spaces(docs.select("text"), benchmark)):
        docs = _filtered(docs, spaces)
    return docs


def _filtered(docs: DataFrame, spaces: list[Space]) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SLICE):
            w = words(part.column("text"), lower=True)
            found = {r[0] for space in spaces for r in match_slice(w, space)}
            yield part.filter(pa.array([i not in found for i in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _search(docs: DataFrame, spaces: list[Space]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, SLICE):
            w = words(part.column("text"), lower=True)
            rows = [(r[0], space.item_ids[r[1]], *r[2:]) for space in spaces for r in match_slice(w, space)]
            if rows:
                ids = part.column("doc_id").to_pylist()
                columns = [[ids[r[0]] for r in rows], [r[1] for r in rows], *zip(*(r[2:] for r in rows), strict=True)]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "cosine", "lcs", "place"])

    return docs.mapInArrow(search, MATCH)
