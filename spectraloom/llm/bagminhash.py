"""Near-duplicate classes by BagMinHash signatures over word-shingle multisets.

A document is the multiset of its shingles of five words (a shorter text is one
shingle). The weight axis is discretised at the integers and split into dyadic
blocks [0,1), [1,2), [2,4), [4,8), ...; each (shingle, block) owns a Poisson
process whose rate is the block's size. Its points come in ascending time, each
with a signature component and a place inside the block; a point counts if its
place lies under the shingle's count, and a process stops once its time passes
the largest minimum of the document. Two documents agree in a component with
probability equal to their weighted Jaccard similarity.

Bands of components give candidate buckets. Exact copies are one node from the
start. Inside a bucket every member is verified against one hub on the whole
multisets; buckets whose members still lie in several components get new hubs,
and at last all untested pairs across components whose sizes and shared shingles leave the similarity
possible. Pairs inside one component need no test.

Null text is empty text; texts without words are duplicates only when equal.
A class is named by its smallest doc_id (null only if all ids are null). Rows
with the same id each get a row. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import Words, chunks, factorize, free_names, mix, staged, words
from spectraloom.operators.graph import connected_components

SHINGLE, SIMILARITY = 5, 0.8
#: components of a signature and components per band; a pair at 0.8 is missed with probability 3e-6
COMPONENTS, BAND = 96, 4
#: bytes of text whose signatures are made at once
SLICE = 500_000
#: open texts that have a shingle, up to which pairs are listed from it
RARE = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle; a text of fewer words is one shingle."""
    with np.errstate(over="ignore"):
        n = len(w.hash) - size + 1
        at = np.flatnonzero(w.doc[: max(n, 0)] == w.doc[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        h = np.zeros(len(at), np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + w.hash[at + j]
        per_doc = np.diff(w.bounds)
        few = np.flatnonzero((per_doc > 0) & (per_doc < size))
        short = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            use = per_doc[few] > j
            short[use] = short[use] * np.uint64(0x100000001B3) + w.hash[w.bounds[few[use]] + j]
    return np.concatenate([w.doc[at], few]), mix(np.concatenate([h, short]))


def _multiset(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        codes, _ = factorize(mix(h + (doc.astype(np.uint64) + np.uint64(1)) * _STEP))
    first = np.empty(codes.max() + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return doc[first], h[first], np.bincount(codes)


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, components: int = COMPONENTS) -> np.ndarray:
    """(docs, components) earliest times; documents without shingles keep infinity."""
    part_doc, seed, size, covered = [doc], [h], [np.ones(len(h))], [np.ones(len(h))]
    low = 1
    while len(left := np.flatnonzero(count > low)):
        part_doc.append(doc[left])
        seed.append(mix(h[left] ^ np.uint64(low)))
        size.append(np.full(len(left), float(low)))
        covered.append(np.minimum(count[left], 2 * low) - float(low))
        low *= 2
    doc, seed, size, covered = map(np.concatenate, (part_doc, seed, size, covered))
    best = np.full(docs * components, np.inf)
    time = np.zeros(len(seed))
    done, burst = 0, 1
    with np.errstate(over="ignore"):
        while len(seed):
            number = (np.arange(done + 1, done + burst + 1, dtype=np.uint64) * _STEP)[None, :]
            r = mix((seed[:, None] + number).ravel()).reshape(len(seed), burst)
            gap = -np.log1p(-(r >> np.uint64(11)).astype(float) * 2.0**-53) / size[:, None]
            at = time[:, None] + np.cumsum(gap, axis=1)
            r = mix(r.ravel() ^ _STEP).reshape(r.shape)
            place = (r >> np.uint64(32)).astype(float) * 2.0**-32 * size[:, None]
            component = (r & np.uint64(0xFFFFFFFF)) % np.uint64(components)
            ok = place < covered[:, None]
            np.minimum.at(best, (doc[:, None] * components + component.astype(np.int64))[ok], at[ok])
            time = at[:, -1]
            most = best.reshape(docs, components).max(axis=1) if done < 2 else _row_max(best, doc, docs, components)
            live = time < most[doc]
            doc, seed, size, covered, time = doc[live], seed[live], size[live], covered[live], time[live]
            done += burst
            burst = 1 if done < 2 else min(32, max(1, 200_000 // max(1, len(seed))))
    return best.reshape(docs, components)


def _row_max(best: np.ndarray, doc: np.ndarray, docs: int, components: int) -> np.ndarray:
    """Largest minimum, for the documents that are still in work."""
    rows = np.unique(doc)
    out = np.zeros(docs)
    out[rows] = best.reshape(docs, components)[rows].max(axis=1)
    return out


def band_hashes(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64)
    docs, components = bits.shape
    with np.errstate(over="ignore"):
        out = np.arange(1, components // band + 1, dtype=np.uint64)[None, :].repeat(docs, 0)
        for j in range(band):
            out = mix((out * _STEP + bits[:, j::band][:, : out.shape[1]]).ravel()).reshape(out.shape)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band hashes of every text, a slice at a time: the arrays of a slice take some fifty times its bytes."""
    for part in chunks(batches, SLICE):
        w = words(part.column("text"))
        doc, h, count = _multiset(*shingles(w))
        signature = signatures(doc, h, count, part.num_rows)
        bands = band_hashes(signature)
        empty = np.isinf(signature[:, 0])
        width = bands.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, width))]), pa.int32()), pa.array(bands[~empty].ravel()))
        yield pa.record_batch([part.column("doc_id"), part.column("digest"), lists, pa.array(np.diff(w.bounds), pa.int64())], names=["doc_id", "digest", "bands", "words"])


def similarities(left: pa.Array, right: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard of shingle multisets, row by row."""
    n = len(left)
    doc_a, a = shingles(words(left), size)
    doc_b, b = shingles(words(right), size)
    doc = np.concatenate([doc_a, doc_b])
    with np.errstate(over="ignore"):
        codes, _ = factorize(mix(np.concatenate([a, b]) + (doc.astype(np.uint64) + np.uint64(1)) * _STEP))
    k = int(codes.max()) + 1 if len(codes) else 0
    row = np.zeros(k, np.int64)
    row[codes] = doc
    in_a, in_b = np.bincount(codes[: len(a)], minlength=k), np.bincount(codes[len(a) :], minlength=k)
    common = np.bincount(row, np.minimum(in_a, in_b), n)
    union = np.bincount(row, np.maximum(in_a, in_b), n)
    return np.divide(common, union, out=np.zeros(n), where=union > 0)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs (src, dst) whose whole multisets reach ``similarity``.

    What two multisets have in common is at most the smaller one: pairs whose
    numbers of shingles already keep them apart are not sent with their texts.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], SLICE, ("text", "other")):
                good = similarities(part.column("text"), part.column("other"), size) >= similarity - 1e-12
                yield part.select(["src", "dst"]).filter(pa.array(good))

    n = texts.select("node", F.when(F.col("words") > 0, F.greatest(F.col("words") - (size - 1), F.lit(1))).otherwise(0).alias("n"))
    sized = pairs.join(n.select(F.col("node").alias("src"), F.col("n").alias("n_src")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("n_dst")), "dst")
    pairs = sized.where(F.least("n_src", "n_dst") >= (similarity - 1e-9) * F.greatest("n_src", "n_dst")).select("src", "dst")
    both = pairs.join(texts.select(F.col("node").alias("src"), "text"), "src").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("other")), "dst")
    return both.select("src", "dst", "text", "other").mapInArrow(check, "src long, dst long")


def _support(nodes: DataFrame, texts: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(node, size, support, core; node, shingle) of the open texts.

    ``size`` counts a text's shingles, ``support`` those that another open text
    has too, ``core`` those that more than ``RARE`` open texts have. The second
    table lists the supported shingles outside the core.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch]):
                doc, h, count = _multiset(*shingles(words(part.column("text")), size))
                yield pa.record_batch([part.column("node").take(pa.array(doc)), pa.array(h.view(np.int64)), pa.array(count, pa.int64())], names=["node", "shingle", "count"])

    rows = texts.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(spread, "node long, shingle long, count long")
    rows = staged(rows.groupBy("node", "shingle").agg(F.max("count").alias("count")), "shingles")
    shared = staged(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    known = staged(rows.join(shared, "shingle", "left"), "known")
    counts = known.groupBy("node").agg(
        F.sum("count").alias("size"), F.sum(F.when(F.col("n").isNotNull(), F.col("count")).otherwise(0)).alias("support"), F.sum(F.when(F.col("n") > RARE, F.col("count")).otherwise(0)).alias("core"),
    )
    return staged(counts, "support"), known.where(F.col("n") <= RARE).select("node", "shingle")


def _possible_pairs(open_: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """Pairs of one bucket and different components that can still reach the similarity.

    A pair without a common rare shingle shares core shingles only, so the
    smaller core bounds what is common; pairs with a common rare shingle are
    listed from those shingles, which at most ``RARE`` texts have.
    """
    counts, rare = _support(open_, texts, size)
    open_ = staged(open_.drop("met").join(counts, "node"), "open")

    def bounded(common: str) -> Column:
        most = F.least(f"a.{common}", f"b.{common}")
        return (F.col("a.component") < F.col("b.component")) & (most >= (similarity - 1e-9) * (F.col("a.size") + F.col("b.size") - most))

    # a pair is listed in the smallest of its common buckets only
    placed = staged(open_.join(open_.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node"), "placed")
    once = F.col("a.bucket") == F.array_min(F.array_intersect("a.buckets", "b.buckets"))
    by_bucket = placed.alias("a").join(placed.alias("b"), (F.col("a.bucket") == F.col("b.bucket")) & bounded("core") & once)
    rare = staged(rare.join(open_.select("node", "component", "size", "support").distinct(), "node"), "rare")
    by_shingle = rare.alias("a").join(rare.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & bounded("support"))
    return by_bucket.select(F.col("a.node").alias("node"), F.col("b.node").alias("hub")).unionByName(by_shingle.select(F.col("a.node").alias("node"), F.col("b.node").alias("hub")))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, hub_rounds: int = 1) -> DataFrame:
    """doc_id, digest (of the text), class, class_id, class_size for every row of ``docs``.

    ``hub_rounds`` only says how many hubs a bucket tries before its remaining
    pairs across components are tested one by one; the result is the same.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))

    signed = staged(rows.mapInArrow(_signed, "doc_id long, digest binary, bands array<long>, words long"), "signatures")
    nodes = staged(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("words").alias("words")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    full = staged(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full-buckets")
    buckets = staged(banded.join(full, "bucket"), "shared-buckets")
    # the text that most others resemble meets most of them in its buckets: the best hub
    central = staged(buckets.groupBy("node").agg(F.sum("n").alias("met")), "central")
    buckets = staged(buckets.drop("n").join(central, "node"), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("digest").alias("d"), "rep", "words")
    texts = staged(rows.join(wanted, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text", "words"), "texts")

    tested = edges = component = None
    turn = 0
    while True:
        open_ = buckets if component is None else buckets.join(component, "node", "left").select("bucket", "node", "met", F.coalesce("component", "node").alias("component"))
        if component is None:
            open_ = open_.withColumn("component", F.col("node"))
        else:
            mixed = open_.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
            open_ = open_.join(mixed, "bucket")
        if turn < hub_rounds:
            order = F.struct(-F.col("met"), "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            hubs = open_.groupBy("bucket").agg(F.min_by("node", order).alias("hub"), F.min_by("component", order).alias("hub_component"))
            other = open_.join(hubs, "bucket").where(F.col("component") != F.col("hub_component")).select(F.col("node"), F.col("hub"))
        else:
            other = _possible_pairs(open_, texts, similarity, size)
        pairs = other.select(F.greatest("node", "hub").alias("src"), F.least("node", "hub").alias("dst")).distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["src", "dst"], "left_anti"), "pairs")
        if pairs.isEmpty():
            if turn >= hub_rounds:
                break
            turn = hub_rounds
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = staged(_verified(pairs, texts, similarity, size).distinct(), "links")
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            component = staged(connected_components(edges).select("node", "component"), "components")
        # after the pairs across components nothing is left: merging components only takes pairs away
        if turn >= hub_rounds:
            break
        turn += 1

    named = nodes.select("digest", "node", "rep")
    named = named.withColumn("component", F.col("node")) if component is None else named.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    size_of = signed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    named = staged(named.join(size_of, "digest"), "named")
    classes = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "component").select("digest", F.col("component").alias("class"), "class_id", "class_size")
    return signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "digest", "class", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Rows of ``docs``, one per class: the one with the smallest doc_id (repeated rows count once)."""
    own, one_id, digest, row = free_names(docs, "own_digest", "kept_id", "kept_digest", "copy")
    found = near_duplicates(docs, similarity, size)
    # texts of one class that share the smallest id: the smallest digest stays
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class", "class_id").agg(F.min("digest").alias(digest))
    keep = staged(keep.select(F.col("class_id").alias(one_id), digest), "kept")
    d = docs.withColumn(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    d = d.join(keep, (F.col(own) == F.col(digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(one_id)))
    first = F.row_number().over(Window.partitionBy(own, one_id).orderBy(F.lit(0)))
    return d.withColumn(row, first).where(F.col(row) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
