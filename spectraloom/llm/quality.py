"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees what words look like: hashed words, word endings, shapes and
repetition. The metadata view sees language, source, size, line layout and the
mix of character classes. Both are logistic models. In every round each view
labels the unlabelled documents it is most sure of and hands them to the other
view. At the end each view is calibrated on held-out labels, and a third logistic model
weighs the two calibrated log-odds into the score of a document. Documents
under the threshold are rejected; the threshold is the highest one, up to 0.5,
that keeps ``KEEP_GOOD`` of the good held-out documents.

Fitting uses at most ``MAX_LABELLED`` labelled and ``MAX_POOL`` unlabelled
documents, chosen by hash; every document is scored, on its whole text.

Null text is empty text, null language or source a value of its own, a null
``n_chars`` is measured. Labels with a null id or quality are left out, several
labels of an id are averaged, several documents of a labelled id are
represented by the smallest text. Without labels of both kinds nothing is
rejected and the score is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.llm.common import Words, chunks, factorize, free_names, mix, text_bytes

MAX_LABELLED, MAX_POOL = 6_000, 4_000
ROUNDS, HANDED, SURE = 4, 0.1, 0.95
KEEP_GOOD = 0.995
SHAPES, ENDINGS, WORD_BINS, SOURCES, LANGS = 5 * 5 * 8, 192, 96, 32, 12


def _classes() -> np.ndarray:
    """0 upper, 1 lower or beyond ASCII, 2 digit, 3 sign, 4 white space."""
    c = np.full(256, 3, np.int64)
    c[65:91], c[97:123], c[128:], c[48:58] = 0, 1, 1, 2
    c[[32, 9, 10, 11, 12, 13]] = 4
    return c


CLASSES = _classes()


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Text view and metadata view of every row."""
    raw, bounds = text_bytes(batch.column("text"))
    w = Words(raw, bounds, False)
    n = w.docs
    count = np.diff(w.bounds).astype(float)
    safe = np.maximum(count, 1)[:, None]

    def spread(code: np.ndarray, size: int) -> np.ndarray:
        return np.sqrt(np.bincount(w.doc * size + code, minlength=n * size).reshape(n, size) / safe)

    length = w.end - w.start
    kinds = CLASSES[raw]
    shape = (kinds[w.start] * 5 + kinds[w.end - 1]) * 8 + np.minimum(length, 15) // 2 if len(raw) else np.zeros(0, np.int64)
    ending = np.zeros(len(length), np.uint64)
    for j in (3, 2, 1):
        use = length >= j
        ending[use] = ending[use] * np.uint64(257) + raw[w.end[use] - j]
    with np.errstate(over="ignore"):
        codes, _ = factorize(mix(w.hash + (w.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    k = int(codes.max()) + 1 if len(codes) else 0
    owner = np.zeros(k, np.int64)
    owner[codes] = w.doc
    different = np.bincount(owner, minlength=n)
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
    again = np.bincount(w.doc[same], minlength=n)
    text = np.hstack([
        spread(shape, SHAPES), spread((mix(ending) % np.uint64(ENDINGS)).astype(np.int64), ENDINGS), spread((w.hash % np.uint64(WORD_BINS)).astype(np.int64), WORD_BINS),
        (different / safe[:, 0])[:, None], (again / safe[:, 0])[:, None], np.log1p(count)[:, None],
    ])

    size = np.diff(bounds)
    doc = np.repeat(np.arange(n), size)
    mixed = np.bincount(doc * 5 + kinds, minlength=n * 5).reshape(n, 5) / np.maximum(size, 1)[:, None] if len(raw) else np.zeros((n, 5))
    lines = 1 + np.bincount(doc[raw == 10], minlength=n) if len(raw) else np.ones(n)
    stated = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False)
    chars = np.where(np.isnan(stated), size, stated)

    def bins(name: str, most: int) -> np.ndarray:
        out = np.zeros((n, most))
        for i, v in enumerate(batch.column(name).to_pylist()):
            out[i, int.from_bytes(str(v).encode()[-8:], "big") % (most - 1) if v is not None else most - 1] = 1
        return out

    meta = np.hstack([
        bins("lang", LANGS), bins("source", SOURCES), mixed, np.log1p(np.maximum(chars, 0))[:, None], np.log1p(lines)[:, None], np.log1p(size / lines)[:, None],
        np.log1p(count / lines)[:, None], (size / np.maximum(count, 1))[:, None].clip(0, 50),
    ])
    return text.astype(np.float32), meta.astype(np.float32)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 200) -> Logistic:
        """Accelerated gradient steps on standardised features; both classes weigh the same."""
        mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
        z = (x - mean) / scale
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
        w, b = np.zeros(z.shape[1]), 0.0
        u, c = w.copy(), b
        # the largest eigenvalue of the weighted Gram matrix, by a few power steps
        v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
        for _ in range(15):
            v = z.T @ (weight * (z @ v))
            top = np.linalg.norm(v)
            v = v / max(top, 1e-12)
        rate = 1.0 / (0.25 * (1.3 * top + 1) + ridge)
        for i in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ u + c, -30, 30)))
            g = weight * (p - y)
            new_w, new_b = u - rate * (z.T @ g + ridge * u), c - rate * g.sum()
            m = i / (i + 3)
            u, c = new_w + m * (new_w - w), new_b + m * (new_b - b)
            w, b = new_w, new_b
        return cls(mean, scale, w, b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of good quality."""
        return self.slope * (((x - self.mean) / self.scale) @ self.weight + self.bias) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling: slope and shift by Newton steps, with softened targets."""
        s = self.odds(x)
        good, bad = (y > 0).sum(), (y <= 0).sum()
        t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            q = np.maximum(p * (1 - p), 1e-9)
            g = np.array([((p - t) * s).sum() + 1e-3 * (a - 1), (p - t).sum()])
            h = np.array([[(q * s * s).sum() + 1e-3, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-9]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(a, 1e-3), b


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    both: Logistic | None = None
    threshold: float = 0.5

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = self.odds(text, meta)
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (odds[:, 0], odds[:, 1], self.both.odds(odds)))

    def odds(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.clip(np.column_stack([self.text.odds(text), self.meta.odds(meta)]), -12, 12)


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray) -> CoTrained:
    """``label`` is 1, 0 or NaN (unlabelled); ``held`` marks labelled rows kept for calibration."""
    known = ~np.isnan(label)
    fit, held = known & ~held, known & held
    views = (text, meta)
    target = [np.where(fit, label, np.nan) for _ in views]
    pool = ~known
    for turn in range(ROUNDS + 1):
        models = []
        for x, y in zip(views, target, strict=True):
            use = ~np.isnan(y)
            models.append(Logistic.fit(x[use], y[use]))
            models[-1].calibrate(x[held], label[held])
        if turn == ROUNDS or not pool.any():
            break
        for me, other in ((0, 1), (1, 0)):
            free = np.flatnonzero(pool & np.isnan(target[other]))
            if len(free):
                p = 1 / (1 + np.exp(-np.clip(models[me].odds(views[me][free]), -30, 30)))
                for sure, value in ((p, 1.0), (1 - p, 0.0)):
                    best = np.argsort(-sure, kind="stable")[: max(1, int(HANDED * len(free) / 2))]
                    target[other][free[best[sure[best] >= SURE]]] = value
    out = CoTrained(*models)
    odds = out.odds(text[held], meta[held])
    out.both = Logistic.fit(odds, label[held])
    out.both.calibrate(odds, label[held])
    p = out.scores(text[held], meta[held])[2]
    good = np.sort(p[label[held] > 0])
    out.threshold = float(min(0.5, good[int((1 - KEEP_GOOD) * len(good))])) if len(good) else 0.0
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> CoTrained | None:
    """Co-train on bounded samples; None without labels of both kinds."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
    order = F.xxhash64("_id", F.lit(11))
    chosen = known.orderBy(order, "_id").limit(MAX_LABELLED).collect()
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null")
    pool = ids.join(known, "_id", "left_anti").distinct().orderBy(order, "_id").limit(MAX_POOL).collect()
    rows = [(r["_id"], r["_label"]) for r in chosen] + [(r["_id"], None) for r in pool]
    if not rows:
        return None
    # at most MAX_LABELLED + MAX_POOL rows
    sample = F.broadcast(spark.createDataFrame(rows, "_id long, _label double"))
    picked = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).join(sample, "_id")
    picked = picked.groupBy("_id", "_label").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d")).select("_id", "_label", "d.*")

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text, meta = features(part)
            yield pa.record_batch([part.column("_id"), part.column("_label"), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["_id", "_label", "text", "meta"])

    got = picked.mapInArrow(view, "_id long, _label double, text binary, meta binary").toPandas().sort_values("_id", kind="stable")
    label_of = got["_label"].to_numpy(float)
    if not ((label_of == 1).any() and (label_of == 0).any()):
        return None
    text, meta = (np.vstack([np.frombuffer(b, np.float32) for b in got[c]]).astype(float) for c in ("text", "meta"))
    held = mix(got["_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(3) == 0
    if not (label_of[held] == 1).any() or not (label_of[held] == 0).any() or not (label_of[~held] == 1).any() or not (label_of[~held] == 0).any():
        held = np.arange(len(held)) >= 0  # too few labels to hold any out
        return _without_holdout(text, meta, label_of, held)
    return co_train(text, meta, label_of, held)


def _without_holdout(text: np.ndarray, meta: np.ndarray, label: np.ndarray, every: np.ndarray) -> CoTrained:
    """With a handful of labels the same rows fit and calibrate."""
    twice = np.concatenate([label, np.where(np.isnan(label), np.nan, label)])
    return co_train(np.vstack([text, text]), np.vstack([meta, meta]), twice, np.concatenate([~every, every]))


def score_quality(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """``docs`` with p_text, p_meta, score and keep (underscores are put before names that ``docs`` has)."""
    names = free_names(docs, "p_text", "p_meta", "score", "keep")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", *[none.alias(n) for n in names[:3]], F.lit(True).alias(names[3]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            a, b, p = model.scores(*features(part))
            yield pa.record_batch([*part.columns, pa.array(a), pa.array(b), pa.array(p), pa.array(p >= model.threshold)], names=[*part.schema.names, *names])

    added = [T.StructField(n, T.DoubleType()) for n in names[:3]] + [T.StructField(names[3], T.BooleanType())]
    return docs.mapInArrow(apply, T.StructType([*docs.schema.fields, *added]))
