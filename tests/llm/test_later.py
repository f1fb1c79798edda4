"""Collocations, language spans, fill-in-middle, Katz orders, token store, pipeline stages: against plain versions."""

import collections
import hashlib
import itertools
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spectraloom.llm import bagminhash, collocations, decontam, fim, katz, langid, queries, tokens
from spectraloom.llm.common import words
from spectraloom.llm.tokens import default_path
from tests.check import compare
from tests.llm.test_llm import none, odd  # noqa: F401

DOCS = "doc_id long, text string, lang string"


# --- collocations ---------------------------------------------------------------

def plain_collocations(rows, least=10, top=2000, longest=3, cover=50):
    counts = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        scored = []
        for k, a in candidates.items():
            score, _, left, right = min((1_000_000 * a * a // (f[k[:i]] * f[k[i:]]), i, f[k[:i]], f[k[i:]]) for i in range(1, len(k)))
            covered = any(len(o) > len(k) and 100 * b >= cover * a and any(o[i : i + len(k)] == k for i in range(len(o) - len(k) + 1)) for o, b in candidates.items())
            if not covered:
                scored.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return out


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_collocations_equal_a_plain_version(spark):
    rng = np.random.default_rng(0)
    words = ["a", "B", "c", "É", "d.", "e,", "x\ty", "z\n"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))), [None, "en", "fr"][int(rng.integers(3))]) for i in range(60)] + [(90, None, "en"), (91, "", None)]
    d = spark.createDataFrame(rows, DOCS)
    plain = [(lang, t) for _, t, lang in rows]
    assert as_set(collocations.collocations(d)) == plain_collocations(plain)
    assert as_set(collocations.collocations(d, least=3, longest=4, top=7)) == plain_collocations(plain, 3, 7, 4)
    assert as_set(collocations.collocations(d, least=2, longest=2)) == plain_collocations(plain, 2, 2000, 2)


def test_collocations_on_awkward_tables(odd, none):  # noqa: F811
    assert collocations.collocations(none).count() == 0
    got = {r.phrase: r for r in collocations.collocations(odd).collect()}
    long = got["word word word"]
    assert (long.lang, long.a, long.l, long.r) == ("en", 39_998, 39_999, 40_000) or (long.a, long.l, long.r) == (39_998, 40_000, 39_999)


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = as_set(collocations.collocations(docs))
    monkeypatch.setattr(collocations, "FILTER_BITS", 64)
    assert want and as_set(collocations.collocations(docs)) == want


@pytest.mark.parametrize("name", ["op11_collocations", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    class Query:
        run, sql = staticmethod(queries.QUERIES[name]), queries.SQL[name]

    message, _, ok = compare(spark, Query, "/root/testdata/sf0.01")
    assert ok, message


# --- languages ------------------------------------------------------------------

def test_best_path_equals_all_paths():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 6, 0, 3]
    emission = rng.normal(0, 3, (sum(sizes), 3)).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = langid.best_path(emission, bounds, 2.0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        def value(path, a=a):
            return sum(emission[a + i, s] for i, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
        assert abs(value(best) - value(got[a:b].tolist())) < 1e-4


def test_languages(spark, odd, none):  # noqa: F811
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where(~langid.held_out())
    model = langid.fit_languages(train)
    assert model.langs == ["de", "en", "es", "fr"]
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    rows = langid.identify(odd, model).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" and r.score == 0 and not r.spans for r in rows if r.doc_id in (1, 2))
    assert langid.identify(none, model).count() == 0
    unlearned = langid.fit_languages(none)
    assert unlearned.langs == [] and {r.lang_pred for r in langid.identify(odd, unlearned).collect()} == {"und"}


def test_spans_of_mixed_text_and_scripts(spark):
    one, two = "the cat and the dog went over the hill with this and that ", "der hund und die katze ging mit dem ball nach hause nicht "
    cyrillic = "кошка и собака пошли домой через холм "
    rows = [(i, t * 5, lang) for i, (t, lang) in enumerate([(one, "en"), (two, "de"), (cyrillic, "ru")] * 4)]
    model = langid.fit_languages(spark.createDataFrame(rows, DOCS))
    mixed = one + "123. " + two + one + cyrillic
    r = langid.identify(spark.createDataFrame([(1, mixed), (2, "12 34 ?!"), (3, cyrillic)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s.lang for s in r[0].spans] == ["en", "de", "en", "ru"] and r[0].lang_pred == "en"
    for s, text in zip(r[0].spans, (one, two, one, cyrillic), strict=True):
        assert mixed[s.start : s.end] == text.strip()
    assert r[1].lang_pred == "und" and (r[2].lang_pred, r[2].score) == ("ru", 1.0)
    # letters of a script that no language uses leave all languages as candidates
    assert model.candidate[list(langid.SCRIPTS).index("Cyrillic")].tolist() == [False, False, True]
    assert model.candidate[list(langid.SCRIPTS).index("Han")].all()


# --- fill in the middle ---------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_a_plain_version(spark, odd, none):  # noqa: F811
    texts = ["a", "é", "😀 x" * 9, "ab <M> cd", "$1 \\1 $0 <P", "x" * 70_000, "a\r\nb c\x85d", "<", "ab" * 3 + "." * 50_000, None, "", "<<S>>"]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "no id"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (d, odd.select("doc_id", "text", F.lit(5).alias("n"), F.lit("q").alias("form"), "keep")):
        given = [(r.doc_id, r.text) for r in table.collect()]
        want = collections.Counter((i, *plain_fim(i, t), t or "") for i, t in given)
        made = fim.fill_in_middle(table)
        got = collections.Counter(
            (r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output, r.back) for r in made.withColumn("back", fim.restored()).collect()
        )
        assert got == want
    assert fim.fill_in_middle_digests(none).count() == 0 and fim.fill_in_middle_digests(odd).count() == odd.count()


def test_fill_in_middle_of_a_long_text(spark):
    r = fim.fill_in_middle_digests(spark.createDataFrame([(1, "ab, " * 300_000)], "doc_id long, text string")).first()
    assert r.n == 900_000 and r.restored_sha256 == hashlib.sha256(b"ab, " * 300_000).hexdigest()


# --- Katz -----------------------------------------------------------------------

class PlainKatz:
    """Recursive Katz backoff from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, [None, *[collections.Counter() for _ in range(order)]]
        for t in texts:
            for m in range(1, order + 1):
                for i in range(len(t)):
                    self.c[m][self.history(t, i, m), t[i]] += 1
        self.totals = [None, *[collections.Counter() for _ in range(order)]]
        for m in range(1, order + 1):
            for (h, _), n in self.c[m].items():
                self.totals[m][h] += n
        self.vocabulary = sorted({w for _, w in self.c[1]})
        self.ratio = [None, *[katz.discounts([sum(v == r for v in self.c[m].values()) for r in range(1, katz.CUT + 2)]) for m in range(1, order + 1)]]
        self.uni = katz.Unigrams(sum(self.c[1].values()), len(self.vocabulary), np.array([sum(v == r for v in self.c[1].values()) for r in range(1, katz.CUT + 2)]))

    @staticmethod
    def history(t, i, m):
        if m == 1:
            return ()
        past = ["<s>", *t[:i]]
        return tuple(past[-(m - 1) :])

    def p(self, h, w, m):
        if m == 1:
            return float(self.uni.probability(np.array([self.c[1][(), w]]))[0])
        # the start alone stands for a longer history that is not there
        below = () if m == 2 else h if len(h) < m - 1 else h[1:]
        low = lambda x: self.p(below, x, m - 1)
        total = self.totals[m][h]
        if not total:
            return low(w)
        seen = {x: n for (g, x), n in self.c[m].items() if g == h}
        kept = lambda n: n * (self.ratio[m][n - 1] if n <= katz.CUT else 1.0)
        free = sum(n - kept(n) for n in seen.values())
        plus = free <= 1e-9
        if w in seen:
            return kept(seen[w]) / (total + plus)
        return (1.0 if plus else free) / (total + plus) / (1 - sum(low(x) for x in seen)) * low(w)


@pytest.mark.parametrize("order", [2, 3])
def test_katz_equals_a_plain_version_and_sums_to_one(spark, order):
    rng = np.random.default_rng(order)
    words = [f"w{int(i)}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(words, int(rng.integers(0, 15)), p=np.array([0.3, 0.2, *[0.05] * 10])))) for i in range(50)] + [(60, None), (61, "never seen here w1 w0 w1")]
    split = {i: [*(t or "").split(), "</s>"] for i, t in texts}
    model = PlainKatz([t for i, t in split.items() if not katz.held_out(i)], order)
    rows = katz.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), order, bucket_grams=100).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = split[r.doc_id]
        want = sum(np.log10(model.p(model.history(t, i, order), t[i], order)) for i in range(len(t)))
        assert abs(r.score - want) < 1e-9, (r.doc_id, r.score, want)
    for h in list(model.totals[order])[:20]:
        # all known words, and the one unknown type
        assert abs(sum(model.p(h, w, order) for w in model.vocabulary) + model.p(h, "<unk>", order) - 1) < 1e-9


def test_katz_order_is_the_limit_of_the_history(spark, odd, none):  # noqa: F811
    assert katz.score(odd, 3).count() == odd.count() and katz.score(none, 3).count() == 0
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]
    assert tables == []


# --- token store, pipeline ------------------------------------------------------

def test_more_pieces_than_the_store_holds(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "KEPT_PIECES", 150)
    e = tokens.Encoder(default_path())
    library = Tokenizer.from_file(default_path())
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{int(i)}" for i in rng.integers(0, 2000, 700)) for _ in range(4)] + ["a <|endoftext|> b", "short", "short word1 word2"]
    for _ in range(2):
        for batch in (texts, texts[4:], texts[:1], texts[5:]):
            assert [x.tolist() for x in e.encode(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_pipeline_stages_on_awkward_tables(spark, odd, none):  # noqa: F811
    odd = odd.withColumns({"n_deleted": F.lit(5), "score": F.lit(0.0), "n_lines": F.lit("x"), "keep": F.lit(False)})
    for table in (odd, none):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name == "packing":
                assert out.count() >= docs.count()
            else:
                assert out.columns == table.columns, name
                docs = spark.createDataFrame(out.collect(), table.schema)
        assert docs.count() == 0 if table is none else docs.count() > 3
    # a column named keep says nothing; untouched rows keep their n_chars
    kept = corpus_pipeline.drop_repeated_lines(spark, odd, "")
    assert kept.count() == odd.count() and {r.n_chars for r in kept.where("doc_id = 4").collect()} <= {None, 7}


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(decontam, "_limits", lambda space, mean, root: drawn.append((mean, root)) or np.full(2, decontam.COSINE))
    rng = np.random.default_rng(21)
    terms = [f"t{i}" for i in range(40)]
    # the start of a long text and its rest speak of different things
    texts = [" ".join([*rng.choice(terms[:8], 64), *rng.choice([*terms[8:], "other"], int(rng.integers(0, 700)))]) for _ in range(60)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    space = decontam._items([{"text": " ".join(terms[i::2]), "answer": None, "item_id": i} for i in range(2)])
    (space,) = decontam.fit_spaces(docs, [space])
    number = {h: i for i, h in enumerate(space.terms.tolist())}
    code = dict(zip(terms, (number[h] for h in words(pa.array([" ".join(terms)]), lower=True).hash.tolist()), strict=True))
    pieces = [x[i : i + 64] for x in ((t or "").split() for t in texts) for i in range(0, len(x), 64)]
    df = np.zeros(40)
    for t in texts:
        df[[code[x] for x in set((t or "").split()) if x in code]] += 1
    idf = np.maximum(np.log((len(texts) + 1) / (df + 1)), decontam.FLOOR * np.log(len(texts) + 2))
    assert np.allclose(space.idf, idf)

    def unit(lists):
        x = np.zeros((len(lists), 40))
        for i, p in enumerate(lists):
            for word in p:
                if word in code:
                    x[i, code[word]] += idf[code[word]]
        return x, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    (raw, rows), (_, items) = unit(pieces), unit([terms[0::2], terms[1::2]])
    values, axes = np.linalg.eigh(rows.T @ rows + len(pieces) / 2 * items.T @ items)
    got = space.vectors / idf[:, None]
    # without signs: the space of the five strongest directions
    assert np.abs(got[:, :5] @ got[:, :5].T - axes[:, :-6:-1] @ axes[:, :-6:-1].T).max() < 1e-3
    size = np.array([len(p) for p in pieces], float)
    p, mean = raw @ got, (raw @ got).sum(0) / size.sum()
    rest = p - size[:, None] * mean
    ((got_mean, got_root),) = drawn
    assert np.abs(got_mean - mean).max() < 1e-4 and np.abs(got_root @ got_root.T - rest.T @ rest / size.sum()).max() < 1e-3


def test_signatures_take_bounded_memory():
    rng = np.random.default_rng(8)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**7, 300))) for _ in range(2500)])
    batch = pa.record_batch([pa.array(range(2500), pa.int64()), pa.array([b"x"] * 2500), texts], names=["doc_id", "digest", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in bagminhash._signed(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # one slice of all 6 MB takes some 200 MB
    assert rows == 2500 and batch.nbytes > 5_500_000 and peak < 80_000_000
