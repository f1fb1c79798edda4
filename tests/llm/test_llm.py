"""Training-data operators on awkward tables, and against plain versions."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spectraloom.llm import bagminhash, decontam, fingerprints, katz, licenses, linedup, packing, pii, quality, records
from spectraloom.llm.common import new_folder
from spectraloom.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, keep boolean, runs int"
PASSAGE = "\n".join(" ".join(f"p{i}x{j}" for j in range(20)) for i in range(3))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ids used twice, clashing extra columns."""
    texts = [(None, None), (None, "x y"), (1, ""), (2, None), (3, "word " * 40_000), (4, "same text here"), (4, "same text here"), (5, "other text"), (5, "third\n\n" + PASSAGE), (6, PASSAGE + "\nend of it"), (7, "é😀 " + PASSAGE)]
    rows = [(i, t, None if n % 2 else "en", None if n % 3 else "s", None if n % 4 else 7, "k", 1, True, 3) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encoder_equals_the_library():
    e = encoder(default_path())
    texts = ["", None, "it's 's we'll", "  a  b \n\n c", "x1 ٣² 中文 é<|endoftext|>", "tab\t\x1c end ", "''s'd", "́a"]
    assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, odd, none):
    got = collections.defaultdict(list)
    pieces = [r.asDict() for r in packing.pack(odd, default_path()).collect()]
    for r in pieces:
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in got.values():
        parts.sort()
        assert [o for o, _ in parts] == np.concatenate([[0], np.cumsum([n for _, n in parts])[:-1]]).tolist() and sum(n for _, n in parts) <= 1024
    want = sum(len(x) + 1 for x in encoder(default_path()).encode([r.text for r in odd.select("text").collect()]))
    assert sum(r["length"] for r in pieces) == want
    assert packing.pack(none, default_path()).count() == 0


def test_packing_solver_fills_windows():
    h = np.zeros(1024, np.int64)
    h[[100, 924, 512, 300, 424]] = [10, 7, 9, 5, 5]
    plan = packing.Plan(h, 1024)
    seen = collections.Counter()
    for length in np.flatnonzero(h):
        for rank in range(h[length]):
            for _, n, sequence, _ in plan.pieces(int(length), rank):
                seen[sequence] += n
    assert sum(seen.values()) == (np.arange(1024) * h).sum() and all(n == 1024 or n & (n - 1) == 0 for n in seen.values())


def test_records_round_trip_and_broken_bytes(spark, odd, none):
    path = new_folder(spark, "records")
    records.write_records(odd, path, default_path())
    records.write_index(spark, path)
    rows = records.record_digests(spark, path).orderBy("start").collect()
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = np.append(encoder(default_path()).encode([r.text])[0], 2).astype("<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    by_index = collections.Counter((r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in records.read_records(spark, path).collect())
    assert by_index == want
    data = bytearray(records.frame(3, np.array([1, 70_000], np.uint32)))
    assert records.unframe(bytes(data), 0)[1].tolist() == [1, 70_000]
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data), 0)


def test_line_runs(odd, none):
    got = {(r.doc_id, r.text) for r in linedup.drop_repeated_runs(odd).select("doc_id", "text").collect()}
    assert (6, "end of it") in got and (5, "third\n\n" + PASSAGE) in got and (None, None) in got
    assert linedup.drop_repeated_runs(odd).count() == odd.count() and linedup.drop_repeated_runs(none).count() == 0


def test_near_duplicates(spark, odd, none):
    got = collections.defaultdict(set)
    for r in bagminhash.near_duplicates(odd).collect():
        got[r["class"]].add(r.doc_id)
    assert {frozenset(x) for x in got.values()} >= {frozenset({4}), frozenset({3})}
    assert bagminhash.keep_one(odd).where("doc_id = 4").count() == 1
    assert bagminhash.near_duplicates(none).count() == 0
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(1, 60, 9)] + [(100, " ".join(base)), (101, " ".join(base) + " " + " ".join(base))]
    found = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[100] == 1 and found[101] == 101 and len({found[i] for i, _ in texts[:-1]}) == 1


def test_signatures_estimate_weighted_jaccard():
    rng, gaps = np.random.default_rng(0), []
    for _ in range(40):
        a = rng.integers(0, 9, 40)
        b = np.maximum(0, a + rng.integers(-2, 3, 40))
        h = rng.integers(1, 2**62, 40).astype(np.uint64)
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = bagminhash.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 256)
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02


def test_fingerprints(odd, none):
    rows = fingerprints.fingerprint_successors(odd).collect()
    assert len(rows) == odd.count() and fingerprints.fingerprint_successors(none).count() == 0
    by_text = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        if len(texts[r.doc_id]) == 1:
            by_text[texts[r.doc_id][0]].add(r.fingerprint)
            assert r.n_chars == len(texts[r.doc_id][0])
    assert all(len(x) == 1 for x in by_text.values())
    one, two = fingerprints.PrefixHash("abcde" * 9), fingerprints.PrefixHash("xx" + "abcde" * 8 + "!")
    assert one.common_extension(0, two, 2) == 40 and one.equal(0, one, 5, 30) and not one.equal(0, one, 1, 5)
    text, following = texts[6][0], texts[7][0]
    new = fingerprints.edited(text, following)
    assert hashlib.sha256(new.encode()).hexdigest() == next(r.edited_sha256 for r in rows if r.doc_id == 6)


def test_personal_data(spark, odd, none):
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "😀+1 (743) 555-3824 x", "9" * 40, "x@y", "001.2.3.4"]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].spans for i in (0, 1, 3, 4, 6)] == ["email:0:5,email:5:11", "ip:0:7,ip:8:15", "phone:1:18", "", "ip:0:9"]
    assert got[2].n_card == 0 and got[5].n_email == 0


def test_licenses(spark, odd, none):
    texts = ["Copyright 2020 X\n" + licenses.MIT.upper(), "words\nReleased under the  MIT licence!\nmore", "all released under the MIT License. and so on"]
    got = {(r.doc_id, r.license, r.whole, r.n_lines) for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, "MIT", True, 0), (1, "MIT", False, 1)}
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(none).count() == 0


def test_katz_sums_to_one_and_matches_counts(spark, odd, none):
    assert katz.score(odd).count() == odd.count() and katz.score(none).count() == 0
    texts = [(i, "a b a c" if i % 2 else "a b b") for i in range(40)]
    rows = katz.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    train = [t.split() + ["</s>"] for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = collections.Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    for r in rows:
        words = dict(texts)[r.doc_id].split() + ["</s>"]
        assert r.train_tokens == n and abs(r.base_score - sum(np.log10((uni[w] + 1) / (n + v + 1)) for w in words)) < 1e-9 and r.score < 0


def test_leaks_and_paraphrases(spark, odd, none):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(20)]
    docs = []
    for i in range(200):
        words = list(rng.choice(vocabulary, 300))
        if i < 40:
            piece = items[i % 20][1].split()
            for j in rng.choice(40, 6 if i >= 20 else 0, replace=False):
                piece[j] = str(rng.choice(vocabulary))
            words[100:140] = piece
        docs.append((i, " ".join(words)))
    bench = spark.createDataFrame([*items, (99, ""), (98, None)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, bench).collect()}
    want = {(i, i % 20) for i in range(40)}
    assert len(got & want) >= 0.95 * len(want) and got <= want
    assert decontam.find_leaks(odd, bench).count() == 0 and decontam.find_leaks(none, bench).count() == 0 and decontam.find_leaks(d, bench.limit(0)).count() == 0


def test_leak_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(20)]
    held = " ".join([*rng.choice(vocabulary, 60), items[0][1], *rng.choice(vocabulary, 60)])
    docs = [(i, held) for i in range(100)] + [(i, " ".join(rng.choice(vocabulary, 200))) for i in range(100, 290)]
    docs += [(i, " ".join([*rng.choice(vocabulary, 80), items[0][1], *rng.choice(vocabulary, 80)])) for i in range(290, 300)]
    d, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, bench).collect()}
    assert got == {(i, 0) for i in [*range(100), *range(290, 300)]}
    assert decontam.without_leaks(d, bench).count() == 190


def test_every_exact_copy_among_many_items(spark):
    folder, rng = "/root/testdata/sf0.01", np.random.default_rng(3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    plain = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    long = [w for _, w in plain if len(w) > 80]
    for i in range(1500):
        w, size = long[rng.integers(len(long))], int(rng.integers(15, 60))
        at = int(rng.integers(len(w) - size))
        items.append((1000 + i, b" ".join(w[at : at + size]).decode()))
    texts = [(d, b" %b " % b" ".join(w)) for d, w in plain]
    want = {(d, i) for i, t in items for p in [b" %b " % b" ".join(t.encode().lower().split())] for d, x in texts if p in x}
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 1500 and not want - got, (len(want), len(want - got))


def test_edited_leaks_beside_a_much_longer_item(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    sizes = [*rng.integers(16, 60, 60).tolist(), 600]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate(sizes)]
    docs = []
    for i, text in items:
        piece = text.split()
        piece[5::6] = rng.choice(vocabulary, len(piece[5::6])).tolist()  # no run of six words is left
        docs.append((i, " ".join([*rng.choice(vocabulary, 700), *piece, *rng.choice(vocabulary, 700)])))
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(i, i) for i, _ in items} == got
    for width, stride, some in decontam._classes(np.array(sizes)):
        assert all(width <= 1.25 * sizes[i] and stride <= max(1, sizes[i] // 4) for i in some)


def test_quality_accuracy_and_empty_labels(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.fit_quality(docs, labels.where(half))
    got = quality.score_quality(docs, model).join(labels.where(~half), "doc_id").select("keep", "quality").collect()
    assert np.mean([r.keep == (r.quality == 1) for r in got]) > 0.95
    assert quality.fit_quality(odd, labels.limit(0)) is None
    scored = quality.score_quality(odd, model)
    assert scored.count() == odd.count() and "_keep" in scored.columns and quality.score_quality(none, model).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, "/root/testdata/sf0.001").toPandas(), docs.schema)
        assert kept.columns == docs.columns
    assert 0.5 * docs.count() < kept.count() < docs.count()
    assert re.fullmatch(r"[a-z_]+", corpus_pipeline.STAGES[0][0])
