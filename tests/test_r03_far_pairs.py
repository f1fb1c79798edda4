"""Decoys and pairs at sizes that the tables of round 3 reached."""

import pyarrow as pa

from spectraloom.llm import bagminhash, common
from spectraloom.operators import graph


def test_complexes_larger_than_the_far_genes_get_decoys(spark):
    # two genes are known to be far apart; complexes of two, three and five genes, and one alone
    members = [("a", g) for g in ("g1", "g2")] + [("b", g) for g in ("g1", "g3", "g4")] + [("c", f"g{i}") for i in range(5, 10)] + [("d", "g1"), ("a", None)]
    complexes = spark.createDataFrame(members, "complex_id string, gene string")
    near = [(f"g{i}", f"g{j}", 1) for i in range(1, 9) for j in range(i + 1, 9) if i % 2 == j % 2 == 0]
    distances = spark.createDataFrame([("x", "y", 4), *near], "gene1 string, gene2 string, hops int")
    named = complexes.selectExpr("complex_id", "complex_id as complex_name", "gene", "concat('p', gene) as protein")
    rows = [r for r in graph.targets_and_decoys(named, distances, retries=40).collect() if r.decoy]
    drawn = {c: [r.gene for r in rows if r.complex_id == c] for c in ("decoy_a", "decoy_b", "decoy_c")}
    assert len(rows) == 10 and set(drawn["decoy_a"]) == {"x", "y"}
    assert all(len(set(g)) == len(g) == n and None not in g for g, n in zip(drawn.values(), (2, 3, 5)))
    assert all(r.complex_size == len(drawn[r.complex_id]) for r in rows)
    # near pairs of the wider pool are not taken
    assert not any((a, b, 1) in near for g in drawn.values() for a in g for b in g)


def test_slices_of_pairs_are_bounded_by_both_texts():
    rows = pa.record_batch([pa.array(["a b"] * 8), pa.array(["c" * 1000] * 7 + [None])], names=["text", "other"])
    assert [x.num_rows for x in common.chunks([rows], 2200, ("text", "other"))] == [2, 2, 2, 2]
    assert [x.num_rows for x in common.chunks([rows], 2200)] == [8]


def test_words_are_counted_with_the_signatures():
    rows = pa.record_batch([pa.array([1, 2, 3]), pa.array([b"x", b"y", b"z"]), pa.array(["a b  c d e f", "", "g\th"])], names=["doc_id", "digest", "text"])
    (got,) = bagminhash._signed(iter([rows]))
    assert got.column("words").to_pylist() == [6, 0, 2]


def test_texts_of_too_different_sizes_are_not_compared(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g", 7), (2, "a b c d e f g h", 8), (3, "a b c d", 4), (4, "x " * 40, 40), (5, "a b c d e f g", 7)], "node long, text string, words long")
    pairs = spark.createDataFrame([(2, 1), (5, 1), (4, 1), (3, 1), (4, 3)], "src long, dst long")
    assert {tuple(r) for r in bagminhash._verified(pairs, texts, 0.7, 5).collect()} == {(2, 1), (5, 1)}
