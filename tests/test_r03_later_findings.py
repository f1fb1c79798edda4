"""Steps that the check tool or a projection of round 3 named, after its first passes."""

from types import SimpleNamespace

import __spark_entry__ as entry
from spectraloom.llm import tokens
from spectraloom.operators import sites
from spectraloom.plans import q_sites, registry, shapes


def test_a_full_store_keeps_the_pieces_that_came_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 400)
    monkeypatch.setattr(tokens, "NEW_PIECES", 50, raising=False)
    e = tokens.Encoder(tokens.default_path())
    library, asked = e.tokenizer, []

    def encode_batch_fast(texts, **given):
        asked.append(len(texts))
        return library.encode_batch_fast(texts, **given)

    e.tokenizer = SimpleNamespace(encode_batch_fast=encode_batch_fast, encode=library.encode)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + "q" for a in letters for b in letters]
    often, rare, more = (" ".join(x) for x in (words[:40], words[40:390], words[390:500]))
    for text in (often, often, rare, more, often):
        before = sum(asked)
        assert e.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    # what came again was still there when the store had been full, and the library gets few pieces at a time
    assert sum(asked) == before and max(asked) <= 50
    assert len(e.keys) <= 400 and (e.keys[1:] > e.keys[:-1]).all()


def test_positions_of_many_alignments_at_once(spark, monkeypatch):
    monkeypatch.setattr(sites, "POSITION_LETTERS", 20)
    rows = [(i, "AS-TY\U0001F600S"[: i % 8], "-SAT-YSXX"[: i % 10]) for i in range(60)] + [(60, None, "S"), (61, "S", None), (None, "SS", "T")]
    d = spark.createDataFrame(rows, "k long, aligned_from string, aligned_to string").coalesce(2)
    for residues in ("STY", None):
        want = []
        for k, a, b in rows:
            if a is None or b is None:
                continue
            b = b[: len(a)].ljust(len(a), "-")
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if residues is None or x in residues or y in residues:
                    want.append((k, x, len(a[: i + 1].replace("-", "")), y, len(b[: i + 1].replace("-", ""))))
        got = sites.aligned_position_map(d, ["k"], residues)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sites.aligned_position_map(d.where("k > 99"), ["k"]).count() == 0


def test_sites_are_packed_from_distinct_map_rows(spark, monkeypatch):
    part = spark.createDataFrame([(i * 60, "B", 5, "X") for i in range(1, 9)] + [(7, "B", 5, "X"), (8, "C", 5, "X")], "p_partkey long, p_brand string, p_size int, p_type string")
    results = spark.createDataFrame([("B_S5;B_T9",), ("C_S5",), ("D_S1",)], "Protein string")
    given, step = [], sites.sites_to_other_species
    run = entry.registry()["pack_sites_per_protein"].run
    monkeypatch.setattr(registry, "Tables", lambda *_: SimpleNamespace(part=part))
    monkeypatch.setattr(shapes, "site_results", lambda _: results)
    monkeypatch.setattr(q_sites.S, "sites_to_other_species", lambda *a: given.append(step(*a)) or given[-1])
    got = {(r.Protein, r.human_uniprot): r.human for r in run(spark, "").collect()}
    assert got == {("B_S5;B_T9", "H0"): "H0_T6", ("B_S5;B_T9", "H7"): "H7_T6", ("B_S5;B_T9", None): None, ("C_S5", "H8"): "H8_T6", ("D_S1", None): None}
    # two sites of B, one of them with two mapped ones, however often the map has them
    assert given[0].count() == 5
