"""Readers and writers on small files."""

import json
import zipfile

from pyspark.sql import functions as F

from spectraloom.operators import reads
from spectraloom.sources import text as S
from spectraloom.streaming.joblog import stream_log_lines


def test_delimited_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    S.write_delimited(d, str(tmp_path / "t"), compression="gzip")
    back = S.read_delimited(spark, str(tmp_path / "t"), "k string, v int", file_column="file")
    assert {(r["k"], r["v"]) for r in back.collect()} == {("a", 1), ("b", None)} and back.first()["file"].endswith(".csv.gz")
    assert S.table_or_path(spark, d) is d


def test_headerless_and_skipped_preamble(spark, tmp_path):
    (tmp_path / "a.txt").write_text("r1\tb1\tT\nr2\tb2\tC\n")
    assert S.read_named(spark, str(tmp_path / "a.txt"), "run string, bait string, treatment string").count() == 2
    (tmp_path / "b.txt").write_text("made today\n\nA\tB\tC\n1\t2\t3\n4\t5\n")
    got = S.read_skipping(spark, str(tmp_path / "b.txt"), 2, ["A", "B", "C"]).orderBy("A").collect()
    assert [tuple(r) for r in got] == [("1", "2", "3"), ("4", "5", None)]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">sp|P1|ONE_HUMAN words\nMKT\nAAS\n>plain\nGGG\n>a;b\nTT\n")
    got = {r["uniprot"]: r for r in S.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert got["P1"]["sequence"] == "MKTAAS" and got["P1"]["uniprotName"] == "ONE_HUMAN" and set(got) == {"P1", "plain", "a", "b"}


def test_snapshot_prunes_partitions(spark, tmp_path):
    d = spark.createDataFrame([("P1", "Gene_Name", "G"), ("P1", "GeneID", "7")], "uniprot string, idType string, id string")
    S.write_snapshot(d, str(tmp_path / "m"), "idType")
    q = S.snapshot(spark, str(tmp_path / "m")).where(F.col("idType") == "GeneID")
    assert q.count() == 1 and "PartitionFilters: [isnotnull(idType" in q._jdf.queryExecution().executedPlan().toString()


RESULT = {"chain_pair_iptm": [[0.9, 0.3, 0.2], [0.3, 0.8, 0.1], [0.2, 0.1, 0.7]], "iptm": 0.5, "ptm": 0.6, "ranking_score": 0.55}


def test_json_results_and_archive(spark, tmp_path):
    name = "fold_a_b_c_summary_confidences_0.json"
    (tmp_path / name).write_text(json.dumps(RESULT))
    one = S.read_pair_scores(spark, str(tmp_path / name)).collect()
    assert {(r["prot1"], r["prot2"], r["pairIptm"]) for r in one} == {("a", "b", 0.3), ("a", "c", 0.2), ("b", "c", 0.1)}
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr(name, json.dumps(RESULT))
        z.writestr("other.json", "{}")
    assert S.read_pair_scores_archive(spark, str(tmp_path / "r.zip")).count() == 3


def test_sam_and_contacts(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + "\t".join(["q1", "0", "c", "12", "60", "3M", "*", "0", "0", "ACG", "III"]) + "\n" + "\t".join(["q2", "16", "c", "12", "60", "3M", "*", "0", "0", "ACG", "III"]) + "\n")
    s = S.read_sam(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in reads.start_position_counts(s).collect()] == [("a.sam", 12, 1)]
    atom = lambda i, chain, res, x: f"ATOM  {i:5d}  CA  GLY {chain}{res:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00 50.00           C  "
    lines = spark.createDataFrame([("f", atom(1, "A", 1, 0.0)), ("f", atom(2, "A", 2, 9.0)), ("f", atom(3, "B", 1, 3.5))], "file string, value string")
    got = reads.residue_contacts(S.parse_pdb(lines, keep=("file",))).collect()
    assert [(r["chainRow"], r["resnoRow"], r["chainCol"], r["resnoCol"], r["mmerResnoCol"]) for r in got] == [("A", 1, "B", 1, 3)]


def test_leader(spark):
    back = reads.LEADER[::-1].translate(str.maketrans("ACGT", "TGCA"))
    d = spark.createDataFrame([("AA" + reads.LEADER + "GGT", "I" * 32), ("C" + back + "TTT", "J" * 31), ("ACGT", "KKKK")], "sequence string, quality string")
    got = reads.trim_leader(reads.reads_with_leader(d)).collect()
    assert {(r["sequence"], r["quality"]) for r in got} == {("GGT", "III"), ("TTT", "JJJ")}


def test_log_lines_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.txt").write_text("/x/af-7-2.log:I01 run.py:1] Using random seed 99 for data\n")
    q = stream_log_lines(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("loglines").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("select * from loglines").first()
    assert (r["jobID"], r["taskID"], r["message"]) == (7, 2, "Using random seed 99 for data")
