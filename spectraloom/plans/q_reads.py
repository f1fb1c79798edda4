"""Text-format, read, structure and log queries on records built from the tables."""

from pyspark.sql import functions as F

from spectraloom.functions import columns as Cx
from spectraloom.operators import reads as L
from spectraloom.operators import relational as Rel
from spectraloom.plans.registry import query
from spectraloom.sources import text as S

R = F.round


@query("parse_fasta", "R07", """
SELECT 'sp|D' || CAST(doc_id AS VARCHAR) || '|' || lang AS header, 'sp' AS db, 'D' || CAST(doc_id AS VARCHAR) AS uniprot, lang AS "uniprotName", regexp_replace(upper(regexp_replace(text, '[^A-Za-z\n]', '', 'g')), '\\s', '', 'g') AS sequence FROM documents""".replace("\\\\s", r"\s"))
def _(t):
    rec = F.concat(F.lit(">sp|D"), F.col("doc_id").cast("string"), F.lit("|"), "lang", F.lit("\n"), F.upper(F.regexp_replace("text", r"[^A-Za-z\n]", "")))
    return S.parse_fasta(t.documents.select(rec.alias("value")))


def _sam(t):
    f = F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0)
    line = F.concat_ws("\t", F.col("l_orderkey").cast("string"), f.cast("string"), F.lit("chr1"), F.col("l_partkey").cast("string"), F.lit("60"), F.lit("10M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTACGTAA"), F.lit("IIIIIIIIII"))
    return S.parse_sam(t.lineitem.select(F.col("l_returnflag").alias("file"), line.alias("value")), keep=("file",))


@query("parse_sam", "R11", """SELECT l_returnflag AS file, CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END AS flag, CAST(l_partkey AS INTEGER) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem""")
def _(t):
    return _sam(t).select("file", "flag", "pos", "strand")


@query("start_position_counts", "L02", """SELECT l_returnflag AS file, CAST(l_partkey AS INTEGER) AS pos, count(*) AS "N" FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL""")
def _(t):
    return L.start_position_counts(_sam(t))


def _reads(t):
    body = F.concat(F.lit("ACGT"), F.when(F.col("l_linenumber") % 3 == 0, L.LEADER).when(F.col("l_linenumber") % 3 == 1, "GAGAACAGATCTACAAGAGATCGAAAG").otherwise("TT"), F.lit("GGA"), F.translate(F.col("l_partkey").cast("string"), "0123456789", "ACGTACGTAC"))
    return t.lineitem.select("l_orderkey", "l_linenumber", body.alias("sequence"))


@query("trim_leader", "L01", """SELECT l_orderkey, l_linenumber, 'GGA' || translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ACGTACGTAC') AS sequence FROM lineitem WHERE l_linenumber % 3 < 2""")
def _(t):
    return L.trim_leader(L.reads_with_leader(_reads(t)), quality=None)


@query("fastq_records", "L01 R10", """SELECT l_returnflag AS file, l_orderkey * 10 + l_linenumber AS record, max('@r' || CAST(l_partkey AS VARCHAR)) AS name, 'ACGT' AS sequence FROM lineitem GROUP BY ALL""")
def _(t):
    rec = t.lineitem.select(F.col("l_returnflag").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.posexplode(F.array(F.concat(F.lit("@r"), F.col("l_partkey").cast("string")), F.lit("ACGT"), F.lit("+"), F.lit("IIII"))).alias("k", "value"))
    return L.fastq_records(rec.withColumn("i", F.col("n") * 4 + F.col("k")), "i", ["file"]).select("file", "record", "name", "sequence")


@query("position_map", "L03 S18", None)
def _(t):
    g = t.part.select(F.col("p_partkey").cast("string").alias("fasta"), F.translate(F.upper(F.concat("p_name", "p_name")), "BDEFHIJKLMNOPQRSUVWXYZ ", "ACGTACGTACGTACGTACGTACG").alias("sequence"))
    return L.position_map(g, "ACGTTGCAAGCTACGATCGACT")


_SITES = ", ".join(f"('{k}', {v})" for k, v in L.SPLICE_CENTERS.items())


@query("label_splice_sites", "L04 R52 R44", f"""
WITH c(n, c) AS (VALUES {_SITES}), s AS (SELECT l_returnflag AS file, l_partkey * 15 AS pos, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT file, CAST(pos AS BIGINT) AS pos, k AS "N", CASE WHEN pos < 29000 THEN pos + 2 END AS ref_pos, n AS splice_name FROM s LEFT JOIN c ON pos < 29000 AND pos + 2 > c - 5 AND pos + 2 < c + 5""")
def _(t):
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("file"), (F.col("l_partkey") * 15).alias("pos")).agg(F.count(F.lit(1)).alias("N"))
    g = t.lineitem.select(F.col("l_returnflag").alias("file"), F.lit("g1").alias("fasta")).distinct()
    p = t.part.select(F.lit("g1").alias("fasta"), (F.col("p_partkey") * 15).alias("other_pos"), (F.col("p_partkey") * 15 + 2).alias("ref_pos"), (F.col("p_partkey") * 15 < 29000).alias("aligned"))
    return L.label_splice_sites(s, g, p).select("file", "pos", "N", "ref_pos", "splice_name")


@query("total_reads", "L05 R42 R111", """
SELECT coalesce(a.k, b.k) AS "taskFile", a.n AS "totalReads", b.f AS "fastqFile", replace(split_part(b.f, '/', 3), '.fastq.gz', '') AS file
FROM (SELECT 't' || CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS n FROM supplier) a FULL JOIN (SELECT 't' || CAST(p_partkey AS VARCHAR) AS k, '/d/' || p_brand || '.fastq.gz' AS f FROM part) b ON a.k = b.k""")
def _(t):
    a = t.supplier.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string"), F.lit(":x")).alias("key"), F.col("s_nationkey").alias("totalReads"))
    b = t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string"), F.lit(":/d/"), "p_brand", F.lit(".fastq.gz")).alias("key"))
    return L.total_reads(a, b)


def _json(t):
    q = lambda c: F.format_string("%.2f", F.col(c) / 100)
    text = F.concat(F.lit('{"chain_pair_iptm": [[1, '), q("o_custkey"), F.lit("], ["), q("o_orderkey"), F.lit(', 1]], "iptm": 0.5, "ptm": 0.25, "ranking_score": '), q("o_custkey"), F.lit("}"))
    f = F.concat(F.lit("fold_c"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderstatus"), F.lit("_summary_confidences_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    return S.parse_pair_scores(S.parse_json_text(t.orders.select(f.alias("file"), text.alias("text")), "text", "file"))


@query("interface_scores", "L07 R08 R09 R29 R109", """SELECT 'c' || CAST(o_custkey AS VARCHAR) || '_' || o_orderstatus AS job, CAST(o_orderkey AS INTEGER) AS modelnum, 1 AS "protIdx1", 2 AS "protIdx2", round(o_custkey / 100.0, 4) AS "pairIptm", 'c' || CAST(o_custkey AS VARCHAR) AS prot1, o_orderstatus AS prot2 FROM orders""")
def _(t):
    return _json(t).select("job", "modelnum", "protIdx1", "protIdx2", R("pairIptm", 4).alias("pairIptm"), "prot1", "prot2")


@query("mean_pair_scores", "L08 R73", """SELECT 'c' || CAST(o_custkey AS VARCHAR) || '_' || o_orderstatus AS job, CAST(o_orderkey AS INTEGER) AS modelnum, round(avg(o_custkey / 100.0) OVER (PARTITION BY o_custkey, o_orderstatus), 4) AS mean FROM orders""")
def _(t):
    return L.mean_pair_scores(_json(t)).select("job", "modelnum", R("meanPairIptm", 4).alias("mean"))


def _log(t):
    d = t.orders.select(F.concat(F.lit("/x/af-"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("log"), "o_orderkey", "o_totalprice", "o_orderstatus")
    msgs = F.array(
        F.concat(F.lit("Using random seed "), F.col("o_orderkey").cast("string"), F.lit(" for the data")),
        F.concat(F.lit("Running monomer pipeline on chain A: "), "o_orderstatus"), F.lit("Uniref90 MSA size: 12 sequences."), F.lit("Total number of templates (x): 4."),
        F.concat(F.lit("Running monomer pipeline on chain B: "), F.lit("Z")), F.lit("Uniref90 MSA size: 7 sequences."), F.lit("Total number of templates (x): 20."),
        F.lit("Running model model_1 on pairX"),
        F.concat(F.lit("Total JAX model model_1 on pairX predict time (includes compilation time, see --benchmark): "), F.format_string("%.1f", "o_totalprice"), F.lit("s")),
    )
    lines = d.select("log", F.posexplode(msgs).alias("i", "m")).select("i", F.concat("log", F.lit(".log:I0101 run.py:1] "), "m").alias("value"))
    return L.job_log_table(S.parse_log_lines(lines), "i", ["A", "B"], ["Uniref90_MSA"])


@query("job_log_table", "L06 R10 R81 R74", """SELECT o_custkey AS "jobID", CAST(o_orderkey AS INTEGER) AS "taskID", CAST(o_orderkey AS VARCHAR) AS seed, o_orderstatus AS "A", 'Z' AS "B", 12 AS "Uniref90_MSA_A", 7 AS "Uniref90_MSA_B", 4 AS "templates_A", 20 AS "templates_B", 'model_1' AS model, 'pairX' AS pair, round(o_totalprice, 1) AS "predictTime" FROM orders""".replace("o_custkey AS", "CAST(o_custkey AS INTEGER) AS"))
def _(t):
    return _log(t).drop("logBaseName")


def _atoms(t):
    v = lambda m: F.format_string("%8.3f", F.pmod(F.xxhash64("p_partkey", F.lit(m)), F.lit(20000)) / 1000)
    line = F.concat(F.lit("ATOM  "), F.format_string("%5d", F.col("p_partkey") % 90000), F.lit("  CA  GLY "), F.when(F.col("p_size") > 25, "A").otherwise("B"), F.format_string("%4d", "p_size"), F.lit("    "), v(1), v(2), v(3), F.lit("  1.00 50.00           C"))
    return S.parse_pdb(t.part.select(F.col("p_brand").alias("file"), line.alias("value")), keep=("file",))


@query("residue_contacts", "W19 R12 R54", None)
def _(t):
    return L.residue_contacts(_atoms(t))


# --- relational idioms ----------------------------------------------------------

@query("range_join", "R52", """SELECT e.event_id, n_nationkey FROM events e JOIN nation ON value > n_nationkey * 3 AND value < n_nationkey * 3 + 7""")
def _(t):
    i = t.nation.select("n_nationkey", (F.col("n_nationkey") * 3).alias("lo"), (F.col("n_nationkey") * 3 + 7).alias("hi"))
    return Rel.range_join(t.events.select("event_id", "value"), i, "value", "lo", "hi", 7, inclusive=False).select("event_id", "n_nationkey")


@query("nearest_join", "R53", """
WITH a AS (SELECT event_id, user_id, floor(epoch(ts) / 60) AS m FROM events WHERE event_type = 'click'), b AS (SELECT event_id, user_id, floor(epoch(ts) / 60) AS m FROM events WHERE event_type <> 'click')
SELECT a.event_id, arg_min(b.event_id, (abs(a.m - b.m), b.m, b.event_id)) AS nearest FROM a LEFT JOIN b USING (user_id) GROUP BY a.event_id""")
def _(t):
    e = t.events.select("event_id", "user_id", "event_type", F.floor(F.unix_timestamp("ts") / 60).cast("double").alias("m"))
    b = e.where(F.col("event_type") != "click").select("user_id", "m", F.col("event_id").alias("nearest"))
    return Rel.nearest_join(e.where(F.col("event_type") == "click").select("event_id", "user_id", "m"), b, ["user_id"], "m", ["nearest"], 3000, "nearest").select("event_id", "nearest")


@query("distance_join", "R54", """SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a JOIN customer b ON sqrt(pow(s_acctbal - c_acctbal, 2) + pow((s_nationkey - c_nationkey) * 100, 2)) <= 300""")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100).cast("double").alias("y"))
    b = t.customer.select(F.col("c_custkey").alias("b"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100).cast("double").alias("y"))
    return Rel.distance_join(a, b, ["x", "y"], 300).select("a", "b")


@query("first_match_lookup", "R43 R45 R71", """SELECT o_orderkey, m.p AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS p FROM lineitem GROUP BY ALL) m ON o_orderkey = l_orderkey""")
def _(t):
    d = Cx.first_match_lookup(t.orders.select("o_orderkey"), ["o_orderkey"], t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], ["l_partkey"])
    return d.select("o_orderkey", F.col("l_partkey").alias("first_part"))


@query("group_scalar", "R73 R60", """SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_suppkey) AS top, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem""")
def _(t):
    return Cx.group_scalar(t.lineitem, ["l_suppkey"], top=F.max("l_quantity"), n=F.count(F.lit(1))).select("l_orderkey", "l_linenumber", "top", "n")


@query("exact_quantiles", "R62 R63", """
WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.3) AS q, median(l_extendedprice) AS med FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(any_value(q), 6) AS q30, round(any_value(med), 6) AS med, round(1.4826 * median(abs(l_extendedprice - med)), 6) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL""")
def _(t):
    from spectraloom.functions.ordered import exact_quantile, mad

    q = exact_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.3, "q30", stable=True)
    d = q.join(mad(t.lineitem, ["l_returnflag"], "l_extendedprice", "mad", "med", stable=True), "l_returnflag")
    return d.select("l_returnflag", *[R(c, 6).alias(c) for c in ("q30", "med", "mad")])


@query("ranks", "R80 R87", """SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS BIGINT) AS lo, CAST(rank() OVER w + count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1 AS BIGINT) AS hi FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_discount DESC)""")
def _(t):
    from spectraloom.functions.ordered import rank_table

    r = rank_table(t.lineitem, ["l_returnflag"], "l_discount", descending=True)
    return t.lineitem.join(r, ["l_returnflag", "l_discount"]).select("l_orderkey", "l_linenumber", F.col("rank_min").alias("lo"), F.col("rank_max").alias("hi"))


@query("running_totals_in_buckets", "R81", """WITH d AS (SELECT l_returnflag, l_extendedprice AS p, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, p, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY p) AS BIGINT) AS upto FROM d""")
def _(t):
    from spectraloom.functions.ordered import running_totals

    d = t.lineitem.groupBy("l_returnflag", F.col("l_extendedprice").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(d, ["l_returnflag"], "p", sums=["n"], buckets=16).select("l_returnflag", "p", F.col("n_run").alias("upto"))


@query("ecdf", "R94", """SELECT l_orderkey, l_linenumber, round((SELECT count(*) FROM customer WHERE round(c_acctbal / 1000, 1) <= round(l_quantity / 5, 1)) / (SELECT CAST(count(*) AS DOUBLE) FROM customer), 9) AS share FROM lineitem""")
def _(t):
    from spectraloom.functions.ordered import ecdf

    q = t.lineitem.select("l_orderkey", "l_linenumber", R(F.col("l_quantity") / 5, 1).alias("v"))
    return ecdf(t.customer.select(R(F.col("c_acctbal") / 1000, 1).alias("v")), q, [], "v", "share").select("l_orderkey", "l_linenumber", R("share", 9).alias("share"))
