"""Ingestion, contrast, run-comparison and normalization queries."""

from pyspark.sql import functions as F

from spectraloom.operators import ingest as C
from spectraloom.operators import normalize as N
from spectraloom.plans import shapes
from spectraloom.plans.registry import query

R = F.round


_C01 = """
, j AS (SELECT e.*, k."IsotopeLabelType", k."Condition", k."BioReplicate" FROM evidence e JOIN keys k ON e."Raw file" = k.RawFile WHERE NOT regexp_matches(Proteins, '^$|CON__|REV__{extra}') AND Intensity > 0),
s AS (SELECT Proteins, "Modified sequence" AS seq, Charge, "IsotopeLabelType" AS l, "Condition" AS c, "BioReplicate" AS b, "Raw file" AS r, sum(Intensity) AS i FROM j GROUP BY ALL),
u AS (SELECT * FROM s WHERE seq NOT IN (SELECT seq FROM s GROUP BY seq HAVING count(DISTINCT Proteins) > 1))
SELECT p.Proteins AS "ProteinName", p.seq AS "PeptideSequence", p.Charge AS "PrecursorCharge", r.l AS "IsotopeLabelType", r.c AS "Condition", r.b AS "BioReplicate", r.r AS "Run", round(u.i, 4) AS "Intensity"
FROM (SELECT DISTINCT Proteins, seq, Charge FROM u) p CROSS JOIN (SELECT DISTINCT l, c, b, r FROM u) r LEFT JOIN u ON u.Proteins = p.Proteins AND u.seq = p.seq AND u.Charge = p.Charge AND u.r = r.r"""


@query("prepare_msstats", "C01 R23 R47 R51 R60", shapes.with_("evidence", "keys", body=_C01.format(extra="")))
def _(t):
    return C.prepare_msstats(shapes.evidence(t), shapes.keys(t)).drop("FragmentIon", "ProductCharge").withColumn("Intensity", R("Intensity", 4))


@query("prepare_msstats_single_proteins", "C01", shapes.with_("evidence", "keys", body=_C01.format(extra="|;")))
def _(t):
    return C.prepare_msstats(shapes.evidence(t), shapes.keys(t), keep_groups=False).drop("FragmentIon", "ProductCharge").withColumn("Intensity", R("Intensity", 4))


shapes.cte("ion_runs", """SELECT "ProteinName", "PeptideSequence", "PrecursorCharge", "Condition", "BioReplicate", "Run", max("Intensity") AS "Intensity" FROM
   (SELECT ProteinName AS "ProteinName", PeptideSequence AS "PeptideSequence", PrecursorCharge AS "PrecursorCharge", Condition AS "Condition", BioReplicate AS "BioReplicate", Run AS "Run", Intensity AS "Intensity" FROM msstats) GROUP BY ALL""", "msstats")


def ion_runs(t):
    return shapes.msstats(t).groupBy("ProteinName", "PeptideSequence", "PrecursorCharge", "Condition", "BioReplicate", "Run").agg(F.max("Intensity").alias("Intensity"))


@query("complete_table", "C02 R47 R41", shapes.with_("ion_runs", body="""
SELECT p."ProteinName", p."PeptideSequence", p."PrecursorCharge", r."Condition", r."Run", r."BioReplicate", u."Intensity"
FROM (SELECT DISTINCT "ProteinName", "PeptideSequence", "PrecursorCharge" FROM ion_runs) p CROSS JOIN (SELECT DISTINCT "Condition", "Run", "BioReplicate" FROM ion_runs) r
LEFT JOIN ion_runs u ON u."ProteinName" = p."ProteinName" AND u."PeptideSequence" = p."PeptideSequence" AND u."PrecursorCharge" = p."PrecursorCharge" AND u."Run" = r."Run" """))
def _(t):
    return C.complete_table(ion_runs(t))


shapes.cte("sn", """SELECT '2' || l_returnflag || '-' || l_linestatus AS cond, CAST(l_suppkey % 3 AS VARCHAR) AS rep, l_returnflag || l_linestatus || CAST(l_suppkey % 3 AS VARCHAR) AS run, p_brand AS prot,
   upper(replace(p_name, ' ', 'R')) AS seq, p_size > 25 AS ox, l_linenumber AS z, l_extendedprice AS i FROM lineitem JOIN part ON l_partkey = p_partkey""")


def _sn(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("2"), "l_returnflag", F.lit("-"), "l_linestatus").alias("Condition"), (F.col("l_suppkey") % 3).cast("string").alias("BioReplicate"),
        F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 3).cast("string")).alias("Run"), F.col("p_brand").alias("ProteinName"),
        F.concat(F.lit("_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("R"))), F.when(F.col("p_size") > 25, "M[Oxidation (M)]_").otherwise("S[Phospho (STY)]_")).alias("PeptideSequence"),
        F.col("l_linenumber").alias("PrecursorCharge"), F.col("l_extendedprice").alias("Intensity"),
    )


@query("spectronaut_to_evidence", "C03 R106 R26", shapes.with_("sn", body="""
SELECT run AS "RawFile", prot AS "Proteins", '_' || seq || CASE WHEN ox THEN 'M(ox)_' ELSE 'S(ph)_' END AS "Modified_sequence", z AS "Charge", i AS "Intensity", seq || CASE WHEN ox THEN 'M' ELSE 'S' END AS sequence,
  CASE WHEN ox THEN 1 ELSE 0 END AS oxidation_m, CAST(length('_' || seq || CASE WHEN ox THEN 'M[Oxidation (M)]_' ELSE 'S[Phospho (STY)]_' END) * 100 / CAST(z AS DOUBLE) AS DOUBLE) AS m_z FROM sn"""))
def _(t):
    e = C.spectronaut_to_evidence(_sn(t))[0]
    return e.select("RawFile", "Proteins", "Modified_sequence", "Charge", "Intensity", "sequence", "oxidation_m", "m_z")


@query("spectronaut_keys", "C03 C05 R34", shapes.with_("sn", body="""
SELECT c AS "Condition", run AS "RawFile", c || '.' || rep AS "BioReplicate", 'L' AS "IsotopeLabelType", CAST(row_number() OVER (ORDER BY run) AS INTEGER) AS "Run"
FROM (SELECT DISTINCT 'x.' || replace(cond, '-', '_') AS c, rep, run FROM sn)"""))
def _(t):
    return C.spectronaut_to_evidence(_sn(t))[1]


@query("maxquant_to_evidence", "C04", shapes.with_("keys", body="""
SELECT 'x.2' || "Condition" AS "Condition", RawFile AS "RawFile", 'x.2' || "Condition" || '.' || "BioReplicate" AS "BioReplicate" FROM keys"""))
def _(t):
    k = shapes.keys(t).withColumn("Condition", F.concat(F.lit("2"), "Condition"))
    return C.maxquant_to_evidence(shapes.evidence(t), k)[1].select("Condition", "RawFile", "BioReplicate")


@query("fix_condition_names", "C05 R103", shapes.with_("sn", body="SELECT DISTINCT cond, 'x.' || replace(cond, '-', '_') AS fixed FROM sn"))
def _(t):
    return _sn(t).select(F.col("Condition").alias("cond")).distinct().withColumn("fixed", C.fix_condition_names("cond"))


@query("contrasts_all_pairs", "C06 R48", shapes.with_("keys", body="""
SELECT DISTINCT a."Condition" AS positive, b."Condition" AS negative, a."Condition" || '-' || b."Condition" AS name FROM keys a, keys b WHERE a."Condition" > b."Condition" """))
def _(t):
    return C.contrasts_all_pairs(shapes.keys(t), "Condition")


@query("contrasts_by_regex", "C07", shapes.with_("keys", body="""
SELECT DISTINCT a."Condition" AS positive, b."Condition" AS negative, a."Condition" || '-' || b."Condition" AS name FROM keys a, keys b
WHERE a."Condition" <> b."Condition" AND (a."Condition"[1] = b."Condition"[1] OR (a."Condition"[1] = 'A' AND b."Condition"[1] = 'R')) """))
def _(t):
    return C.contrasts_by_regex(shapes.keys(t), "Condition", [r"^(.).-\1.$", "^A.-R"])


@query("contrast_matrix", "C08", shapes.with_("keys", body="""
, c AS (SELECT DISTINCT "Condition" AS c FROM keys)
SELECT a.c || '-' || b.c AS name, g.c AS "group", CASE WHEN g.c = a.c THEN 1 WHEN g.c = b.c THEN -1 ELSE 0 END AS weight FROM c a, c b, c g WHERE a.c < b.c"""))
def _(t):
    k = shapes.keys(t)
    return C.contrast_matrix(C.contrasts_all_pairs(k, "Condition", larger_first=False), k.select("Condition"))


@query("apply_contrasts", "C09", shapes.with_("run_level", body="""
, m AS (SELECT Protein, GROUP_ORIGINAL AS g, avg(LogIntensities) AS v FROM run_level GROUP BY ALL)
SELECT a.Protein AS "Protein", a.g || '-' || b.g AS name, round(a.v - b.v, 7) AS "log2FC" FROM m a JOIN m b ON a.Protein = b.Protein AND a.g > b.g"""))
def _(t):
    means = shapes.run_level(t).groupBy("Protein", "GROUP_ORIGINAL").agg(F.avg("LogIntensities").alias("v"))
    d = C.apply_contrasts(means, C.contrasts_all_pairs(shapes.keys(t), "Condition"), ["Protein"], "GROUP_ORIGINAL", "v")
    return d.withColumn("log2FC", R("log2FC", 7))


@query("ptm_probability_filter", "C10 R67 R69", """
WITH d AS (SELECT p_brand AS "ProteinName", p_type AS "PeptideSequence", p_size AS "PrecursorCharge", l_orderkey, l_linenumber, 0.6 + l_discount * 3 AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT * EXCLUDE (p) FROM d WINDOW w AS (PARTITION BY "ProteinName", "PeptideSequence", "PrecursorCharge") QUALIFY p > 0.75 OR (count(*) FILTER (p > 0.75) OVER w > count(*) OVER w / 2.0 AND count(*) OVER w > 10)""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ProteinName"), F.col("p_type").alias("PeptideSequence"), F.col("p_size").alias("PrecursorCharge"), "l_orderkey", "l_linenumber", (0.6 + F.col("l_discount") * 3).alias("p")
    )
    return C.ptm_probability_filter(d, "p").select("ProteinName", "PeptideSequence", "PrecursorCharge", "l_orderkey", "l_linenumber")


_TIMS = """WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey AS id, upper(replace(p_name, ' ', 'M')) || 'MM' AS seq, CASE WHEN l_linenumber % 2 = 0 THEN '2 Oxidation (M)' ELSE 'Acetyl (Protein N-term),Oxidation (M)' END AS mods,
   CASE WHEN p_size > 10 AND l_linenumber < 3 THEN '_' || p_name || CASE WHEN l_quantity > 30 THEN 'a' ELSE 'b' END || '_' ELSE '' END AS ms FROM lineitem JOIN part ON l_partkey = p_partkey),
 b AS (SELECT id, ms AS best FROM (SELECT id, ms, count(*) AS n FROM d WHERE ms <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, ms) = 1)"""


@query("repair_modified_sequence", "C11 R71 R110", _TIMS + """
, g AS (SELECT *, string_split(seq, 'M') AS p, CASE WHEN mods LIKE '2%' THEN 2 ELSE 1 END AS k FROM d)
SELECT l_orderkey, l_linenumber, CASE WHEN ms <> '' THEN ms ELSE coalesce(best, '_' || CASE WHEN k = 1 THEN '(ac)' ELSE '' END || array_to_string(p[1:k + 1], 'M(ox)')
   || CASE WHEN len(p) > k + 1 THEN 'M' || array_to_string(p[k + 2:], 'M') ELSE '' END || '_') END AS modified FROM g LEFT JOIN b USING (id)""")
def _(t):
    even = F.col("l_linenumber") % 2 == 0
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("Mod. peptide ID"), F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("M"))), F.lit("MM")).alias("Sequence"),
        F.when(even, "2 Oxidation (M)").otherwise("Acetyl (Protein N-term),Oxidation (M)").alias("Modifications"),
        F.when((F.col("p_size") > 10) & (F.col("l_linenumber") < 3), F.concat(F.lit("_"), "p_name", F.when(F.col("l_quantity") > 30, "a_").otherwise("b_"))).otherwise("").alias("Modified sequence"),
    )
    return C.repair_modified_sequence(d).select("l_orderkey", "l_linenumber", F.col("`Modified sequence`").alias("modified"))


@query("fragpipe_add_keys", "C12 R45", """
SELECT l_orderkey, l_linenumber, l_returnflag AS "Run", m.seg AS "Condition", m.rep AS "BioReplicate" FROM lineitem LEFT JOIN
  (SELECT substr(c_mktsegment, 1, 1) AS r, min(c_mktsegment) AS seg, arg_min(c_nationkey, (c_mktsegment, c_nationkey)) AS rep FROM customer GROUP BY ALL) m ON l_returnflag = r WHERE l_discount > 0""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("Condition"), F.lit("x").alias("BioReplicate"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("Intensity"))
    k = t.customer.select(F.substring("c_mktsegment", 1, 1).alias("Run"), F.col("c_mktsegment").alias("Condition"), F.col("c_nationkey").alias("BioReplicate"))
    return C.fragpipe_add_keys(d, k).select("l_orderkey", "l_linenumber", "Run", "Condition", "BioReplicate")


@query("no_ties_in_ptm_probabilities", "C13", """
WITH d AS (SELECT l_orderkey, l_linenumber, [round(l_discount, 2), round(l_tax, 2), round(l_quantity / 50, 2)] AS p, 1 + l_linenumber % 2 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, len(list_filter(p, lambda x: len(list_filter(p, lambda y: y > x)) + 1 <= n)) = n AS clear FROM d""")
def _(t):
    text = F.format_string("AK(%.2f)CDK(%.2f)K(%.2f)R", "l_discount", "l_tax", F.round(F.col("l_quantity") / 50, 2))
    d = t.lineitem.select("l_orderkey", "l_linenumber", text.alias("probs"), (1 + F.col("l_linenumber") % 2).alias("n"))
    return d.select("l_orderkey", "l_linenumber", C.no_ties_in_ptm_probabilities("probs", "n").alias("clear"))


@query("complete_standard_features", "C14", shapes.with_("evidence", body="""
, s AS (SELECT Proteins, "Modified sequence" AS m FROM evidence WHERE Proteins IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY ALL HAVING count(DISTINCT "Raw file") = (SELECT count(DISTINCT "Raw file") FROM evidence))
SELECT e."Raw file" AS run, e.Proteins AS protein, e."Modified sequence" AS m FROM evidence e WHERE e.Proteins NOT IN ('Brand#1', 'Brand#2', 'Brand#3') OR e."Modified sequence" IN (SELECT m FROM s WHERE s.Proteins = e.Proteins)"""))
def _(t):
    ev = shapes.evidence(t).withColumn("Charge", F.lit(2))
    d = C.complete_standard_features(ev, ["Brand#1", "Brand#2", "Brand#3"])
    return d.select(F.col("`Raw file`").alias("run"), F.col("Proteins").alias("protein"), F.col("`Modified sequence`").alias("m"))


_CODES = """, s AS (SELECT * FROM run_level WHERE GROUP_ORIGINAL IN ('AF', 'NO', 'RF')),
 x AS (SELECT Protein AS "Protein", LogIntensities, GROUP_ORIGINAL AS g, SUBJECT_ORIGINAL AS s, CAST(dense_rank() OVER (ORDER BY GROUP_ORIGINAL) AS INTEGER) AS "GROUP", CAST(dense_rank() OVER (ORDER BY SUBJECT_ORIGINAL) AS INTEGER) AS "SUBJECT", CAST(dense_rank() OVER (ORDER BY RUN) AS INTEGER) AS "RUN" FROM s)"""


@query("subset_run_level", "C15 R33 R50", shapes.with_("run_level", body=_CODES + """ SELECT "Protein", round(LogIntensities, 6) AS v, "GROUP", "SUBJECT", "RUN", CAST("GROUP" AS VARCHAR) || '.' || CAST("SUBJECT" AS VARCHAR) AS "SUBJECT_NESTED" FROM x"""))
def _(t):
    d = C.subset_run_level(shapes.run_level(t), groups=["AF", "NO", "RF"])
    return d.select("Protein", R("LogIntensities", 6).alias("v"), "GROUP", "SUBJECT", "RUN", "SUBJECT_NESTED")


@query("load_processed", "C16", shapes.with_("msstats", body="""SELECT ProteinName AS "PROTEIN", Condition AS "GROUP_ORIGINAL", Intensity AS "INTENSITY" FROM msstats WHERE Condition IN ('AF', 'NO')"""))
def _(t):
    n = shapes.msstats(t).select(F.col("ProteinName").alias("PROTEIN"), F.col("Condition").alias("GROUP_ORIGINAL"), F.col("Intensity").alias("INTENSITY"))
    return C.load_processed(n, shapes.run_level(t), ["AF", "NO"])[0]


@query("batch_subjects", "C17 R102", shapes.with_("run_level", body="""
SELECT Protein AS "Protein", RUN AS run, 'batch.' || split_part(SUBJECT_ORIGINAL, '.', 2) AS "SUBJECT_ORIGINAL", CAST(dense_rank() OVER (ORDER BY split_part(SUBJECT_ORIGINAL, '.', 2)) AS INTEGER) AS "SUBJECT" FROM run_level"""))
def _(t):
    d = C.batch_subjects(C.subset_run_level(shapes.run_level(t)))
    return d.select("Protein", F.col("originalRUN").alias("run"), "SUBJECT_ORIGINAL", "SUBJECT")


shapes.cte("simple", """SELECT Proteins || '_' || "Modified sequence" || '_' || CAST(Charge AS VARCHAR) AS f, "Raw file" AS r, max(log2(CASE WHEN Intensity > 0 THEN Intensity END)) AS v FROM evidence
   WHERE NOT regexp_matches(Proteins, '(^CON)|(^REV)') GROUP BY ALL""", "evidence")


def _simple(t):
    return C.simplify_evidence(shapes.evidence(t).withColumnRenamed("Proteins", "Leading razor protein"))


@query("simplify_evidence", "C18", shapes.with_("simple", body='SELECT f AS "featureID", r AS "runID", round(v, 7) AS v FROM simple'))
def _(t):
    return _simple(t).select("featureID", "runID", R("log2Intensity", 7).alias("v"))


@query("simplify_spectronaut", "C18", shapes.with_("sn", body="""SELECT prot || '__' || seq || CASE WHEN ox THEN 'M[Oxidation (M)]_' ELSE 'S[Phospho (STY)]_' END || '_' || CAST(z AS VARCHAR) AS "featureID", cond || '_' || rep AS "runID", round(max(log2(i)), 7) AS v FROM sn GROUP BY ALL"""))
def _(t):
    return C.simplify_spectronaut(_sn(t)).select("featureID", "runID", R("log2Intensity", 7).alias("v"))


@query("run_pairs", "C19 R47 R48", shapes.with_("msstats", body="""
, s AS (SELECT ProteinName AS f, Run AS r, max(log2(Intensity)) AS v FROM msstats GROUP BY ALL)
SELECT a.r AS "xGroup", b.r AS "yGroup", p.f AS "featureID", round(x.v, 6) AS x, round(y.v, 6) AS y FROM (SELECT DISTINCT r FROM s) a JOIN (SELECT DISTINCT r FROM s) b ON a.r < b.r CROSS JOIN (SELECT DISTINCT f FROM s) p
 LEFT JOIN s x ON x.r = a.r AND x.f = p.f LEFT JOIN s y ON y.r = b.r AND y.f = p.f"""))
def _(t):
    d = shapes.msstats(t).groupBy(F.col("ProteinName").alias("featureID"), F.col("Run").alias("runID")).agg(F.max(F.log2("Intensity")).alias("log2Intensity"))
    return C.run_pairs(d).select("xGroup", "yGroup", "featureID", R("log2Int_x", 6).alias("x"), R("log2Int_y", 6).alias("y"))


@query("run_pair_correlation", "C20 R65", shapes.with_("simple", body="""
SELECT a.r AS "xGroup", b.r AS "yGroup", count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM simple a JOIN simple b ON a.f = b.f AND a.r < b.r WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL"""))
def _(t):
    return C.run_pair_correlation(_simple(t)).withColumn("r", R("r", 6))


@query("observation_counts", "C21", shapes.with_("msstats", body="""
, c AS (SELECT PeptideSequence AS "PEPTIDE", count(*) AS "N" FROM msstats WHERE Intensity > 5000 GROUP BY ALL) SELECT * FROM c WHERE "N" >= (SELECT max("N") FROM c) - 0"""))
def _(t):
    d = shapes.msstats(t).select(F.col("PeptideSequence").alias("PEPTIDE"), F.col("Intensity").alias("INTENSITY"))
    return C.most_observed(C.observation_counts(d, floor=5000))


@query("log_center_intensity", "C22 R25 R73", shapes.with_("msstats", body="""
, s AS (SELECT ProteinName AS f, Run AS r, max(Intensity) AS v FROM msstats GROUP BY ALL)
SELECT f, r, round(log2(v / median(v) OVER (PARTITION BY f)), 7) AS c FROM s WHERE f IN (SELECT f FROM s GROUP BY f HAVING count(*) = (SELECT count(DISTINCT r) FROM s))"""))
def _(t):
    d = shapes.msstats(t).groupBy(F.col("ProteinName").alias("f"), F.col("Run").alias("r")).agg(F.max("Intensity").alias("v"))
    return C.log_center_intensity(d, "f", "r", "v", d.select("r").distinct().count()).select("f", "r", R("logCenteredIntensity", 7).alias("c"))


@query("scaled_intensity", "C23 R73", shapes.with_("run_level", body="""
SELECT Protein AS "Protein", RUN AS "RUN", round(pow(2, LogIntensities - max(LogIntensities) OVER (PARTITION BY Protein)), 7) AS scaled FROM run_level"""))
def _(t):
    return C.scaled_intensity(shapes.run_level(t), "Protein", "LogIntensities").select("Protein", "RUN", R("scaled", 7).alias("scaled"))


@query("missed_cleavages", "C24 R106", shapes.with_("peps", body="""SELECT uniprot, len(regexp_extract_all(sequence, '[KR][A-OQ-Z]')) - len(regexp_extract_all(sequence, '[KR][BJOUXZ]')) AS n, 1 AS k FROM peps WHERE false UNION ALL
 SELECT uniprot, CAST(len(regexp_extract_all(sequence, '[KR][ACDEFGHIKLMNQRSTVWY]')) AS INTEGER), 1 FROM peps"""))
def _(t):
    return shapes.seqs(t).select("uniprot", C.missed_cleavages("sequence").alias("n"), F.lit(1).alias("k"))


@query("set_modification_flags", "C25", shapes.with_("sn", body="""SELECT run AS "RawFile", CASE WHEN ox THEN '' ELSE ' x Phospho' END AS "Modifications" FROM sn"""))
def _(t):
    return C.set_modification_flags(C.spectronaut_to_evidence(_sn(t))[0], ["PH"]).select("RawFile", "Modifications")


@query("compass_input", "C27", shapes.with_("evidence", "keys", body="""
SELECT RawFile AS "RawFile", "Condition" AS "Experiment_ID", "Condition" AS "Bait", "BioReplicate" AS "Replicate", Proteins AS "Prey", CAST(sum("MS/MS count") AS BIGINT) AS "Spectral_Count" FROM evidence JOIN keys ON "Raw file" = RawFile
WHERE NOT regexp_matches(Proteins, 'CON__|REV__') AND Proteins <> '' GROUP BY ALL"""))
def _(t):
    return C.compass_input(shapes.evidence(t), shapes.keys(t).withColumn("BaitName", F.col("Condition")).drop("IsotopeLabelType"))


@query("saint_input", "C28", shapes.with_("run_level", body="""
SELECT SUBJECT_ORIGINAL AS "runName", GROUP_ORIGINAL AS "baitName", CASE WHEN GROUP_ORIGINAL LIKE 'A%' THEN 'C' ELSE 'T' END AS "TorC", Protein AS "preyNameUniprot", CAST(coalesce(len, 299) AS INTEGER) AS "preyLength", round(pow(2, LogIntensities), 3) AS score
FROM run_level LEFT JOIN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) AS p, n_regionkey * 100 AS len FROM nation WHERE n_regionkey > 0) ON Protein = p"""))
def _(t):
    pq = shapes.run_level(t).select(F.col("SUBJECT_ORIGINAL").alias("SUBJECT"), F.col("GROUP_ORIGINAL").alias("GROUP"), "Protein", "LogIntensities")
    lengths = t.nation.where(F.col("n_regionkey") > 0).select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("uniprot"), (F.col("n_regionkey") * 100).alias("length"))
    b, p, i = C.saint_input(pq, lengths, control="^A")
    return i.join(b, ["runName", "baitName"]).join(p, "preyNameUniprot").select("runName", "baitName", "TorC", "preyNameUniprot", "preyLength", R("scoreIntOrSPC", 3).alias("score"))


# --- normalization --------------------------------------------------------------

def polish_sql(source: str, rounds: int = 10) -> str:
    """CTEs of a median polish over ``source(f, r, v)``; ends in ``polished(r, effect, overall)``."""
    parts = [f"z0 AS (SELECT f, r, v FROM {source})", "c0 AS (SELECT DISTINCT r, 0.0::DOUBLE AS c FROM z0)", "e0 AS (SELECT DISTINCT f, 0.0::DOUBLE AS e FROM z0)", "t0 AS (SELECT 0.0::DOUBLE AS t, 0.0::DOUBLE AS s, false AS done)"]
    for k in range(1, rounds + 1):
        p = k - 1
        parts += [
            f"rm{k} AS MATERIALIZED (SELECT f, median(v) AS m FROM z{p} GROUP BY f)",
            f"a{k} AS MATERIALIZED (SELECT f, r, v - m AS v FROM z{p} JOIN rm{k} USING (f))",
            f"cs{k} AS MATERIALIZED (SELECT median(c) AS d FROM c{p})",
            f"cm{k} AS MATERIALIZED (SELECT r, median(v) AS m FROM a{k} GROUP BY r)",
            f"z{k} AS MATERIALIZED (SELECT f, r, v - m AS v FROM a{k} JOIN cm{k} USING (r))",
            f"c{k} AS MATERIALIZED (SELECT r, CASE WHEN done THEN c ELSE c - d + m END AS c FROM c{p} JOIN cm{k} USING (r), cs{k}, t{p})",
            f"er{k} AS MATERIALIZED (SELECT f, e + m AS e FROM e{p} JOIN rm{k} USING (f))",
            f"es{k} AS MATERIALIZED (SELECT median(e) AS d FROM er{k})",
            f"e{k} AS MATERIALIZED (SELECT f, e - d AS e FROM er{k}, es{k})",
            f"t{k} AS MATERIALIZED (SELECT CASE WHEN done THEN t ELSE t + cs{k}.d + es{k}.d END AS t, ns AS s, done OR ns = 0 OR abs(ns - s) < 0.01 * ns AS done FROM t{p}, cs{k}, es{k}, (SELECT sum(abs(v)) AS ns FROM z{k}))",
        ]
    parts.append(f"polished AS (SELECT r, c AS effect, t AS overall FROM c{rounds}, t{rounds})")
    return ", ".join(parts)


@query("normalize_median_polish", "N01", shapes.with_("msstats", body=", src AS (SELECT PeptideSequence || '.' || CAST(PrecursorCharge AS VARCHAR) AS f, Run AS r, max(log2(Intensity)) AS v FROM msstats GROUP BY ALL), " + polish_sql("src") + """
SELECT ProteinName AS "proteinID", PeptideSequence || '.' || CAST(PrecursorCharge AS VARCHAR) AS "featureID", Run AS "runID", round(log2(Intensity) - effect, 6) AS norm FROM msstats JOIN polished ON Run = r"""))
def _(t):
    d = shapes.msstats(t).select(F.col("ProteinName").alias("proteinID"), F.concat_ws(".", "PeptideSequence", F.col("PrecursorCharge").cast("string")).alias("featureID"), F.col("Run").alias("runID"), F.log2("Intensity").alias("logIntensity"))
    return N.normalize_median_polish(d).select("proteinID", "featureID", "runID", R("normLogIntensity", 6).alias("norm"))


@query("normalize_table_median_polish", "N02 N01", shapes.with_("msstats", body=", src AS (SELECT ProteinName || '_' || PeptideSequence || '_' || CAST(PrecursorCharge AS VARCHAR) AS f, Run AS r, max(log2(Intensity)) AS v FROM msstats WHERE ProteinName IN ('Brand#3', 'Brand#4') GROUP BY ALL), " + polish_sql("src") + """
SELECT ProteinName AS "ProteinName", PeptideSequence AS "PeptideSequence", Run AS "Run", Intensity AS before, round(Intensity / pow(2, effect), 3) AS after FROM msstats JOIN polished ON Run = r"""))
def _(t):
    d = N.normalize_table_median_polish(shapes.msstats(t), ["ProteinName", "PeptideSequence", "PrecursorCharge"], "Run", "ProteinName", standards=["Brand#3", "Brand#4"])
    return d.select("ProteinName", "PeptideSequence", "Run", F.col("Intensity_prenormalization").alias("before"), R("Intensity", 3).alias("after"))


_ION = '"ProteinName", "PeptideSequence", "PrecursorCharge"'
_CASE = """, q AS (SELECT quantile_cont("Intensity", {q}) AS lo FROM d), ok AS (SELECT f FROM d, q WHERE "Intensity" > lo GROUP BY f HAVING {having}),
 b AS (SELECT c, r, log2("Intensity") AS l FROM d WHERE f IN (SELECT f FROM ok)), a AS (SELECT c, r, (SELECT median(l) FROM b) - median(l) AS adj FROM b GROUP BY ALL)
SELECT d.f, d.run, d.k, round("Intensity" * pow(2, coalesce(adj, 0)), 3) AS "Intensity" FROM d LEFT JOIN a ON d.c = a.c AND d.r = a.r"""


def _coarse(t):
    """Peptide table whose features recur in every run: part types as peptides."""
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cond = F.concat("l_returnflag", "l_linestatus")
    return d.select(
        F.col("p_brand").alias("ProteinName"), F.col("p_type").alias("PeptideSequence"), (F.col("l_linenumber") * 10 + F.floor(F.col("p_size") / 10)).cast("int").alias("PrecursorCharge"), cond.alias("Condition"),
        (F.col("l_suppkey") % 3).cast("string").alias("BioReplicate"), F.concat_ws("_", cond, (F.col("l_suppkey") % 3).cast("string")).alias("Run"), F.col("l_extendedprice").alias("Intensity"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
    )


shapes.cte("d", """SELECT p_brand || p_type || CAST(l_linenumber * 10 + p_size // 10 AS VARCHAR) AS f, l_returnflag || l_linestatus AS c, CAST(l_suppkey % 3 AS VARCHAR) AS r, l_returnflag || l_linestatus || '_' || CAST(l_suppkey % 3 AS VARCHAR) AS run,
   l_extendedprice AS "Intensity", l_orderkey * 10 + l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey""")


@query("normalize_complete_case", "N03 R25 R62", shapes.with_("d", body=_CASE.format(q=0.05, having="count(DISTINCT run) = (SELECT count(DISTINCT run) FROM d)")))
def _(t):
    d = N.normalize_complete_case(_coarse(t), 0.05)
    return d.select(F.concat("ProteinName", "PeptideSequence", F.col("PrecursorCharge").cast("string")).alias("f"), F.col("Run").alias("run"), "k", R("Intensity", 3).alias("Intensity"))


@query("normalize_complete_case_maxquant", "N04", shapes.with_("d", body=_CASE.format(q=0, having="count(DISTINCT run) = (SELECT count(DISTINCT run) FROM d)").replace("SELECT c, r, log2", "SELECT run AS c, 1 AS r, log2").replace("d.c = a.c AND d.r = a.r", "d.run = a.c")))
def _(t):
    d = _coarse(t).select(F.col("ProteinName").alias("Proteins"), F.col("PeptideSequence").alias("Modified sequence"), F.col("PrecursorCharge").alias("Charge"), F.col("Run").alias("Raw file"), "Intensity", "k")
    d = N.normalize_complete_case_maxquant(d)
    return d.select(F.concat("Proteins", "Modified sequence", F.col("Charge").cast("string")).alias("f"), F.col("`Raw file`").alias("run"), "k", R("Intensity", 3).alias("Intensity"))


@query("normalize_nearly_complete", "N05 R69", shapes.with_("d", body=_CASE.format(q=0.1, having="count(*) >= ceil((SELECT count(DISTINCT run) FROM d) * 0.5)")))
def _(t):
    d = N.normalize_nearly_complete(_coarse(t), 0.5, 0.1)
    return d.select(F.concat("ProteinName", "PeptideSequence", F.col("PrecursorCharge").cast("string")).alias("f"), F.col("Run").alias("run"), "k", R("Intensity", 3).alias("Intensity"))


@query("complete_median_centered", "N06", shapes.with_("d", body="""
, x AS (SELECT f, run, log2(max("Intensity")) AS v FROM d GROUP BY ALL), ok AS (SELECT * FROM x WHERE f IN (SELECT f FROM x GROUP BY f HAVING count(*) = (SELECT count(DISTINCT run) FROM x))),
m AS (SELECT run, median(v) AS m FROM ok GROUP BY ALL) SELECT f, run, round(v - m + (SELECT median(m) FROM m), 6) AS v FROM ok JOIN m USING (run)"""))
def _(t):
    d = N.complete_median_centered(_coarse(t))
    return d.select(F.replace("ion", F.lit("."), F.lit("")).alias("f"), F.expr("substring(sample, instr(sample, '_') + 1)").alias("run"), R("logIntensity", 6).alias("v"))


@query("to_linear_matrix", "N08 R73", shapes.with_("d", body="""
, x AS (SELECT f, run, log2(max("Intensity")) AS v FROM d GROUP BY ALL), ok AS (SELECT f, max(v) AS top FROM x GROUP BY f HAVING count(*) >= 0.5 * (SELECT count(DISTINCT run) FROM x))
SELECT ok.f, r.run, round(coalesce(pow(2, v - top), 0), 7) AS linear FROM ok CROSS JOIN (SELECT DISTINCT run FROM d) r LEFT JOIN x ON x.f = ok.f AND x.run = r.run"""))
def _(t):
    d = _coarse(t).select(F.concat("ProteinName", "PeptideSequence", F.col("PrecursorCharge").cast("string")).alias("f"), F.col("Run").alias("run"), F.log2("Intensity").alias("v"))
    return N.to_linear_matrix(d, "f", "run", "v").withColumn("linear", R("linear", 7))


@query("normalize_to_background", "N07", None)
def _(t):
    d = N.normalize_to_background(shapes.run_level(t), ["Brand#1", "Brand#2"])
    return d.select("Protein", "RUN", "LogIntensities", "preNormalize", "normalizeOffset")
