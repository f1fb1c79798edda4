"""Sequence, modification site and identifier queries over documents, parts and orders."""

from pyspark.sql import functions as F

from spectraloom.functions.columns import pack_sorted_distinct
from spectraloom.operators import ingest as C
from spectraloom.operators import ids as I
from spectraloom.operators import sites as S
from spectraloom.plans import shapes
from spectraloom.plans.registry import query

R = F.round

shapes.cte("letters", """SELECT uniprot, sequence, clean, CAST(i AS INTEGER) AS i, substr(clean, CAST(i AS BIGINT), 1) AS aa FROM peps, range(1, 13) r(i) WHERE i <= length(clean)""", "peps")


def _tagged(t, st, m):
    p = F.regexp_replace(F.regexp_replace("clean", "([ST])", f"$1{st}"), "(M)", f"$1{m}")
    return shapes.peps(t).withColumn("peptide", p)


@query("convert_mass_mods", "S01 R103", shapes.with_("peps", body=r"""
SELECT uniprot, regexp_replace(regexp_replace(clean, '([ST])', '\1(ph)', 'g'), '(M)', '\1(ox)', 'g') AS kept, regexp_replace(clean, '([ST])', '\1(ph)', 'g') AS only_ph, clean AS plain FROM peps"""))
def _(t):
    d = _tagged(t, "[79.9663]", "[15.9949]")
    return d.select("uniprot", S.convert_mass_mods("peptide").alias("kept"), S.convert_mass_mods("peptide", keep_only=["PH"]).alias("only_ph"), S.convert_mass_mods("peptide", remove_all=True).alias("plain"))


@query("convert_lys_methylation", "S02", shapes.with_("peps", body=r"""SELECT uniprot, regexp_replace(clean, 'K', 'K(kmetii)', 'g') AS converted FROM peps"""))
def _(t):
    d = shapes.peps(t).withColumn("peptide", F.regexp_replace("clean", "K", "K[28.0313]"))
    return d.select("uniprot", S.convert_lys_methylation("peptide").alias("converted"))


@query("convert_named_mods", "S03", shapes.with_("peps", body=r"""
SELECT uniprot, regexp_replace(regexp_replace(clean, '([ST])', '\1(ph)', 'g'), '(M)', '\1(ox)', 'g') AS converted FROM peps"""))
def _(t):
    d = _tagged(t, "[Phospho (STY)]", "(Oxidation (M))")
    return d.select("uniprot", S.convert_named_mods("peptide").alias("converted"))


@query("leftover_masses", "S01", shapes.with_("peps", body="""SELECT '[229.1629]' AS tag, count(*) AS peptides FROM peps WHERE contains(clean, 'K')"""))
def _(t):
    d = shapes.peps(t).withColumn("peptide", F.regexp_replace("clean", "K", "K[229.1629]"))
    return S.leftover_masses(d.withColumn("peptide", S.convert_mass_mods("peptide")), "peptide")


@query("clean_sequence", "S04", shapes.with_("peps", body="SELECT uniprot, clean FROM peps"))
def _(t):
    d = _tagged(t, "[Phospho (STY)]", "(Oxidation (M))").withColumn("peptide", F.concat(F.lit("_"), "peptide", F.lit("_")))
    return d.select("uniprot", S.clean_sequence("peptide").alias("clean"))


_SITES = """SELECT uniprot, string_agg(uniprot || '_' || aa || CAST(instr(sequence, clean) + i - 1 AS VARCHAR), ';' ORDER BY i) AS "ptmSiteCombo" FROM letters WHERE aa IN ('S', 'T') GROUP BY ALL"""


@query("sites_from_tagged_peptide", "S05 R107 R108", shapes.with_("letters", body=_SITES))
def _(t):
    p = _tagged(t, "(ph)", "(ox)")
    return S.sites_from_tagged_peptide(p.select("uniprot", "peptide"), shapes.seqs(t)).select("uniprot", "ptmSiteCombo")


@query("sites_from_mass_peptide", "S06", shapes.with_("letters", body=_SITES))
def _(t):
    p = _tagged(t, "[79.9663]", "[15.9949]").select(F.concat(F.lit("sp|"), "uniprot", F.lit("|NAME")).alias("protein"), "peptide")
    s = S.sites_from_mass_peptide(p, shapes.seqs(t))
    return s.select(F.split("protein", r"\|")[1].alias("uniprot"), "ptmSiteCombo")


@query("sitify", "S07 C26", shapes.with_("letters", "peps", body="""
, x AS (SELECT uniprot, string_agg(uniprot || '_' || aa || CAST(instr(sequence, clean) + i - 1 AS VARCHAR), ';' ORDER BY i) AS c FROM letters WHERE aa IN ('S', 'T') GROUP BY ALL)
SELECT uniprot || ';absent' AS "oldProteinName", coalesce(c, uniprot || ';absent') AS "ProteinName" FROM peps LEFT JOIN x USING (uniprot)"""))
def _(t):
    p = _tagged(t, "[Phospho (STY)]", "(Oxidation (M))")
    d = p.select(F.concat("uniprot", F.lit(";absent")).alias("ProteinName"), F.concat(F.lit("_"), "peptide", F.lit("_")).alias("PeptideSequence"))
    return S.sitify(d, shapes.seqs(t)).select("oldProteinName", "ProteinName")


@query("site_evidence", "C26 C25 S07", shapes.with_("letters", "peps", body="""
SELECT string_agg(uniprot || '_' || aa || CAST(instr(sequence, clean) + i - 1 AS VARCHAR), ';' ORDER BY i) AS "Proteins" FROM letters WHERE aa IN ('S', 'T') GROUP BY uniprot"""))
def _(t):
    p = _tagged(t, "[Phospho (STY)]", "(Oxidation (M))")
    d = p.select(F.col("uniprot").alias("Proteins"), F.concat(F.lit("_"), "peptide", F.lit("_")).alias("Modified_sequence"), F.lit("x").alias("Modifications"))
    return C.site_evidence(d, shapes.seqs(t), "PH").select("Proteins")


@query("label_multi_ptm", "S08 R110", shapes.with_("letters", "peps", body="""
, x AS (SELECT uniprot, string_agg(uniprot || '_' || aa || CAST(instr(sequence, clean) + i - 1 AS VARCHAR) || CASE WHEN aa IN ('S', 'T') THEN 'ph' ELSE 'r' END, ';' ORDER BY i) AS c FROM letters WHERE aa IN ('S', 'T', 'M') GROUP BY ALL)
SELECT uniprot AS "og_ProteinName", coalesce(c, uniprot) AS "ProteinName" FROM peps LEFT JOIN x USING (uniprot)"""))
def _(t):
    p = _tagged(t, "[79.9663]", "[100.0]").select(F.col("uniprot").alias("ProteinName"), F.col("peptide").alias("PeptideSequence"))
    d = S.label_multi_ptm(p, shapes.seqs(t), {"ph": "[79.9663]", "r": "[100.0]", "rp": "[175.0]"})
    return d.select("og_ProteinName", "ProteinName")


shapes.cte("doc_sites", """SELECT uniprot, sequence, uniprot || '_S' || CAST(1 + CAST(substr(uniprot, 2) AS INTEGER) % 97 AS VARCHAR) || ';' || uniprot || '_T' || CAST(5 + CAST(substr(uniprot, 2) AS INTEGER) % 89 AS VARCHAR) AS "Protein",
   1 + CAST(substr(uniprot, 2) AS INTEGER) % 97 AS p1, 5 + CAST(substr(uniprot, 2) AS INTEGER) % 89 AS p2 FROM seqs""", "seqs")


def _doc_sites(t):
    k = F.expr("cast(substring(uniprot, 2) as int)")
    return shapes.seqs(t).select(F.concat("uniprot", F.lit("_S"), (1 + k % 97).cast("string"), F.lit(";"), "uniprot", F.lit("_T"), (5 + k % 89).cast("string")).alias("Protein"))


@query("site_neighborhood", "S14 R105", shapes.with_("doc_sites", body="""
, x AS (SELECT "Protein", sequence, length(sequence) AS n, unnest([p1, p2]) AS p FROM doc_sites)
SELECT DISTINCT "Protein", substr(sequence, least(greatest(1, p - 6), n), greatest(least(n, p + 6) - least(greatest(1, p - 6), n) + 1, 0)) AS "siteCenteredSubSeq" FROM x"""))
def _(t):
    return S.site_neighborhood(_doc_sites(t), shapes.seqs(t))


shapes.cte("iso", """SELECT l_orderkey, string_agg(DISTINCT 'P' || CAST(l_partkey % 40 AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '-' || CAST(l_linenumber % 3 AS VARCHAR) END, ';'
     ORDER BY 'P' || CAST(l_partkey % 40 AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '-' || CAST(l_linenumber % 3 AS VARCHAR) END) AS packed FROM lineitem GROUP BY ALL""")


def _iso(t):
    n = F.col("l_linenumber") % 3
    name = F.concat(F.lit("P"), (F.col("l_partkey") % 40).cast("string"), F.when(n == 0, "").otherwise(F.concat(F.lit("-"), n.cast("string"))))
    return t.lineitem.groupBy("l_orderkey").agg(pack_sorted_distinct(name).alias("packed"))


@query("clean_isoform_labels", "S15 R68 R66", shapes.with_("iso", body="""
, x AS (SELECT DISTINCT packed, unnest(string_split(packed, ';')) AS iso FROM iso),
y AS (SELECT packed, regexp_replace(iso, '-[0-9]+$', '') AS canon, bool_or(NOT contains(iso, '-')) AS has, string_agg(iso, ';' ORDER BY iso) AS isos FROM x GROUP BY ALL)
SELECT packed, string_agg(CASE WHEN has THEN canon ELSE isos END, ';' ORDER BY CASE WHEN has THEN canon ELSE isos END) AS "fixedProtein" FROM y GROUP BY ALL"""))
def _(t):
    return S.clean_isoform_labels(_iso(t), "packed")


_COVER = """WITH p AS (SELECT CASE WHEN p_size = 1 THEN 'CON__' ELSE '' END || p_brand AS protein, l_returnflag AS enzyme, CASE WHEN l_quantity = 50 THEN NULL ELSE l_partkey END AS s,
    l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
 c AS (SELECT DISTINCT protein, enzyme, unnest(range(s, e + 1)) AS site FROM p WHERE s IS NOT NULL AND NOT starts_with(protein, 'CON'))"""


def _cover(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.when(F.col("p_size") == 1, "CON__").otherwise(""), "p_brand").alias("protein"), F.col("l_returnflag").alias("enzyme"),
        F.when(F.col("l_quantity") != 50, F.col("l_partkey")).alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"),
    )


@query("residue_coverage", "S16 R115", _COVER + " SELECT DISTINCT protein, site FROM c")
def _(t):
    return S.residue_coverage(_cover(t))


@query("coverage_overlaps", "S17", _COVER + """, x AS (SELECT protein, site, string_agg(DISTINCT enzyme, '&' ORDER BY enzyme) AS enzymes FROM c GROUP BY ALL) SELECT enzymes, count(*) AS sites FROM x GROUP BY ALL""")
def _(t):
    d = _cover(t)
    parts = [S.residue_coverage(d.where(F.col("enzyme") == e)).withColumn("enzyme", F.lit(e)) for e in ("A", "N", "R")]
    return S.coverage_overlaps(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _pairs(t):
    k = F.col("p_partkey").cast("string")
    return t.part.select(
        F.concat(F.lit("A"), k).alias("From"), F.concat(F.lit("B"), k).alias("To"), F.upper(F.replace("p_name", F.lit(" "), F.lit("S"))).alias("from_seq"),
        F.upper(F.concat("p_name", "p_type")).alias("to_seq"),
    )


@query("align_pairs", "S18 L03", None)
def _(t):
    d = S.align_pairs(_pairs(t))
    return d.select("From", "To", "aligned_from", "aligned_to")


@query("aligned_position_map", "S19", """
WITH a AS (SELECT p_partkey, upper(replace(p_name, ' ', '-')) AS f, upper(replace(p_name, 'd', '-')) AS g FROM part),
x AS (SELECT p_partkey, CAST(unnest(range(1, length(f) + 1)) AS INTEGER) AS i, f, g FROM a)
SELECT p_partkey, substr(f, i, 1) AS "FromAA", CAST(length(replace(substr(f, 1, i), '-', '')) AS INTEGER) AS "FromPos", substr(g, i, 1) AS "ToAA", CAST(length(replace(substr(g, 1, i), '-', '')) AS INTEGER) AS "ToPos" FROM x
WHERE substr(f, i, 1) IN ('S', 'T', 'Y') OR substr(g, i, 1) IN ('S', 'T', 'Y')""")
def _(t):
    d = t.part.select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("aligned_from"), F.upper(F.replace("p_name", F.lit("d"), F.lit("-"))).alias("aligned_to"))
    return S.aligned_position_map(d, ["p_partkey"])


@query("map_sites_across_species", "S20", None)
def _(t):
    p = _pairs(t)
    sites = p.select(F.concat("From", F.lit("_S"), F.expr("instr(from_seq, 'S')").cast("string")).alias("site"))
    return S.map_sites_across_species(sites, p.select("From", "To"), p.select(F.col("From").alias("uniprot"), F.col("from_seq").alias("sequence")), p.select(F.col("To").alias("uniprot"), F.col("to_seq").alias("sequence")))


shapes.cte("site_map", """SELECT p_brand AS other_uniprot, p_size AS other_pos, CASE WHEN p_type = 'ECONOMY' THEN '-' ELSE 'S' END AS other_aa, 'H' || CAST(p_partkey % 60 AS VARCHAR) AS human_uniprot, 'T' AS human_aa, p_size + 1 AS human_pos FROM part""")


def _site_map(t):
    return t.part.select(
        F.col("p_brand").alias("other_uniprot"), F.col("p_size").alias("other_pos"), F.when(F.col("p_type") == "ECONOMY", "-").otherwise("S").alias("other_aa"),
        F.concat(F.lit("H"), (F.col("p_partkey") % 60).cast("string")).alias("human_uniprot"), F.lit("T").alias("human_aa"), (F.col("p_size") + 1).alias("human_pos"),
    )


_EXP = r""", e AS (SELECT DISTINCT Protein, s, regexp_extract(s, '^(.*)_', 1) AS prot, CAST(substr(regexp_extract(s, '([^_]*)$', 1), 2) AS INT) AS pos FROM (SELECT Protein, unnest(string_split(Protein, ';')) AS s FROM site_results)),
 j AS (SELECT e.*, other_aa, human_uniprot, human_aa, human_pos FROM e LEFT JOIN site_map ON prot = other_uniprot AND pos = other_pos WHERE coalesce(other_aa, '') <> '-')"""


@query("sites_to_other_species", "S21", shapes.with_("site_results", "site_map", body=_EXP + """ SELECT Protein AS "Protein", s AS "singleSite", human_uniprot, human_pos FROM j"""))
def _(t):
    return S.sites_to_other_species(shapes.site_results(t), _site_map(t)).select("Protein", "singleSite", "human_uniprot", "human_pos")


@query("pack_sites_per_protein", "S22", shapes.with_("site_results", "site_map", body=_EXP + """
SELECT Protein AS "Protein", human_uniprot, string_agg(human_uniprot || '_' || human_aa || CAST(human_pos AS VARCHAR), ';' ORDER BY human_pos, human_aa) AS human
FROM (SELECT DISTINCT Protein, human_uniprot, human_aa, human_pos FROM j) GROUP BY ALL"""))
def _(t):
    # distinct sites are packed: a repeated map row only multiplies the rows on the way
    return S.pack_sites_per_protein(S.sites_to_other_species(shapes.site_results(t), _site_map(t).distinct()))


@query("translate_results_species", "S23", shapes.with_("site_results", "site_map", body=_EXP + """
, g AS (SELECT 'H' || CAST(n_nationkey AS VARCHAR) AS human_uniprot, min(n_name) AS gene FROM nation GROUP BY ALL),
p AS (SELECT Protein, human_uniprot, string_agg(human_uniprot || '_' || human_aa || CAST(human_pos AS VARCHAR), ';' ORDER BY human_pos, human_aa) AS human FROM (SELECT DISTINCT Protein, human_uniprot, human_aa, human_pos FROM j WHERE human_uniprot IS NOT NULL) GROUP BY ALL)
SELECT r.Protein AS "Protein", r.Label AS "Label", j.s AS "singleSite", j.human_uniprot, p.human, gene AS "Gene_Name" FROM site_results r LEFT JOIN j ON r.Protein = j.Protein LEFT JOIN p ON j.Protein = p.Protein AND j.human_uniprot = p.human_uniprot
LEFT JOIN g ON j.human_uniprot = g.human_uniprot"""))
def _(t):
    names = t.nation.select(F.concat(F.lit("H"), F.col("n_nationkey").cast("string")).alias("human_uniprot"), F.col("n_name").alias("Gene_Name"))
    d = S.translate_results_species(shapes.site_results(t), _site_map(t), names)
    return d.select("Protein", "Label", "singleSite", "human_uniprot", "human", "Gene_Name")


_REG = """WITH r AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'human' ELSE 'mouse' END AS org, p_brand AS acc, p_type AS gene, 'S' || CAST(p_size AS VARCHAR) || CASE WHEN p_size > 10 THEN '-p' ELSE '-ac' END AS m,
  CASE WHEN p_partkey % 3 = 0 THEN 'activity, induced' WHEN p_partkey % 3 = 1 THEN 'activity, inhibited' ELSE 'activity, induced; activity, inhibited' END AS f, CASE WHEN p_type = 'ECONOMY' THEN 'Protein Kinase, Ser' ELSE 'Adaptor' END AS ty FROM part)"""


def _reg(t):
    k = F.col("p_partkey") % 3
    return t.part.select(
        F.when(F.col("p_size") % 2 == 0, "human").otherwise("mouse").alias("ORGANISM"), F.col("p_brand").alias("ACC_ID"), F.col("p_type").alias("GENE"),
        F.concat(F.lit("S"), F.col("p_size").cast("string"), F.when(F.col("p_size") > 10, "-p").otherwise("-ac")).alias("MOD_RSD"),
        F.when(k == 0, "activity, induced").when(k == 1, "activity, inhibited").otherwise("activity, induced; activity, inhibited").alias("ON_FUNCTION"),
        F.when(F.col("p_type") == "ECONOMY", "Protein Kinase, Ser").otherwise("Adaptor").alias("PROT_TYPE"),
    )


@query("regulatory_sites", "S24 R23", _REG + """ SELECT acc || '_' || split_part(m, '-', 1) AS uniprot_site, gene || '_' || split_part(m, '-', 1) AS gene_site, contains(f, 'activity, induced') AS activating, contains(f, 'activity, inhibited') AS inhibiting
FROM r WHERE org = 'human' AND m LIKE '%-p' AND ty ILIKE '%kinase%'""")
def _(t):
    return S.regulatory_sites(_reg(t)).select("uniprot_site", "gene_site", "activating", "inhibiting")


@query("site_regulation_direction", "S25", _REG + """ SELECT acc || '_' || split_part(m, '-', 1) AS uniprot_site, gene || '_' || split_part(m, '-', 1) AS gene_site, CASE WHEN f = 'activity, induced' THEN 1 ELSE -1 END AS direction
FROM r WHERE org = 'human' AND m LIKE '%-p' AND f NOT LIKE '%;%'""")
def _(t):
    return S.site_regulation_direction(_reg(t))


@query("sequence_lookup", "S26 R51", shapes.with_("seqs", body="""
, w AS (SELECT DISTINCT CASE WHEN l_quantity = 1 THEN 'D1;D2' ELSE 'D' || CAST(l_partkey AS VARCHAR) END AS uniprot FROM lineitem)
SELECT CASE WHEN contains(uniprot, ';') THEN 'packed' WHEN uniprot IN (SELECT uniprot FROM seqs) THEN 'found' ELSE 'absent' END AS status, count(*) AS n FROM w GROUP BY ALL"""))
def _(t):
    ids = t.lineitem.select(F.when(F.col("l_quantity") == 1, "D1;D2").otherwise(F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).alias("uniprot"))
    found, packed, absent = S.sequence_lookup(ids, shapes.seqs(t))
    tag = lambda d, s: d.select("uniprot").withColumn("status", F.lit(s))
    return tag(found, "found").unionByName(tag(packed, "packed")).unionByName(tag(absent, "absent")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- identifiers ----------------------------------------------------------------

shapes.cte("id_map", """SELECT 'P' || CAST(p_partkey % 900 AS VARCHAR) AS uniprot, CASE WHEN p_size < 25 THEN 'Gene_Name' ELSE 'GeneID' END AS "idType", p_brand || '.' || CAST(p_size AS VARCHAR) AS id FROM part""")


def _id_map(t):
    return t.part.select(
        F.concat(F.lit("P"), (F.col("p_partkey") % 900).cast("string")).alias("uniprot"), F.when(F.col("p_size") < 25, "Gene_Name").otherwise("GeneID").alias("idType"),
        F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("id"),
    )


shapes.cte("packed_ids", """SELECT l_orderkey, string_agg('P' || CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ids FROM lineitem GROUP BY ALL""")


def _packed_ids(t):
    from spectraloom.functions.columns import pack_ordered

    name = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return t.lineitem.groupBy("l_orderkey").agg(pack_ordered(name, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ids"))


@query("translate_id_type", "I01 R45", shapes.with_("id_map", body="""
, m AS (SELECT uniprot, min(id) AS id FROM id_map WHERE "idType" = 'Gene_Name' GROUP BY ALL) SELECT p_partkey, m.id AS gene FROM part LEFT JOIN m ON 'P' || CAST(p_partkey AS VARCHAR) = uniprot"""))
def _(t):
    d = t.part.select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("u"))
    return I.translate_id_type(d, "u", _id_map(t), "Gene_Name", "gene").select("p_partkey", "gene")


@query("translate_id_reverse", "I01 I13", shapes.with_("id_map", body="""
, m AS (SELECT id, min(uniprot) AS u FROM id_map WHERE "idType" = 'GeneID' GROUP BY ALL) SELECT p_partkey, u AS uniprot FROM part LEFT JOIN m ON p_brand || '.' || CAST(p_size AS VARCHAR) = id"""))
def _(t):
    d = t.part.select("p_partkey", F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("gid"))
    return I.translate_id_type(d, "gid", _id_map(t), "GeneID", "uniprot", reverse=True).select("p_partkey", "uniprot")


@query("string_uniprot_table", "I02 R102", """SELECT '9606.' || CAST(p_partkey AS VARCHAR) AS string_id, p_brand AS uniprot, p_type AS uniprot_name FROM part""")
def _(t):
    d = t.part.select(F.concat(F.lit("9606."), F.col("p_partkey").cast("string")).alias("string_id"), F.concat_ws("|", "p_brand", "p_type").alias("packed"))
    return I.string_uniprot_table(d)


@query("translate_fill_missing", "I03 I02 R43", shapes.with_("id_map", body="""
, m AS (SELECT uniprot, min(id) AS id FROM id_map GROUP BY ALL) SELECT l_orderkey, l_linenumber, coalesce(m.id, 'P' || CAST(l_partkey AS VARCHAR)) AS gene FROM lineitem LEFT JOIN m ON 'P' || CAST(l_partkey AS VARCHAR) = uniprot"""))
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("u"))
    return I.translate(d, "u", _id_map(t), "uniprot", "id", "gene", fill_missing=True).select("l_orderkey", "l_linenumber", "gene")


@query("translate_isoform_gene", "I04", shapes.with_("id_map", body="""
, m AS (SELECT uniprot, min(id) AS id FROM id_map GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN m.id || '-iso' || CAST(l_linenumber AS VARCHAR) ELSE m.id END AS gene FROM lineitem LEFT JOIN m ON 'P' || CAST(l_partkey AS VARCHAR) = uniprot"""))
def _(t):
    base = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    u = F.when(F.col("l_linenumber") > 2, F.concat_ws("-", base, F.col("l_linenumber").cast("string"))).otherwise(base)
    d = t.lineitem.select("l_orderkey", "l_linenumber", u.alias("u"))
    return I.translate_isoform_gene(d, "u", _id_map(t), "uniprot", "id", "gene").select("l_orderkey", "l_linenumber", "gene")


_PACKED = """, m AS (SELECT uniprot, min(id) AS id FROM id_map GROUP BY ALL),
 x AS (SELECT l_orderkey, ids, unnest(string_split(ids, ';')) AS one, unnest(range(len(string_split(ids, ';')))) AS i FROM packed_ids),
 g AS (SELECT l_orderkey, ids, string_agg({name}, ';' ORDER BY {order}) AS genes FROM x LEFT JOIN m ON one = uniprot {where} GROUP BY ALL)"""


@query("translate_packed", "I05 R66 R117", shapes.with_("id_map", "packed_ids", body=_PACKED.format(name="coalesce(id, one)", order="i", where="") + """
, d AS (SELECT genes, count(*) AS c FROM (SELECT DISTINCT ids, genes FROM g) GROUP BY ALL) SELECT l_orderkey, CASE WHEN c > 1 THEN genes || '.' || ids ELSE genes END AS genes FROM g JOIN d USING (genes)"""))
def _(t):
    return I.translate_packed(_packed_ids(t), "ids", _id_map(t), "uniprot", "id", "genes").select("l_orderkey", "genes")


@query("translate_packed_simplified", "I05 I08 R120", shapes.with_("id_map", "packed_ids", body=_PACKED.format(name="DISTINCT coalesce(id, one)", order="coalesce(id, one)", where="") + " SELECT l_orderkey, genes FROM g"))
def _(t):
    return I.translate_packed(_packed_ids(t), "ids", _id_map(t), "uniprot", "id", "genes", simplify=True, allow_duplicates=True).select("l_orderkey", "genes")


@query("translate_packed_sites", "I06", shapes.with_("site_results", body="""
, x AS (SELECT DISTINCT Protein, unnest(string_split(Protein, ';')) AS one, unnest([0, 1]) AS i FROM site_results),
m AS (SELECT p_brand, min(p_type) AS g FROM part GROUP BY ALL)
SELECT Protein AS "Protein", string_agg(g || '_' || regexp_extract(one, '([^_]*)$', 1), ';' ORDER BY i) AS gene FROM x JOIN m ON regexp_extract(one, '^(.*)_', 1) = p_brand GROUP BY ALL"""))
def _(t):
    d = shapes.site_results(t).select("Protein").distinct()
    return I.translate_packed_sites(d, "Protein", t.part.select("p_brand", "p_type"), "p_brand", "p_type", "gene")


@query("translate_packed_any", "I07", shapes.with_("id_map", "packed_ids", body=_PACKED.format(name="id", order="i", where="") + " SELECT l_orderkey, genes FROM g"))
def _(t):
    return I.translate_packed_any(_packed_ids(t), "ids", _id_map(t), "uniprot", "id", "genes", allow_duplicates=True).select("l_orderkey", "genes")


_ALIAS = "WITH a AS (SELECT p_name AS alias, min(p_brand) AS symbol FROM part GROUP BY ALL), u AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_type ELSE p_name END AS p_name FROM part)"


def _aliases(t):
    return t.part.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("symbol"))


def _named(t):
    """Names of all parts, some of which are no alias."""
    return t.part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("p_name"))


@query("alias_to_symbol", "I09", _ALIAS + " SELECT p_partkey, coalesce(symbol, 'old_' || p_name) AS symbol FROM u LEFT JOIN a ON p_name = alias")
def _(t):
    return I.alias_to_symbol(_named(t), "p_name", _aliases(t), "symbol", "old_").select("p_partkey", "symbol")


@query("alias_counts", "I09 R61", _ALIAS + """ SELECT count(*) AS unique_aliases, count(*) FILTER (symbol <> p_name) AS replaced, count(*) FILTER (symbol IS NULL) AS not_found
FROM (SELECT DISTINCT p_name FROM u) LEFT JOIN a ON p_name = alias""")
def _(t):
    return I.alias_counts(_named(t), "p_name", _aliases(t))


@query("add_descriptions", "I10 R41", """SELECT s_suppkey, n_name || ' : ' || r_name AS description FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    desc = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("uniprot"), F.col("n_name").alias("symbol"), F.col("r_name").alias("description"))
    return I.add_descriptions(t.supplier, "s_nationkey", desc, add_symbol=True).select("s_suppkey", "description")


@query("ortholog_protein_pairs", "I11", """SELECT DISTINCT 's' || CAST(s_suppkey AS VARCHAR) AS left_uniprot, 'c' || CAST(c_custkey AS VARCHAR) AS right_uniprot, s_nationkey AS left_gene, c_nationkey AS right_gene
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = (n_nationkey + n_regionkey) % 25""")
def _(t):
    h = t.nation.select(F.col("n_nationkey").alias("left_gene"), ((F.col("n_nationkey") + F.col("n_regionkey")) % 25).alias("right_gene"))
    l = t.supplier.select(F.col("s_nationkey").alias("id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uniprot"))
    r = t.customer.select(F.col("c_nationkey").alias("id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uniprot"))
    return I.ortholog_protein_pairs(h, l, r)


@query("map_aliases", "I12", """
WITH a AS (SELECT '9606.' || CAST(l_suppkey AS VARCHAR) AS string_id, l_partkey AS alias, l_returnflag || CAST(l_linenumber AS VARCHAR) AS source FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
m AS (WITH RECURSIVE m AS (SELECT 0 AS turn, CAST([] AS VARCHAR[]) AS taken, CAST([] AS BIGINT[]) AS done UNION ALL
  SELECT turn + 1, list_append(taken, b.source), list_concat(done, b.hit) FROM (SELECT m.turn, m.taken, m.done, (SELECT struct_pack(source := q.source, hit := q.hit) FROM
    (SELECT source, list(DISTINCT alias) AS hit FROM a WHERE NOT list_contains(m.done, alias) GROUP BY source) q ORDER BY len(q.hit) DESC, q.source LIMIT 1) AS b FROM m) WHERE b IS NOT NULL)
  SELECT taken FROM m ORDER BY turn DESC LIMIT 1),
t AS (SELECT unnest(taken) AS source, unnest(range(1, len(taken) + 1)) AS turn FROM m)
SELECT alias, min(string_id) AS string_id, source FROM a JOIN t USING (source) GROUP BY alias, source, turn QUALIFY row_number() OVER (PARTITION BY alias ORDER BY turn) = 1""")
def _(t):
    al = t.lineitem.select(F.concat(F.lit("9606."), F.col("l_suppkey").cast("string")).alias("string_id"), F.col("l_partkey").alias("alias"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("source"))
    return I.map_aliases(t.part.select(F.col("p_partkey").alias("id")), al)


@query("preferred_names", "I15 R44", """SELECT l_orderkey, l_linenumber, s_name AS preferred_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def _(t):
    info = t.supplier.select(F.col("s_suppkey").alias("string_id"), F.col("s_name").alias("preferred_name"))
    return I.preferred_names(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", info).select("l_orderkey", "l_linenumber", "preferred_name")


@query("compounds_to_genes", "I14 R46", """SELECT o_custkey AS compound, s_nationkey AS gene, count(*) AS "N" FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def _(t):
    return I.compounds_to_genes(
        t.orders.select(F.col("o_custkey").alias("compound"), F.col("o_orderkey").alias("reaction")), t.lineitem.select(F.col("l_orderkey").alias("reaction"), F.col("l_suppkey").alias("ortholog")),
        t.supplier.select(F.col("s_suppkey").alias("ortholog"), F.col("s_nationkey").alias("gene")),
    )
