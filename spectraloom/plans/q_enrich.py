"""Set enrichment and kinase activity queries."""

from pyspark.sql import functions as F

from spectraloom.operators import enrich as E
from spectraloom.operators import kinase as K
from spectraloom.operators import sites as S
from spectraloom.operators.relational import similar_sets
from spectraloom.plans import shapes
from spectraloom.plans.q_significance import HYPER_LOG10, NORMAL_TWO_SIDED
from spectraloom.plans.registry import query

R = F.round

shapes.cte("uni", "SELECT DISTINCT gene FROM gene_groups WHERE gene IN (SELECT gene FROM gmt)", "gene_groups gmt")
shapes.cte("counts", """SELECT grp, ont, count(*) AS k, string_agg(gene, '/' ORDER BY gene) AS genes FROM gene_groups JOIN gmt USING (gene) WHERE gene IN (SELECT gene FROM uni) GROUP BY ALL""", "uni")
shapes.cte("tested", f"""SELECT grp, ont, k, n, m, u, genes, {HYPER_LOG10.format(k='k', w='m', u='u', n='n')} AS lp FROM counts
   JOIN (SELECT grp, count(*) AS n FROM gene_groups WHERE gene IN (SELECT gene FROM uni) GROUP BY ALL) USING (grp)
   JOIN (SELECT ont, count(*) AS m FROM gmt WHERE gene IN (SELECT gene FROM uni) GROUP BY ALL) USING (ont), (SELECT count(*) AS u FROM uni)""", "counts")


@query("enrich", "E01 F10 R46 R50", shapes.with_("tested", body="""
SELECT grp, ont AS "set", k AS "groupANDsetSize", n AS "groupSize", m AS "setSize", u AS "universeSize",
   round(CAST(k * (u - m - n + k) AS DOUBLE) / nullif((n - k) * (m - k), 0), 6) AS "oddsRatio", round(lp, 5) AS "log10P", genes FROM tested WHERE k >= 3"""))
def _(t):
    e = E.enrich(shapes.gene_groups(t), shapes.gmt(t))
    return e.withColumn("oddsRatio", R("oddsRatio", 6)).withColumn("log10P", R("log10P", 5))


_BH = """, r AS (SELECT *, pow(10, lp) AS p, rank() OVER (PARTITION BY grp ORDER BY round(lp, 8)) + count(*) OVER (PARTITION BY grp, round(lp, 8)) - 1 AS mx, count(*) OVER (PARTITION BY grp) AS cnt FROM {src}),
  b AS (SELECT *, least(1.0, min(p * cnt / mx) OVER (PARTITION BY grp ORDER BY round(lp, 8) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM r)"""


@query("to_ratio_table", "E03 E02 F03", shapes.with_("tested", body=", f AS (SELECT * FROM tested WHERE m BETWEEN 10 AND 500)" + _BH.format(src="f") + """
SELECT grp, ont AS "ID", format('{}/{}', k, n) AS "GeneRatio", format('{}/{}', m, u) AS "BgRatio", round(p, 6) AS pvalue, round(padj, 5) AS p_adjust, genes AS "geneID", k AS "Count" FROM b"""))
def _(t):
    e = E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t))
    return e.withColumn("pvalue", R("pvalue", 6)).withColumn("p_adjust", R("p_adjust", 5))


@query("enrich_own_universe", "E02", shapes.with_("gene_groups", "gmt", body=f"""
, own AS (SELECT DISTINCT n.grp, o.gene FROM (SELECT DISTINCT grp, split_part(grp, ' ', 1) AS nat FROM gene_groups) n JOIN (SELECT DISTINCT split_part(grp, ' ', 1) AS nat, gene FROM gene_groups) o USING (nat) WHERE gene IN (SELECT gene FROM gmt)),
g AS (SELECT grp, gene FROM gene_groups SEMI JOIN own USING (grp, gene)),
c AS (SELECT grp, ont, count(*) AS k FROM g JOIN gmt USING (gene) GROUP BY ALL),
x AS (SELECT grp, ont, k, n, m, u FROM c JOIN (SELECT grp, count(*) AS n FROM g GROUP BY ALL) USING (grp)
  JOIN (SELECT grp, ont, count(*) AS m FROM own JOIN gmt USING (gene) GROUP BY ALL) USING (grp, ont) JOIN (SELECT grp, count(*) AS u FROM own GROUP BY ALL) USING (grp))
SELECT grp, ont AS "set", k AS "groupANDsetSize", n AS "groupSize", m AS "setSize", u AS "universeSize", round({HYPER_LOG10.format(k='k', w='m', u='u', n='n')}, 5) AS "log10P" FROM x WHERE k >= 3"""))
def _(t):
    g = shapes.gene_groups(t)
    nat = F.split("grp", " ")[0]
    own = g.select("grp", nat.alias("nat")).distinct().join(g.select(nat.alias("nat"), "gene").distinct(), "nat").select("grp", "gene")
    return E.enrich(g, shapes.gmt(t), own, universe_by_group=True).drop("oddsRatio", "genes").withColumn("log10P", R("log10P", 5))


_PAIRS = """, s AS (SELECT a.ont AS a, b.ont AS b, count(*) AS k FROM gmt a JOIN gmt b ON a.gene = b.gene AND a.ont < b.ont GROUP BY ALL),
  z AS (SELECT ont, count(*) AS n FROM gmt GROUP BY ALL)
SELECT s.a, s.b, round({score}, 9) AS score FROM s JOIN z za ON s.a = za.ont JOIN z zb ON s.b = zb.ont WHERE {score} >= {cut}"""


@query("term_jaccard_pairs", "E04 M19", shapes.with_("gmt", body=_PAIRS.format(score="k / CAST(za.n + zb.n - k AS DOUBLE)", cut=0.01)))
def _(t):
    return similar_sets(shapes.gmt(t), "ont", "gene", 0.01).withColumn("score", R("score", 9))


@query("term_overlap_pairs", "E05", shapes.with_("gmt", body=_PAIRS.format(score="k / CAST(least(za.n, zb.n) AS DOUBLE)", cut=0.2)))
def _(t):
    return similar_sets(shapes.gmt(t), "ont", "gene", 0.2, overlap=True).withColumn("score", R("score", 9))


@query("simplify_terms", "E04", None)
def _(t):
    table = E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t))
    return E.simplify_terms(table, shapes.gmt(t), 0.9, max_p=0.9)[0]


@query("best_terms_per_group", "E06 E07 R72", None)
def _(t):
    return E.enrich_all(shapes.gene_groups(t), shapes.gmt(t), max_p=0.9, top_n=2, cut_height=0.95)["best"]


@query("best_terms_without_clusters", "E06 R72", shapes.with_("tested", body=", f AS (SELECT * FROM tested WHERE m BETWEEN 10 AND 500)" + _BH.format(src="f") + """
SELECT DISTINCT ont AS "ID" FROM (SELECT ont, row_number() OVER (PARTITION BY grp ORDER BY round(padj, 7), ont) AS rn FROM b WHERE round(padj, 7) < 0.99 AND k >= 2) WHERE rn <= 2"""))
def _(t):
    e = E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t)).withColumn("p_adjust", R("p_adjust", 7))
    return E.best_terms_per_group(e, None, 2, 0.99, 2)


def _scores(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene")).agg(
        R(F.sum("l_extendedprice") - 350000, 2).alias("score")
    )


shapes.cte("scores", """SELECT l_returnflag AS grp, 'g' || CAST(l_partkey AS VARCHAR) AS gene, round(sum(l_extendedprice) - 350000, 2) AS score FROM lineitem GROUP BY ALL""")


_ES = """
, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY grp) AS n FROM scores),
h AS (SELECT grp, ont, gene, r, n, abs(score) AS w, row_number() OVER o AS i, sum(abs(score)) OVER (PARTITION BY grp, ont ORDER BY r) AS cum, sum(abs(score)) OVER (PARTITION BY grp, ont) AS tot,
   count(*) OVER (PARTITION BY grp, ont) AS k FROM k JOIN gmt USING (gene) WINDOW o AS (PARTITION BY grp, ont ORDER BY r)),
d AS (SELECT *, cum / tot - (r - i) / CAST(n - k AS DOUBLE) AS up, (cum - w) / tot - (r - i) / CAST(n - k AS DOUBLE) AS down FROM h),
e AS (SELECT grp, ont, max(up) AS hi, min(down) AS lo, arg_max(r, up) AS pr, arg_min(r, down) AS lr, any_value(k) AS size FROM d GROUP BY ALL),
f AS (SELECT *, CASE WHEN hi > -lo THEN hi ELSE lo END AS es FROM e)
"""


@query("enrichment_scores", "E08 R81", shapes.with_("scores", "gmt", body=_ES + """SELECT grp, ont, size, round(es, 7) AS es, (SELECT CASE WHEN f.es >= 0 THEN string_agg(gene, '|' ORDER BY r) FILTER (r <= f.pr) ELSE string_agg(gene, '|' ORDER BY r DESC) FILTER (r >= f.lr) END
   FROM d WHERE d.grp = f.grp AND d.ont = f.ont) AS "leadingEdge" FROM f"""))
def _(t):
    e = E.enrichment_scores(E.ranked_scores(_scores(t)), shapes.gmt(t))
    return e.select("grp", "ont", "size", R("ES", 7).alias("es"), "leadingEdge")


@query("gsea", "E08", None)
def _(t):
    return E.gsea(_scores(t), shapes.gmt(t))


@query("simplify_gsea", "E05", None)
def _(t):
    g = E.gsea(_scores(t), shapes.gmt(t))
    return E.simplify_gsea(g, shapes.gmt(t), "overlap_coef", 0.9, max_p=1.1)[0]


@query("leading_edge_sizes", "E05 R61", shapes.with_("scores", "gmt", body=_ES + """
SELECT ont AS pathway, count(DISTINCT gene) AS "leadingEdgeLength" FROM d JOIN f USING (grp, ont) WHERE CASE WHEN f.es >= 0 THEN d.r <= f.pr ELSE d.r >= f.lr END GROUP BY ALL"""))
def _(t):
    return E.leading_edge_sizes(E.enrichment_scores(E.ranked_scores(_scores(t)), shapes.gmt(t)).withColumnRenamed("ont", "pathway"))


@query("pretty_term", "E09 R103 R105", r"""
SELECT DISTINCT term, upper(substr(c, 1, 1)) || substr(c, 2) AS pretty FROM (SELECT term,
  regexp_replace(regexp_replace(lower(replace(regexp_replace(term, '^GO_', ''), '_', ' ')), '\bdna|dna\b', 'DNA', 'g'), '\batp|atp\b', 'ATP', 'g') AS c
  FROM (SELECT 'GO_' || replace(p_name, ' ', '_') || CASE WHEN p_size > 25 THEN '_dna_binding' ELSE '_atpase' END AS term FROM part))""")
def _(t):
    tail = F.when(F.col("p_size") > 25, "_dna_binding").otherwise("_atpase")
    d = t.part.select(F.concat(F.lit("GO_"), F.replace("p_name", F.lit(" "), F.lit("_")), tail).alias("term")).distinct()
    return d.select("term", E.pretty_term("term").alias("pretty"))


def _complex_table(t):
    genes = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("g"), F.col("l_partkey").cast("string")))), ";")
    return t.lineitem.groupBy("l_orderkey").agg(genes.alias("subunits(Gene name)"), F.max("l_returnflag").alias("f")).select(
        F.col("l_orderkey").alias("ComplexID"), F.concat(F.lit("complex "), F.col("l_orderkey").cast("string")).alias("ComplexName"),
        F.when(F.col("f") == "R", "Human").otherwise("Mouse").alias("Organism"), "subunits(Gene name)",
    )


@query("complexes_as_gmt", "E10 R101", """
WITH c AS (SELECT l_orderkey, max(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT DISTINCT 'complex ' || CAST(l_orderkey AS VARCHAR) AS ont, 'g' || CAST(l_partkey AS VARCHAR) AS gene, l_orderkey AS ont_id FROM lineitem JOIN c USING (l_orderkey) WHERE f = 'R'""")
def _(t):
    return E.complexes_as_gmt(_complex_table(t), "HUMAN")


@query("annotation_gmt", "E10 R46", "SELECT DISTINCT n_name AS ont, 's' || CAST(s_suppkey AS VARCHAR) AS gene, s_nationkey AS ont_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    genes = t.supplier.select(F.col("s_nationkey").alias("ont_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    return E.annotation_gmt(genes, t.nation.select(F.col("n_nationkey").alias("ont_id"), F.col("n_name").alias("name"))).select("ont", "gene", "ont_id")


@query("limit_to_slim", "E10 R50", """SELECT DISTINCT p_brand AS ont, 'g' || CAST(p_partkey AS VARCHAR) AS gene, p_size AS ont_id FROM part WHERE p_size IN (SELECT s_nationkey FROM supplier)""")
def _(t):
    g = t.part.select(F.col("p_brand").alias("ont"), F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_size").alias("ont_id")).distinct()
    return E.limit_to_slim(g, t.supplier.select(F.col("s_nationkey").alias("ont_id"))).select("ont", "gene", "ont_id")


@query("best_term_per_protein", "E12 R71", shapes.with_("tested", body=", f AS (SELECT * FROM tested WHERE m BETWEEN 10 AND 500)" + """
, x AS (SELECT grp, ont, round(pow(10, lp), 7) AS p, unnest(string_split(genes, '/')) AS protein FROM f)
SELECT protein, ont AS "ID", grp, p AS pvalue FROM (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY p, ont, grp) AS rn FROM x) WHERE rn = 1"""))
def _(t):
    e = E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t)).withColumn("pvalue", R("pvalue", 7))
    return E.best_term_per_protein(e).select("protein", "ID", "grp", "pvalue")


@query("label_modules", "E13 F07", shapes.with_("tested", body=", f AS (SELECT *, round(pow(10, lp), 7) AS p, k / CAST(m + n - k AS DOUBLE) AS j, k * k / CAST(n * m AS DOUBLE) AS s, format('{}; {}/{}({})', ont, k, n, m) AS nm FROM tested WHERE m BETWEEN 10 AND 500)" + """
SELECT a.grp AS cluster, a.nm AS name, a.ont AS go, b.nm AS jaccard_name, b.ont AS jaccard_go, c.nm AS "termScore_name", c.ont AS "termScore_go"
FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY p, ont) = 1) a JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY j DESC, ont) = 1) b USING (grp)
  JOIN (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY s DESC, ont) = 1) c USING (grp)"""))
def _(t):
    return E.label_modules(E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t)).withColumn("pvalue", R("pvalue", 7)))


_TERMS = ["size 7", "size 11", "size 23"]


@query("term_by_group", "E06 R74", shapes.with_("tested", body=", f AS (SELECT * FROM tested WHERE m BETWEEN 10 AND 500)" + _BH.format(src="f") + """
SELECT ont AS "ID", round(coalesce(max(-log10(padj)) FILTER (grp = 'NATION_1 q1'), 0), 4) AS a, round(coalesce(max(-log10(padj)) FILTER (grp = 'NATION_2 q3'), 0), 4) AS b FROM b GROUP BY ALL"""))
def _(t):
    e = E.enrich_by_group(shapes.gene_groups(t), shapes.gmt(t))
    w = E.term_by_group(e, e.select("ID").distinct(), ["NATION_1 q1", "NATION_2 q3"])
    return w.select("ID", R(F.col("NATION_1 q1") + 0.0, 4).alias("a"), R(F.col("NATION_2 q3") + 0.0, 4).alias("b"))


_OWN = """, own AS (SELECT gene, min(grp) AS grp FROM gene_groups GROUP BY ALL)"""


@query("term_gene_matrices", "E11 R74", shapes.with_("gmt", "uni", body=_OWN + """
, c AS (SELECT DISTINCT ont, gene FROM own JOIN gmt USING (gene) WHERE ont IN ('size 7', 'size 11', 'size 23'))
SELECT gene, count(*) FILTER (ont = 'size 7') AS a, count(*) FILTER (ont = 'size 11') AS b, count(*) FILTER (ont = 'size 23') AS c FROM own LEFT JOIN c USING (gene) GROUP BY ALL"""))
def _(t):
    m = _matrices(t)[0]
    return m.select("gene", F.col("size 7").alias("a"), F.col("size 11").alias("b"), F.col("size 23").alias("c"))


def _matrices(t):
    own = shapes.gene_groups(t).groupBy("gene").agg(F.min("grp").alias("grp"))
    table = E.to_ratio_table(E.enrich(own, shapes.gmt(t), min_match=1))
    return E.term_gene_matrices(table, own, _TERMS)


@query("term_gene_p_matrix", "E11 R74", shapes.with_("gmt", "uni", body=_OWN + """
, u AS (SELECT DISTINCT gene FROM own), m AS (SELECT own.grp, ont, count(*) AS k FROM own JOIN gmt USING (gene) WHERE ont IN ('size 7', 'size 11', 'size 23') GROUP BY ALL)
SELECT gene, max(k) FILTER (ont = 'size 7') IS NOT NULL AS a, max(k) FILTER (ont = 'size 11') IS NOT NULL AS b, max(k) FILTER (ont = 'size 23') IS NOT NULL AS c FROM own LEFT JOIN m USING (grp) GROUP BY gene"""))
def _(t):
    m = _matrices(t)[1]
    return m.select("gene", (F.col("size 7") < 1).alias("a"), (F.col("size 11") < 1).alias("b"), (F.col("size 23") < 1).alias("c"))


@query("localization_scores", "E14", None)
def _(t):
    cells = t.part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_brand").alias("MMF localization"))
    rows, _ = E.localization_scores(_scores(t), cells, "symbol")
    return E.location_score_matrix(rows, ["A", "N", "R"])


# --- kinase activity ------------------------------------------------------------

@query("single_site_map", "S09 S10 R101", shapes.with_("site_results", body=r"""
, s AS (SELECT DISTINCT Protein, unnest(string_split(Protein, ';')) AS "singleSite" FROM site_results)
SELECT Protein AS "Protein", "singleSite", regexp_extract("singleSite", '^(.*)_', 1) AS "singleProtein", regexp_extract("singleSite", '([^_]*)$', 1) AS "aaAndPos",
  substr(regexp_extract("singleSite", '([^_]*)$', 1), 1, 1) AS aa, CAST(substr(regexp_extract("singleSite", '([^_]*)$', 1), 2) AS INTEGER) AS pos FROM s"""))
def _(t):
    return S.single_site_map(shapes.site_results(t))


shapes.cte("reps", r"""
 SELECT *, row_number() OVER (PARTITION BY Label, prot, aapos ORDER BY coalesce(isinf(log2FC), false), pvalue NULLS FIRST, abs(log2FC) DESC NULLS LAST, Protein) = 1
    AND NOT (coalesce(isinf(log2FC), false) AND max(CAST(log2FC = 'Infinity' AS INT)) OVER g + max(CAST(log2FC = '-Infinity' AS INT)) OVER g = 2) AS rep
 FROM (SELECT *, regexp_extract(s, '^(.*)_', 1) AS prot, regexp_extract(s, '([^_]*)$', 1) AS aapos FROM (SELECT *, unnest(string_split(Protein, ';')) AS s FROM site_results))
 WINDOW g AS (PARTITION BY Label, prot, aapos)""", "site_results")


@query("site_representatives", "S11 S12 S13 R80", shapes.with_("reps", body='SELECT Protein AS "Protein", Label AS "Label", s AS "singleSite", log2FC AS "log2FC", rep AS representative FROM reps'))
def _(t):
    d = S.prepare_site_results(shapes.site_results(t))
    return d.select("Protein", "Label", "singleSite", "log2FC", "representative")


@query("kinase_data_to_sets", "K02", shapes.with_("kinase_data", body="""
SELECT "TARGET_GENE_NAME" || '_S' || CAST("TARGET_POS" AS VARCHAR) AS gene, "CTRL_GENE_NAME" AS kinase, "TARGET_UP_ID" || '_S' || CAST("TARGET_POS" AS VARCHAR) AS protein FROM kinase_data"""))
def _(t):
    return K.kinase_data_to_sets(shapes.kinase_data(t))


@query("kinase_sites", "K01", """SELECT CASE WHEN p_size > 25 AND p_type = 'ECONOMY' THEN 'fam' || CAST(p_partkey AS VARCHAR) WHEN p_type = 'ECONOMY' THEN '' ELSE p_brand END AS "CTRL_GENE_NAME", p_partkey FROM part WHERE p_retailprice > 950""")
def _(t):
    d = t.part.select(
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.col("p_brand")).alias("CTRL_GENE_NAME"), F.when(F.col("p_size") > 25, "FPLX").otherwise("HGNC").alias("CTRL_NS"),
        F.concat(F.lit("fam"), F.col("p_partkey").cast("string")).alias("CTRL_ID"), (F.col("p_retailprice") > 950).alias("CTRL_IS_KINASE"), "p_partkey",
    )
    return K.kinase_sites(d).select("CTRL_GENE_NAME", "p_partkey")


@query("kinase_sites_scored", "K01", """SELECT p_type AS "CTRL_GENE_NAME", p_brand AS "TARGET_GENE_NAME", 'S' AS "TARGET_RES", CAST(p_partkey AS INTEGER) AS "TARGET_POS" FROM part WHERE p_size > 5""")
def _(t):
    d = t.part.select(F.col("p_type").alias("GENE"), F.col("p_brand").alias("SUB_GENE"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("SUB_MOD_RSD"), F.col("p_size").alias("networkin_score"))
    return K.kinase_sites_scored(d)


@query("enzyme_sites", "K01 R50", """SELECT p_brand AS "CTRL_GENE_NAME", p_type AS "TARGET_GENE_NAME", 'T' AS "TARGET_RES", p_size AS "TARGET_POS", p_name AS "TARGET_UP_ID" FROM part
  WHERE p_retailprice < 1000 AND p_brand IN (SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR) FROM nation)""")
def _(t):
    d = t.part.select(
        F.col("p_brand").alias("enzyme_genesymbol"), F.col("p_type").alias("substrate_genesymbol"), F.lit("T").alias("residue_type"), F.col("p_size").alias("residue_offset"),
        F.col("p_name").alias("substrate"), F.when(F.col("p_retailprice") < 1000, "phosphorylation").otherwise("acetylation").alias("modification"),
    )
    return K.enzyme_sites(d, t.nation.select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("symbol")))


_KIN = f"""
, c AS (SELECT Label, prot, substr(aapos, 1, 1) AS aa, CAST(substr(aapos, 2) AS INT) AS pos, s, Protein AS combo, log2FC AS fc FROM reps WHERE rep AND isfinite(log2FC) AND abs(log2FC) < 10),
bg AS (SELECT Label, avg(fc) AS m, stddev_samp(fc) AS sd FROM c GROUP BY ALL),
kd AS (SELECT DISTINCT "CTRL_GENE_NAME" AS kin, "TARGET_GENE_NAME" AS g, "TARGET_RES" AS r, "TARGET_POS" AS p FROM kinase_data),
mm AS (SELECT c.*, kin FROM c JOIN kd ON prot = g AND aa = r AND pos = p),
z AS (SELECT Label, kin, avg(fc) AS mean, count(DISTINCT combo) AS n, string_agg(DISTINCT s, ';' ORDER BY s) AS sites FROM (SELECT DISTINCT Label, kin, combo, fc, s FROM mm) GROUP BY ALL),
zz AS (SELECT Label, kin, n, sites, mean, (mean - m) * sqrt(n) / sd AS z FROM z JOIN bg USING (Label)),
pp AS (SELECT *, {NORMAL_TWO_SIDED.format(z='z')} AS p FROM zz),
q AS (SELECT *, rank() OVER (PARTITION BY Label ORDER BY p) AS rk, count(*) OVER (PARTITION BY Label) AS cnt FROM pp),
fin AS (SELECT *, least(1.0, min(p * cnt / rk) OVER (PARTITION BY Label ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr FROM q)"""


@query("kinase_activity_by_label", "K03 K04 K05 F10", shapes.with_("reps", "kinase_data", body=_KIN + """
SELECT Label AS "Label", kin AS "CTRL_GENE_NAME", n AS "N", sites, round(mean, 6) AS "meanLog2FC", round(z, 6) AS "Z", round(p, 7) AS "pValue", round(fdr, 6) AS "fdr_BH" FROM fin"""))
def _(t):
    d = S.prepare_site_results(shapes.site_results(t)).where("representative")
    k = K.kinase_activity_by_label(d, shapes.kinase_data(t))
    return k.select("Label", "CTRL_GENE_NAME", "N", "sites", R("meanLog2FC", 6).alias("meanLog2FC"), R("Z", 6).alias("Z"), R("pValue", 7).alias("pValue"), R("fdr_BH", 6).alias("fdr_BH"))


@query("kinase_matrix", "K07 R74", shapes.with_("reps", "kinase_data", body=_KIN + """
SELECT kin AS "CTRL_GENE_NAME", round(max(z) FILTER (Label = 'A-F'), 6) AS a_f, round(max(z) FILTER (Label = 'N-O'), 6) AS n_o FROM fin
WHERE kin IN (SELECT kin FROM fin WHERE fdr < 0.9 AND n >= 2) GROUP BY ALL"""))
def _(t):
    d = S.prepare_site_results(shapes.site_results(t)).where("representative")
    k = K.kinase_activity_by_label(d, shapes.kinase_data(t))
    m = K.kinase_matrix(k, "Z", ["A-F", "N-O"], 0.9)
    return m.select("CTRL_GENE_NAME", R("A-F", 6).alias("a_f"), R("N-O", 6).alias("n_o"))


@query("kinase_sea", "K06", None)
def _(t):
    d = S.prepare_site_results(shapes.site_results(t)).where("representative")
    m = K.kinase_map(d, shapes.kinase_data(t), ["Label"])
    return K.kinase_sea(m, d, center=True)
