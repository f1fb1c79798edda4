"""Bait-prey queries: supplier nations as baits, parts as preys, quantities as spectral counts."""

from pyspark.sql import functions as F

from spectraloom.operators import apms as A
from spectraloom.plans import shapes
from spectraloom.plans.q_graph import strong
from spectraloom.plans.q_significance import HYPER_LOG10, T_TAIL
from spectraloom.plans.registry import query

R = F.round

_CTRL = "('NATION_0', 'NATION_1', 'NATION_2')"

shapes.cte("zrows", f"""SELECT run, bait, prey, CASE WHEN bait IN {_CTRL} THEN 'control' ELSE bait END AS eg, ln(spc) / ln(2.0) AS v, bait = prey AS ex FROM apms""", "apms")


def _zrows(t):
    v = F.log2("spc")
    return shapes.apms(t).select(
        "run", "bait", F.col("prey").alias("preyProtein"), F.col("prey").alias("preyGene"), F.when(F.col("bait").isin("NATION_0", "NATION_1", "NATION_2"), "control").otherwise(F.col("bait")).alias("excludeGroup"),
        v.alias("log2Intensity"), v.alias("replaceNA"),
    )


_Z = """, o AS (SELECT prey, bait, eg, count(*) AS nt, avg(v) AS mt, var_samp(v) AS vt FROM zrows GROUP BY ALL),
 b AS (SELECT o.prey, o.bait, o.eg, median(x.v) AS med, mad(x.v) * 1.4826 AS mad, count(*) AS nb, avg(x.v) AS mb, var_samp(x.v) AS vb FROM o JOIN zrows x ON o.prey = x.prey AND x.eg <> o.eg AND NOT x.ex GROUP BY ALL)"""


@query("zmadex", "G02 R63 R85", shapes.with_("zrows", body=_Z + """
SELECT run, bait, prey AS "preyProtein", round(med, 6) AS median_exc, round(mad, 6) AS mad_exc, round((v - med) / nullif(mad, 0), 5) AS "Zmadex", round(mt - mb, 6) AS "t_log2FC" FROM zrows LEFT JOIN b USING (prey, bait, eg) LEFT JOIN o USING (prey, bait, eg)"""))
def _(t):
    d = A.zmadex(A.exclude_bait_as_prey(_zrows(t)))
    return d.select("run", "bait", "preyProtein", R("median_exc", 6).alias("median_exc"), R("mad_exc", 6).alias("mad_exc"), R("Zmadex", 5).alias("Zmadex"), R("t_log2FC", 6).alias("t_log2FC"))


@query("zmadex_t_test", "G02 F09", shapes.with_("zrows", body=_Z + f"""
, k AS (SELECT bait, prey, (mt - mb) / sqrt(vt / nt + vb / nb) AS t, pow(vt / nt + vb / nb, 2) / (pow(vt / nt, 2) / (nt - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM o JOIN b USING (prey, bait, eg) WHERE nt > 1 AND nb > 1 AND vt / nt + vb / nb > 0)
SELECT bait, prey AS "preyProtein", round(2 * {T_TAIL.format(t='abs(t)', df='df')}, 4) AS t_test_p FROM k WHERE df >= 3"""))
def _(t):
    d = A.zmadex(A.exclude_bait_as_prey(_zrows(t)))
    z = d.groupBy("bait", "preyProtein").agg(F.first("t_test_p").alias("p"))
    # degrees of freedom under 3 make the SQL side's integrand singular; they are tested on fixtures
    w = A.welch_from_moments(_moments(t)).where((F.col("n_t") > 1) & (F.col("n_b") > 1) & (F.col("df") >= 3)).select("bait", "preyProtein")
    return z.join(w, ["bait", "preyProtein"]).select("bait", "preyProtein", R("p", 4).alias("t_test_p"))


def _moments(t):
    z = A.exclude_bait_as_prey(_zrows(t))
    own = z.groupBy("preyProtein", "bait", "excludeGroup").agg(F.count("log2Intensity").alias("n_t"), F.avg("log2Intensity").alias("m_t"), F.var_samp("log2Intensity").alias("v_t"))
    other = z.where(~F.col("excludeGlobally")).select(F.col("preyProtein").alias("_p"), F.col("excludeGroup").alias("_g"), F.col("log2Intensity").alias("_v"))
    j = own.join(other, (F.col("preyProtein") == F.col("_p")) & (F.col("excludeGroup") != F.col("_g")))
    return j.groupBy("preyProtein", "bait", "excludeGroup", "n_t", "m_t", "v_t").agg(F.count("_v").alias("n_b"), F.avg("_v").alias("m_b"), F.var_samp("_v").alias("v_b"))


@query("empirical_p", "G02 R94", shapes.with_("zrows", body=_Z + """
, z AS (SELECT run, bait, prey, eg, round((v - med) / nullif(mad, 0), 6) AS z FROM zrows LEFT JOIN b USING (prey, bait, eg)),
c AS (SELECT z, count(*) FILTER (eg = 'control') AS n FROM z WHERE z IS NOT NULL GROUP BY z), e AS (SELECT z, 1 - sum(n) OVER (ORDER BY z) / CAST(sum(n) OVER () AS DOUBLE) AS p FROM c)
SELECT run, bait, prey AS "preyProtein", round(CASE WHEN p <= 1e-12 THEN (SELECT min(p) FROM e WHERE p > 1e-12) / 2 ELSE p END, 7) AS "p_Z" FROM z LEFT JOIN e USING (z)"""))
def _(t):
    d = A.zmadex(A.exclude_bait_as_prey(_zrows(t))).withColumn("Zmadex", R("Zmadex", 6))
    return A.empirical_p(d).select("run", "bait", "preyProtein", R("p_Z", 7).alias("p_Z"))


def _partial(t):
    """Complete prey x run table with explicit nulls."""
    from spectraloom.operators.relational import complete_grid

    z = shapes.apms(t).select("run", F.col("prey").alias("preyProtein"), F.log2("spc").alias("log2Intensity"))
    g = complete_grid(z, ["preyProtein"], "run", "log2Intensity")
    bait = F.substring_index("run", "_", 2)
    return g.select("preyProtein", "run", bait.alias("bait"), F.when(bait.isin("NATION_0", "NATION_1", "NATION_2"), "control").otherwise(bait).alias("excludeGroup"), "log2Intensity")


@query("impute_missing_by_prey", "G01", None)
def _(t):
    return A.impute_missing_by_prey(_partial(t)).select("preyProtein", "run", "log2Intensity", "predicted", "SD", "replaceNA")


@query("compute_zmadex", "G01 G02", None)
def _(t):
    return A.compute_zmadex(_partial(t)).select("preyProtein", "run", "Zmadex", "t_test_p", "p_Z")


@query("specificity", "G03", shapes.with_("apms", body="""
SELECT prey, bait, round(sum(spc) / CAST(sum(sum(spc)) OVER (PARTITION BY prey) AS DOUBLE), 9) AS specificity FROM apms GROUP BY prey, bait"""))
def _(t):
    return A.specificity(shapes.apms(t)).withColumn("specificity", R("specificity", 9))


@query("specificity_permutation", "G04", None)
def _(t):
    from spectraloom.operators.relational import complete_grid

    g = complete_grid(shapes.apms(t).select("prey", "run", "spc"), ["prey"], "run", "spc", 0).withColumn("bait", F.substring_index("run", "_", 2))
    return A.specificity_permutation(g)


def _lg(x):
    return f"lgamma({x} + 1)"


_GP = "(ln(({m}) * (1 - ({o}))) + (({x}) - 1) * ln(({m}) * (1 - ({o})) + ({x}) * ({o})) - (({m}) * (1 - ({o})) + ({x}) * ({o})) - lgamma(({x}) + 1))"
_SAINT = f"""
, runs AS (SELECT DISTINCT run, bait, CASE WHEN bait IN {_CTRL} THEN 'C' ELSE 'T' END AS tr FROM apms),
g AS (SELECT r.run, r.bait, r.tr, p.prey, CAST(CASE WHEN r.bait = p.prey THEN 0 ELSE coalesce(a.spc, 0) END AS DOUBLE) AS x FROM runs r CROSS JOIN (SELECT DISTINCT prey FROM apms) p LEFT JOIN apms a ON a.run = r.run AND a.prey = p.prey),
c AS (SELECT prey, greatest(avg(x), 0.1) AS m, var_samp(x) AS v FROM g WHERE tr = 'C' GROUP BY ALL),
t AS (SELECT g.*, m, CASE WHEN v > m THEN greatest(1 - sqrt(m / v), 0.1) ELSE 0.1 END AS o FROM g JOIN c USING (prey) WHERE tr = 'T'),
l AS (SELECT *, {_GP.format(m='5 * m', o='0.1', x='least(x, 5 * m)')} AS lt, {_GP.format(m='m', o='o', x='greatest(x, m)')} AS lf FROM t)"""
_FIN = """, s AS (SELECT bait, prey, avg(x) AS spec, avg(CASE WHEN x <= 1 OR x < m THEN 0 ELSE {prior} / ({prior} + exp(least(lf - lt, 700))) END) AS score, avg(x / m) AS fc FROM l GROUP BY ALL)
SELECT bait, prey, round(spec, 6) AS "avgSpec", round(score, 6) AS "avgScore", round(fc, 6) AS "foldChange",
  round(CASE WHEN (SELECT max(score) FROM s) - score < 1e-11 THEN 0 ELSE 1 - sum(score) OVER b / count(*) OVER b END, 4) AS bfdr
FROM s WINDOW b AS (ORDER BY round(score, 11) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 0.000000000001 PRECEDING)"""


def _saint_inputs(t):
    a = shapes.apms(t)
    baits = a.select("run", "bait").distinct().withColumn("treatment", F.when(F.col("bait").isin("NATION_0", "NATION_1", "NATION_2"), "C").otherwise("T"))
    preys = a.select("prey").distinct().withColumn("preyGene", F.col("prey"))
    return a.select("run", "prey", "spc"), baits, preys


@query("saint_spc_fixed_prior", "G05 G06 R47 R114", shapes.with_("apms", body=_SAINT + """, s AS (SELECT bait, prey, avg(x) AS spec, avg(CASE WHEN x <= 1 OR x < m THEN 0 ELSE exp(-1.0) / (exp(-1.0) + exp(least(lf - lt, 700))) END) AS score, avg(x / m) AS fc, round(max(o), 6) AS "controlOmega",
  string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), '|' ORDER BY run) AS "treatCounts", 'experimentalControls' AS "controlSource", count(*) AS runs, round(max(m), 3) AS top FROM l GROUP BY ALL),
d AS (SELECT score, count(*) AS c FROM s GROUP BY score), w AS (SELECT score, sum(c) OVER b AS n, sum(c * score) OVER b AS total FROM d WINDOW b AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT bait, prey, round(spec, 6) AS "avgSpec", round(s.score, 6) AS "avgScore", round(fc, 6) AS "foldChange", "controlOmega", "treatCounts", "controlSource", runs AS "controlMeans", round(CASE WHEN n IS NULL THEN 0 ELSE 1 - total / n END, 3) AS bfdr
FROM s JOIN w ON w.score = s.score"""))
def _(t):
    d, _ = A.saint_spc(*_saint_inputs(t), beta1=-1.0)
    return d.select(
        "bait", "prey", R("avgSpec", 6).alias("avgSpec"), R("avgScore", 6).alias("avgScore"), R("foldChange", 6).alias("foldChange"), R("controlOmega", 6).alias("controlOmega"), "treatCounts", "controlSource",
        F.size(F.split("controlMean", "\\|")).cast("bigint").alias("controlMeans"), R("bfdr", 3).alias("bfdr"),
    )


@query("saint_spc", "G05 G06", None)
def _(t):
    return A.saint_spc(*_saint_inputs(t))[0]


@query("bfdr", "G06 R81", shapes.with_("apms", body="""
, s AS (SELECT bait, prey, round(CAST(sum(spc) AS DOUBLE) / 500, 3) AS score FROM apms GROUP BY ALL),
d AS (SELECT score, count(*) AS c FROM s GROUP BY ALL), w AS (SELECT score, sum(c) OVER b AS n, sum(c * score) OVER b AS t FROM d WINDOW b AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT bait, prey, score, round(CASE WHEN n IS NULL THEN 0 ELSE 1 - t / n END, 9) AS bfdr FROM s JOIN w USING (score)"""))
def _(t):
    s = shapes.apms(t).groupBy("bait", "prey").agg(R(F.sum("spc") / 500, 3).alias("score"))
    return A.bfdr(s, "score").select("bait", "prey", "score", R("bfdr", 9).alias("bfdr"))


@query("pseudo_control_stats", "G07", shapes.with_("apms", body="""
, n AS (SELECT count(DISTINCT run) AS n FROM apms WHERE bait IN ('NATION_0', 'NATION_1')),
c AS (SELECT prey, sum(spc) / CAST(n AS DOUBLE) AS m, (sum(spc * spc) - n * pow(sum(spc) / CAST(n AS DOUBLE), 2)) / (n - 1) AS v FROM apms, n WHERE bait IN ('NATION_0', 'NATION_1') GROUP BY prey, n)
SELECT run, bait, a.prey, CAST(spc AS DOUBLE) AS mean, round(coalesce(CASE WHEN v > m THEN greatest(1 - sqrt(m / v), 0.1) END, 0.1), 7) AS omega FROM apms a LEFT JOIN c USING (prey) WHERE bait NOT IN ('NATION_0', 'NATION_1')"""))
def _(t):
    a = shapes.apms(t)
    ctl = F.col("bait").isin("NATION_0", "NATION_1")
    d = a.withColumn("run", F.when(ctl, F.col("run")).otherwise(F.concat("run", F.lit("-fake")))).withColumn("bait", F.when(ctl, F.col("bait")).otherwise(F.concat("bait", F.lit("-fake"))))
    return A.pseudo_control_stats(d, "^NATION_[01]$").withColumn("omega", R("omega", 7)).select("run", "bait", "prey", "mean", "omega")


def _complexes(t):
    gene = F.concat(F.lit("g"), F.col("l_partkey").cast("string"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("complex_id")).agg(F.array_join(F.array_sort(F.collect_set(gene)), ";").alias("subunits_gene_name")).withColumn("complex_name", F.col("complex_id").cast("string"))


@query("corum_pairs_ordered", "G08 R49", """SELECT DISTINCT a.l_orderkey AS complex_id, 'g' || CAST(a.l_partkey AS VARCHAR) AS gene1, 'g' || CAST(b.l_partkey AS VARCHAR) AS gene2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey""")
def _(t):
    return A.corum_pairs(_complexes(t)).select("complex_id", "gene1", "gene2")


@query("corum_pairs", "G08", """SELECT DISTINCT a.l_orderkey AS complex_id, 'g' || CAST(a.l_partkey AS VARCHAR) AS gene1, 'g' || CAST(b.l_partkey AS VARCHAR) AS gene2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE 'g' || CAST(a.l_partkey AS VARCHAR) < 'g' || CAST(b.l_partkey AS VARCHAR)""")
def _(t):
    return A.corum_pairs(_complexes(t), ordered=False).select("complex_id", "gene1", "gene2")


_GS = """, c AS (SELECT DISTINCT least(x, y) AS gene1, greatest(x, y) AS gene2 FROM (SELECT 'g' || CAST(a.l_partkey AS VARCHAR) AS x, 'g' || CAST(b.l_partkey AS VARCHAR) AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey) WHERE x <> y),
 s AS (SELECT DISTINCT least(protein1, protein2) AS gene1, greatest(protein1, protein2) AS gene2 FROM links WHERE combined_score > 400),
 u AS (SELECT *, 'corum' AS src FROM c UNION ALL SELECT *, 'string' FROM s),
 genes AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS g FROM supplier UNION ALL SELECT 'g' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_type <> 'ECONOMY')"""


def _genes(t):
    return t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene")).unionByName(
        t.part.where(F.col("p_type") != "ECONOMY").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"))
    )


@query("gold_standard_pairs", "G09 R89 R66", shapes.with_("links", body=_GS + """
SELECT gene1, gene2, string_agg(DISTINCT src, ';' ORDER BY src) AS source FROM u WHERE gene1 IN (SELECT g FROM genes) AND gene2 IN (SELECT g FROM genes) GROUP BY ALL"""))
def _(t):
    return A.gold_standard_pairs(shapes.links(t), _complexes(t), genes=_genes(t), threshold=400)


@query("gold_standard_matching", "G09 W13", None)
def _(t):
    return A.gold_standard_pairs(shapes.links(t), None, genes=_genes(t), threshold=400, simplify="matching")


@query("decoy_pairs", "G10 R51", shapes.with_("pairs2", body="""
, h AS (WITH RECURSIVE r AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM pairs2 WHERE src LIKE 's%' UNION SELECT r.source, b.dst, r.hops + 1 FROM r JOIN pairs2 b ON r.node = b.src WHERE r.hops < 5) SELECT DISTINCT source, node FROM r),
n AS (SELECT DISTINCT src FROM pairs2)
SELECT b.src AS gene1, p.src AS gene2 FROM n b, n p WHERE b.src LIKE 's%' AND p.src LIKE 'g%' AND NOT EXISTS (SELECT 1 FROM h WHERE source = b.src AND node = p.src)"""))
def _(t):
    s = strong(t)
    links = s.select(F.col("src").alias("protein1"), F.col("dst").alias("protein2"), "combined_score")
    baits = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"))
    preys = t.part.select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"))
    return A.decoy_pairs(links, baits, preys, threshold=0)


_OV = f""", z AS (SELECT bait, count(*) AS n FROM bait_prey GROUP BY ALL), k AS (SELECT a.bait AS x, b.bait AS y, count(*) AS k FROM bait_prey a JOIN bait_prey b ON a.prey = b.prey AND a.bait < b.bait GROUP BY ALL),
 p AS (SELECT a.bait AS bait1, b.bait AS bait2, a.n AS na, b.n AS nb, coalesce(k, 0) AS shared FROM z a JOIN z b ON a.bait < b.bait LEFT JOIN k ON x = a.bait AND y = b.bait)
SELECT bait1, bait2, shared, round(pow(10, {HYPER_LOG10.format(k='shared', w='na', u='200000', n='nb')}), 6) AS "fisherP" FROM p"""


@query("prey_overlap_fisher", "G11 F11", shapes.with_("bait_prey", body=_OV))
def _(t):
    return A.prey_overlap_fisher(shapes.bait_prey(t), background=200000).withColumn("fisherP", R("fisherP", 6))


@query("prey_overlap_fisher_between", "G12 F11", shapes.with_("bait_prey", body=_OV.replace("a.bait < b.bait GROUP", "a.bait <> b.bait GROUP").replace(
    "ON a.bait < b.bait LEFT", "ON right(a.bait, 1) < '5' AND right(b.bait, 1) >= '5' LEFT")))
def _(t):
    d = shapes.bait_prey(t)
    low = F.substring("bait", -1, 1) < "5"
    return A.prey_overlap_fisher_between(d.where(low), d.where(~low), background=200000).withColumn("fisherP", R("fisherP", 6))


@query("prey_size_windows", "G13", """
WITH z AS (SELECT n, count(*) AS c FROM (SELECT l_custkey, count(DISTINCT l_partkey) AS n FROM (SELECT o_custkey AS l_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL) GROUP BY ALL),
 i AS (SELECT unnest(range(1, (SELECT max(n) + 1 FROM z))) AS i), r AS (SELECT i, unnest(range(0, (SELECT max(n) FROM z))) AS r FROM i),
 w AS (SELECT i, r, sum(c) AS s FROM r JOIN z ON n BETWEEN i - r AND i + r GROUP BY ALL)
SELECT i AS "countPrey", coalesce((SELECT c FROM z WHERE n = i), 0) AS "numBaitsWithCP", coalesce((SELECT min(r) FROM w WHERE w.i = i.i AND s > 100), (SELECT max(n) FROM z)) AS "windowSize" FROM i""")
def _(t):
    d = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("bait"), F.col("l_partkey").alias("prey"))
    return A.prey_size_windows(d)


def _background(t):
    d = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("bait"), F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("prey")).distinct()


@query("size_matched_sample", "G14", None)
def _(t):
    own = shapes.apms(t).groupBy("bait").agg((F.countDistinct("prey") % 60 + 10).alias("countPrey")).withColumn("windowRadius", F.lit(5))
    return A.size_matched_sample(own, _background(t).groupBy("bait").agg(F.countDistinct("prey").alias("countPrey")), 1000)


@query("convergence_test", "G15", None)
def _(t):
    return A.convergence_test(shapes.apms(t).select("bait", "prey").distinct(), _background(t))


@query("bioplex_pairs", "G16", shapes.with_("bait_prey", body="SELECT bait, prey FROM bait_prey"))
def _(t):
    return A.bioplex_pairs(shapes.bait_prey(t).withColumnsRenamed({"bait": "Bait Symbol", "prey": "Prey Symbol"}))
