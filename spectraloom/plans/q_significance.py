"""Significance and statistics queries."""

from pyspark.sql import functions as F

from spectraloom.functions.ordered import p_adjust_bh
from spectraloom.operators import significance as S
from spectraloom.plans import shapes
from spectraloom.plans.registry import query

R = F.round

# Tail areas for the SQL side come from Simpson sums, independent of the series used in Spark.
T_TAIL = """(exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * (pi() / 2 - atan({t} / sqrt({df}))) / 6000.0 *
  list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END *
    pow(abs(cos(atan({t} / sqrt({df})) + (pi() / 2 - atan({t} / sqrt({df}))) * i / 2000.0)), {df} - 1))))"""
NORMAL_TWO_SIDED = """(2 / sqrt(pi()) * exp(-({z}) * ({z}) / 2) * 8 / 3000.0 *
  list_sum(list_transform(range(0, 1001), lambda i: CASE WHEN i IN (0, 1000) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END *
    exp(-pow(i * 0.008, 2) - 2 * i * 0.008 * abs({z}) / sqrt(2.0)))))"""
HYPER_LOG10 = """(CASE WHEN least({w}, {n}) < {k} THEN NULL ELSE log10(least(1.0, list_sum(list_transform(range({k}, least({w}, {n}) + 1), lambda j:
   CASE WHEN {n} - j > {u} - {w} THEN 0.0 ELSE
   exp(lgamma({w} + 1) - lgamma(j + 1) - lgamma({w} - j + 1) + lgamma({u} - {w} + 1) - lgamma({n} - j + 1) - lgamma({u} - {w} - {n} + j + 1)
     - lgamma({u} + 1) + lgamma({n} + 1) + lgamma({u} - {n} + 1)) END)))) END)"""
SIG = """CASE WHEN log2FC = 'Infinity' THEN 'infiniteUp' WHEN log2FC = '-Infinity' THEN 'infiniteDown'
   WHEN abs(log2FC) > 1 AND pvalue < 0.05 AND log2FC > 0 THEN 'up' WHEN abs(log2FC) > 1 AND pvalue < 0.05 THEN 'down' ELSE 'not' END"""
GOLD = """CASE WHEN p_size % 4 = 0 THEN 'decoy' WHEN p_size % 4 = 1 THEN 'interactor' ELSE 'unknown' END"""


@query("define_significance", "F01 R29", shapes.with_("results", body=f"SELECT Protein, Label, log2FC, pvalue, {SIG} AS sig FROM results"))
def _(t):
    return S.define_significance(shapes.results(t)).select("Protein", "Label", "log2FC", "pvalue", "sig")


@query("rank_volcano_hits", "F02 R80", shapes.with_("results", body=f"""
, s AS (SELECT *, {SIG} AS sig, CASE WHEN isfinite(log2FC) THEN sqrt(log2FC * log2FC + pow(log10(pvalue), 2)) END AS d FROM results),
h AS (SELECT Protein, Label, rank() OVER w + (count(*) OVER (PARTITION BY Label, sig, d) - 1) / 2.0 AS r
  FROM s WHERE pvalue < 0.05 AND abs(log2FC) > 1 AND d IS NOT NULL WINDOW w AS (PARTITION BY Label, sig ORDER BY d DESC))
SELECT Protein, Label, sig, round(d, 6) AS volcanoDistance, CAST(r AS DOUBLE) AS rankVolcano FROM s LEFT JOIN h USING (Protein, Label)"""))
def _(t):
    d = S.rank_volcano_hits(S.define_significance(shapes.results(t)))
    return d.select("Protein", "Label", "sig", R("volcanoDistance", 6).alias("volcanoDistance"), "rankVolcano")


@query("p_adjust_bh", "F03 R82", shapes.with_("results", body="""
, r AS (SELECT Protein, Label, pvalue, rank() OVER (PARTITION BY Label ORDER BY pvalue) + count(*) OVER (PARTITION BY Label, pvalue) - 1 AS mx,
     count(*) OVER (PARTITION BY Label) AS n FROM results WHERE pvalue IS NOT NULL),
a AS (SELECT Protein, Label, least(1.0, min(pvalue * n / mx) OVER (PARTITION BY Label ORDER BY pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
SELECT Protein, Label, pvalue, round(q, 9) AS adj_pvalue FROM results LEFT JOIN a USING (Protein, Label)"""))
def _(t):
    d = p_adjust_bh(shapes.results(t), "pvalue", "q", ["Label"])
    return d.select("Protein", "Label", "pvalue", R("q", 9).alias("adj_pvalue"))


@query("p_adjust_bh_overall", "F03", shapes.with_("results", body="""
, r AS (SELECT Protein, Label, pvalue, rank() OVER (ORDER BY pvalue) + count(*) OVER (PARTITION BY pvalue) - 1 AS mx,
     count(*) OVER () AS n FROM results WHERE pvalue IS NOT NULL),
a AS (SELECT Protein, Label, least(1.0, min(pvalue * n / mx) OVER (ORDER BY pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r)
SELECT Protein, Label, round(q, 9) AS adj_pvalue FROM results LEFT JOIN a USING (Protein, Label)"""))
def _(t):
    d = p_adjust_bh(shapes.results(t), "pvalue", "q")
    return d.select("Protein", "Label", R("q", 9).alias("adj_pvalue"))


@query("significance_counts", "F04 R61", shapes.with_("results", body=f"""
, c AS (SELECT Label, sig, count(DISTINCT Protein) AS n FROM (SELECT *, {SIG} AS sig FROM results) GROUP BY ALL)
SELECT Label, sig, n, CAST(sum(n) OVER (PARTITION BY Label ORDER BY sig DESC ROWS UNBOUNDED PRECEDING) - n / 2.0 AS DOUBLE) AS ypos FROM c"""))
def _(t):
    return S.significance_counts(S.define_significance(shapes.results(t)))


@query("lower_ci", "F05 F10", shapes.with_("results", body=f"""
, d AS (SELECT DISTINCT DF FROM results),
b AS (WITH RECURSIVE b AS (SELECT DF, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS i FROM d
  UNION ALL SELECT DF, CASE WHEN tail > 0.025 THEN mid ELSE lo END, CASE WHEN tail > 0.025 THEN hi ELSE mid END, i + 1
  FROM (SELECT *, {T_TAIL.format(t='mid', df='DF')} AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE i < 48))) SELECT DF, lo AS q FROM b WHERE i = 48),
c AS (SELECT *, sign(log2FC) * (abs(log2FC) - q * SE) AS ci FROM results JOIN b USING (DF) WHERE isfinite(log2FC))
SELECT Protein, Label, log2FC, SE, DF, round(CASE WHEN sign(ci) <> sign(log2FC) THEN 0.0 ELSE ci END, 6) AS lower_ci FROM c"""))
def _(t):
    d = shapes.results(t).where(S.is_finite("log2FC"))
    ci = S.lower_ci(F.col("log2FC"), F.col("SE"), F.col("DF"))
    return d.select("Protein", "Label", "log2FC", "SE", "DF", R(ci, 6).alias("lower_ci"))


@query("p_above_threshold", "F05 F10", shapes.with_("results", body=f"""
, k AS (SELECT *, (abs(log2FC) - 1.0) / SE AS t FROM results WHERE isfinite(log2FC))
SELECT Protein, Label, round({T_TAIL.format(t='t', df='DF')}, 7) AS p_gt_1 FROM k"""))
def _(t):
    d = shapes.results(t).where(S.is_finite("log2FC"))
    return d.select("Protein", "Label", R(S.p_above(F.col("log2FC"), F.col("SE"), F.col("DF"), 1.0), 7).alias("p_gt_1"))


@query("p_with_s0", "F05 F10", shapes.with_("results", body=f"""
, k AS (SELECT *, abs(log2FC / (SE + 0.1)) AS t FROM results WHERE isfinite(log2FC))
SELECT Protein, Label, round(2 * {T_TAIL.format(t='t', df='DF')}, 7) AS p_s0 FROM k"""))
def _(t):
    d = shapes.results(t).where(S.is_finite("log2FC"))
    return d.select("Protein", "Label", R(S.p_s0(F.col("log2FC"), F.col("SE"), F.col("DF"), 0.1), 7).alias("p_s0"))


_RATIOS = """, c AS (SELECT grp, ont, count(*) AS k FROM gene_groups JOIN gmt USING (gene) GROUP BY ALL),
  g AS (SELECT grp, count(*) AS n FROM gene_groups GROUP BY ALL), m AS (SELECT ont, count(*) AS m FROM gmt GROUP BY ALL),
  u AS (SELECT count(DISTINCT gene) AS u FROM gmt),
  x AS (SELECT grp, ont, k, n, m, u FROM c JOIN g USING (grp) JOIN m USING (ont), u)"""


def _ratio_frame(t):
    groups, sets = shapes.gene_groups(t), shapes.gmt(t)
    c = groups.join(sets, "gene").groupBy("grp", "ont").agg(F.count(F.lit(1)).alias("k"))
    c = c.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    c = c.join(sets.groupBy("ont").agg(F.count(F.lit(1)).alias("m")), "ont")
    c = c.withColumn("u", F.lit(sets.select("gene").distinct().count()))
    return c.withColumn("GeneRatio", F.format_string("%d/%d", "k", "n")).withColumn("BgRatio", F.format_string("%d/%d", "m", "u"))


@query("term_ratios", "F06 F07 R100 R102", shapes.with_("gene_groups", "gmt", body=_RATIOS + """
SELECT grp, ont, round((k / CAST(nullif(n - k, 0) AS DOUBLE)) / nullif((m - k) / CAST(nullif((u - m) - (n - k), 0) AS DOUBLE), 0), 6) AS odds_ratio,
   round(k * k / CAST(n * m AS DOUBLE), 9) AS term_score, round(k / CAST(m + n - k AS DOUBLE), 9) AS jaccard FROM x"""))
def _(t):
    gr, br = F.col("GeneRatio"), F.col("BgRatio")
    return _ratio_frame(t).select(
        "grp", "ont",
        R(S.odds_ratio_from_ratios(gr, br), 6).alias("odds_ratio"),
        R(S.term_score(gr, br), 9).alias("term_score"),
        R(S.term_jaccard(gr, br), 9).alias("jaccard"),
    )


@query("mag_sig_score", "F08 R113", shapes.with_("results", body="""
SELECT Protein, Label, round(sqrt(2 * abs(log2FC) * least(-log10(pvalue), 2 * abs(log2FC))), 6) AS score FROM results WHERE pvalue IS NOT NULL"""))
def _(t):
    d = shapes.results(t).where(F.col("pvalue").isNotNull())
    return d.select("Protein", "Label", R(S.mag_sig_score(F.col("log2FC"), F.col("pvalue")), 6).alias("score"))


@query("welch_against_background", "F09 F10 R64", f"""
WITH s AS (SELECT p_brand AS protein, count(*) FILTER (l_returnflag = 'A') AS na, avg(l_discount) FILTER (l_returnflag = 'A') AS ma, var_samp(l_discount) FILTER (l_returnflag = 'A') AS va,
   count(*) FILTER (l_returnflag <> 'A') AS nb, avg(l_discount) FILTER (l_returnflag <> 'A') AS mb, var_samp(l_discount) FILTER (l_returnflag <> 'A') AS vb
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
k AS (SELECT protein, ma - mb AS estimate, (ma - mb) / sqrt(va / na + vb / nb) AS t,
   pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM s)
SELECT protein, round(estimate, 9) AS estimate, round(t, 6) AS t, round(df, 4) AS df, round(2 * {T_TAIL.format(t='abs(t)', df='df')}, 5) AS p FROM k""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    w = S.welch_against_background(d, ["p_brand"], "l_discount", F.col("l_returnflag") == "A")
    return w.select(F.col("p_brand").alias("protein"), R("estimate", 9).alias("estimate"), R("t", 6).alias("t"), R("df", 4).alias("df"), R("p", 5).alias("p"))


_ROC = f"""WITH d AS (SELECT l_returnflag AS treatment, {GOLD} AS label, round(l_discount * 100 + l_tax * 10, 1) AS p
   FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _roc_frame(t):
    size = F.col("p_size") % 4
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("treatment"),
        F.when(size == 0, "decoy").when(size == 1, "interactor").otherwise("unknown").alias("label"),
        F.round(F.col("l_discount") * 100 + F.col("l_tax") * 10, 1).alias("p"),
    )


@query("roc", "F12 R67 R81", _ROC + """
, c AS (SELECT p, count(*) FILTER (label = 'interactor') AS np, count(*) FILTER (label IN ('decoy', 'unknown')) AS nn, count(*) AS n FROM d GROUP BY ALL)
SELECT CAST(sum(n) OVER w - n + 1 AS BIGINT) AS scoreRank, p, np AS "numPositive", nn AS "numNegative",
   round(sum(np) OVER w / (SELECT CAST(sum(np) AS DOUBLE) FROM c), 9) AS tpr, round(sum(nn) OVER w / (SELECT CAST(sum(nn) AS DOUBLE) FROM c), 9) AS fpr
FROM c WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)""")
def _(t):
    r = S.roc(_roc_frame(t), "p")
    return r.select("scoreRank", "p", "numPositive", "numNegative", R("tpr", 9).alias("tpr"), R("fpr", 9).alias("fpr"))


@query("roc_by_group", "F13", _ROC + """
, c AS (SELECT treatment, p, count(*) FILTER (label = 'interactor') AS np, count(*) FILTER (label IN ('decoy', 'unknown')) AS nn, count(*) AS n FROM d GROUP BY ALL),
 tot AS (SELECT treatment, sum(np) AS tp, sum(nn) AS tn FROM c GROUP BY ALL)
SELECT treatment, CAST(sum(n) OVER w - n + 1 AS BIGINT) AS scoreRank, p, CAST(sum(np) OVER w AS BIGINT) AS "cumulPositives", CAST(sum(nn) OVER w AS BIGINT) AS "cumulNegatives",
   round(sum(np) OVER w / CAST(tp AS DOUBLE), 9) AS tpr, round(sum(nn) OVER w / CAST(tn AS DOUBLE), 9) AS fpr
FROM c JOIN tot USING (treatment) WINDOW w AS (PARTITION BY treatment ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    r = S.roc_by_group(_roc_frame(t), ["treatment"], "p", descending=True)
    return r.select("treatment", "scoreRank", "p", "cumulPositives", "cumulNegatives", R("tpr", 9).alias("tpr"), R("fpr", 9).alias("fpr"))


@query("score_by_gold_standard", "F14", _ROC + """
, c AS (SELECT treatment, p, count(*) FILTER (label = 'decoy') AS nd, count(*) FILTER (label = 'interactor') AS ni, count(*) AS n FROM d GROUP BY ALL),
 k AS (SELECT *, sum(nd) OVER w + 1 AS dc, sum(ni) OVER w + 1 AS ic FROM c WINDOW w AS (PARTITION BY treatment ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, log10(ic) - log10(2000) - (log10(dc) - log10(1000)) AS r FROM k)
SELECT treatment, p, label, count(*) AS n, CAST(any_value(dc) AS BIGINT) AS decoy_count, CAST(any_value(ic) AS BIGINT) AS interactor_count, round(any_value(m), 6) AS ratio
FROM (SELECT treatment, p, dc, ic, max(r) OVER (PARTITION BY treatment ORDER BY p ROWS UNBOUNDED PRECEDING) AS m FROM r) JOIN d USING (treatment, p) GROUP BY treatment, p, label""")
def _(t):
    s = S.score_by_gold_standard(_roc_frame(t), "p", 1000, 2000, label="label")
    return s.groupBy("treatment", "p", "label").agg(
        F.count(F.lit(1)).alias("n"), F.first("decoyCount").alias("decoy_count"), F.first("interactorCount").alias("interactor_count"),
        R(F.first("log10RateRatioID"), 6).alias("ratio"),
    )


@query("kernel_density", "F15", """
WITH v AS (SELECT l_returnflag, CAST(l_discount AS DOUBLE) AS v FROM lineitem WHERE l_discount IS NOT NULL), s AS (SELECT l_returnflag, min(v) - 0.03 AS lo, max(v) + 0.03 AS hi, count(*) AS n FROM v GROUP BY ALL),
a AS (SELECT l_returnflag, (v - lo) / ((hi - lo) / 4096) AS u FROM v JOIN s USING (l_returnflag)),
b AS (SELECT l_returnflag, j, sum(w) AS w FROM (SELECT l_returnflag, floor(u) AS j, 1 - (u - floor(u)) AS w FROM a UNION ALL SELECT l_returnflag, floor(u) + 1, u - floor(u) FROM a) GROUP BY ALL),
p AS (SELECT s.*, greatest(lo, 0) AS f, CAST(i AS INTEGER) AS i, greatest(lo, 0) + i * (hi - greatest(lo, 0)) / 511 AS x FROM s, range(512) r(i))
SELECT l_returnflag, i, round(x, 9) AS x, round(sum(w * (exp(-pow((x - (lo + j * (hi - lo) / 4096)) / 0.01, 2) / 2) + exp(-pow((x + (lo + j * (hi - lo) / 4096)) / 0.01, 2) / 2))) / any_value(n) / (0.01 * sqrt(2 * pi())), 6) AS density
FROM p JOIN b USING (l_returnflag) GROUP BY l_returnflag, i, x""")
def _(t):
    d = S.kernel_density(t.lineitem, ["l_returnflag"], "l_discount", 0.01, (0.0, float("inf")))
    return d.select("l_returnflag", "i", R("x", 9).alias("x"), R("density", 6).alias("density"))

