"""Per-key model, location, factorization and projection queries."""

from pyspark.sql import functions as F

from spectraloom.functions.session import cut
from spectraloom.operators import factorscan, mixed
from spectraloom.operators import models as M
from spectraloom.plans import shapes
from spectraloom.plans.q_significance import T_TAIL
from spectraloom.plans.registry import query

R = F.round

shapes.cte("li", """SELECT p_brand AS brand, l_returnflag AS grp, l_linestatus AS subj, l_discount AS y FROM lineitem JOIN part ON l_partkey = p_partkey""")


def li(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("brand"), F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("subj"), F.col("l_discount").alias("y"), F.col("p_size").alias("size"))


_G = f""", g AS (SELECT brand, grp, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM li GROUP BY ALL), p AS (SELECT brand, sum((n - 1) * v) AS rss, sum(n) - count(*) AS df FROM g GROUP BY ALL),
 d AS (SELECT a.brand, a.grp || '-' || b.grp AS contrast, a.m - b.m AS e, sqrt(rss / df * (1.0 / a.n + 1.0 / b.n)) AS se, CAST(df AS BIGINT) AS df FROM g a JOIN g b ON a.brand = b.brand AND a.grp < b.grp JOIN p ON p.brand = a.brand)
SELECT brand, contrast, round(e, 8) AS estimate, round(se, 8) AS "SE", df, round(2 * {T_TAIL.format(t='abs(e / se)', df='df')}, 4) AS p FROM d"""


@query("one_factor_means", "M01 M03 F10", shapes.with_("li", body=_G))
def _(t):
    d = M.one_factor_means(li(t), ["brand"], "grp", "y")
    return d.select("brand", "contrast", R("estimate", 8).alias("estimate"), R("SE", 8).alias("SE"), "df", R("p", 4).alias("p"))


@query("linear_models_contrasts", "M01 M03 R76 R122 R123", shapes.with_("li", body=_G))
def _(t):
    d = M.linear_models(li(t), "brand", "y", {"one": ["grp"]}, "grp").where(F.col("kind") == "contrast")
    return d.select("brand", F.col("term").alias("contrast"), R("estimate", 8).alias("estimate"), R("SE", 8).alias("SE"), F.col("df").cast("bigint").alias("df"), R("p", 4).alias("p"))


@query("linear_models_anova", "M01", shapes.with_("li", body="""
, c AS (SELECT brand, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM li GROUP BY ALL), g AS (SELECT brand, grp, count(*) AS n, avg(y) AS m FROM li GROUP BY ALL),
b AS (SELECT brand, sum(n * m * m) AS bt, count(*) AS k FROM g GROUP BY ALL)
SELECT brand, round(bt - s * s / n, 8) AS ss_group, round(q - bt, 6) AS ss_residual, round(((bt - s * s / n) / (k - 1)) / ((q - bt) / (n - k)), 5) AS f FROM c JOIN b USING (brand)"""))
def _(t):
    d = M.linear_models(li(t), "brand", "y", {"one": ["grp"]}).where(F.col("kind") == "anova")
    term = F.col("term") == "grp"
    return d.groupBy("brand").agg(R(F.max(F.when(term, F.col("estimate"))), 8).alias("ss_group"), R(F.max(F.when(~term, F.col("estimate"))), 6).alias("ss_residual"), R(F.max(F.when(term, F.col("stat"))), 5).alias("f"))


@query("linear_models_two_factors", "M01", None)
def _(t):
    return M.linear_models(li(t), "brand", "y", {"additive": ["grp", "subj"], "interaction": ["grp", "subj", "grp:subj"], "slope": ["size", "grp"]}, "grp")


@query("mixed_models", "M02", None)
def _(t):
    return mixed.mixed_models(li(t), "brand", "y", ["grp"], "subj", "grp")


shapes.cte("balanced", """SELECT s AS key, p AS subject, q AS grp, avg(l_discount) AS y FROM (SELECT l_linestatus AS s, p_size AS p, l_returnflag AS q, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N')
   GROUP BY ALL HAVING s = 'F'""")


@query("random_intercept", "M02", shapes.with_("balanced", body="""
, f AS (SELECT * FROM balanced WHERE subject IN (SELECT subject FROM balanced GROUP BY subject HAVING count(*) = 2)),
m AS (SELECT *, avg(y) OVER (PARTITION BY subject) AS ms, avg(y) OVER (PARTITION BY grp) AS mg, avg(y) OVER () AS mm FROM f),
v AS (SELECT count(DISTINCT subject) AS s, sum(pow(y - ms - mg + mm, 2)) / (count(DISTINCT subject) - 1) AS within, 2 * sum(pow(ms - mm, 2)) / 2 / (count(DISTINCT subject) - 1) AS between FROM m),
w AS (SELECT s, CASE WHEN between > within THEN within ELSE (within + between) / 2 END AS e, greatest(0, (between - within) / 2) AS u FROM v),
d AS (SELECT max(mg) FILTER (grp = 'A') - max(mg) FILTER (grp = 'R') AS d FROM m)
SELECT 'variance' AS kind, 'subject' AS term, round(u, 7) AS estimate, CAST(NULL AS DOUBLE) AS "SE" FROM w UNION ALL SELECT 'variance', 'residual', round(e, 7), NULL FROM w
UNION ALL SELECT 'contrast', 'A-R', round(d, 7), round(sqrt(2 * e / s), 7) FROM w, d"""))
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where("l_returnflag <> 'N' and l_linestatus = 'F'")
    d = d.groupBy(F.col("l_linestatus").alias("key"), F.col("p_size").cast("string").alias("subject"), F.col("l_returnflag").alias("grp")).agg(F.avg("l_discount").alias("y"))
    both = d.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    m = mixed.mixed_models(d.join(both, "subject", "left_semi"), "key", "y", ["grp"], "subject", "grp").where(F.col("kind").isin("variance", "contrast"))
    return m.select("kind", "term", R("estimate", 7).alias("estimate"), R("SE", 7).alias("SE"))


@query("contrasts_vs_control", "M03", shapes.with_("li", body=_G.replace("SELECT brand, contrast, round(e, 8) AS estimate", "SELECT brand, CASE WHEN contrast = 'A-N' THEN 'N-A' ELSE 'R-A' END AS contrast, round(-e, 8) AS estimate").replace(
    ', round(se, 8) AS "SE", df, round(2', ", round(2") + " WHERE contrast LIKE 'A-%'"))
def _(t):
    d = M.contrasts_vs_control(M.linear_models(li(t), "brand", "y", {"one": ["grp"]}, "grp"), "A")
    return d.select("brand", F.col("term").alias("contrast"), R("estimate", 8).alias("estimate"), R("p", 4).alias("p"))


_SECOND = _G[: _G.index("SELECT brand, contrast,")] + f""", c AS (SELECT * FROM (VALUES ('A-N', 'A-R', 0, -1, 1), ('A-N', 'N-R', 1, -2, 1), ('A-R', 'N-R', 1, -1, 0)) v(one, two, ca, cn, cr)),
 w AS (SELECT brand, max(m) FILTER (grp = 'A') AS ma, max(m) FILTER (grp = 'N') AS mn, max(m) FILTER (grp = 'R') AS mr, max(n) FILTER (grp = 'A') AS na, max(n) FILTER (grp = 'N') AS nn, max(n) FILTER (grp = 'R') AS nr FROM g GROUP BY ALL),
 s AS (SELECT brand, one || ' - ' || two AS term, ca * ma + cn * mn + cr * mr AS e, sqrt(rss / df * (ca * ca / CAST(na AS DOUBLE) + cn * cn / CAST(nn AS DOUBLE) + cr * cr / CAST(nr AS DOUBLE))) AS se, CAST(df AS BIGINT) AS df FROM w JOIN p USING (brand), c)
SELECT brand, term, round(e, 8) AS estimate, round(se, 8) AS "SE", round(2 * {T_TAIL.format(t='abs(e / se)', df='df')}, 4) AS p FROM s"""


@query("contrast_of_contrasts", "M03", shapes.with_("li", body=_SECOND))
def _(t):
    d = M.contrast_of_contrasts(li(t), "brand", "y", {"one": ["grp"]}, "grp")
    return d.select("brand", "term", R("estimate", 8).alias("estimate"), R("SE", 8).alias("SE"), R("p", 4).alias("p"))


@query("group_means_and_residuals", "M04", shapes.with_("run_level", body="""
SELECT Protein AS "Protein", RUN AS "RUN", round(LogIntensities - avg(LogIntensities) OVER (PARTITION BY Protein, GROUP_ORIGINAL), 7) AS residual, round(LogIntensities, 7) AS total FROM run_level"""))
def _(t):
    d = M.group_means_and_residuals(cut(shapes.run_level(t)), "Protein", "LogIntensities", "GROUP_ORIGINAL", ["GROUP_ORIGINAL"])
    return d.select("Protein", "RUN", R("residual", 7).alias("residual"), R("groupMeanPlusResidual", 7).alias("total"))


def _batched(t):
    return cut(shapes.run_level(t).withColumn("SUBJECT", F.split("SUBJECT_ORIGINAL", r"\.")[1]))


@query("predictions_over_grid", "M05", shapes.with_("run_level", body="""
, x AS (SELECT Protein AS "Protein", GROUP_ORIGINAL, split_part(SUBJECT_ORIGINAL, '.', 2) AS "SUBJECT", LogIntensities AS v FROM run_level)
SELECT "Protein", GROUP_ORIGINAL AS "GROUP_ORIGINAL", "SUBJECT", round(avg(v) OVER (PARTITION BY "Protein", GROUP_ORIGINAL) + avg(v) OVER (PARTITION BY "Protein", "SUBJECT") - avg(v) OVER (PARTITION BY "Protein"), 6) AS fitted, round(v, 6) AS actual FROM x"""))
def _(t):
    d = M.predictions_over_grid(_batched(t), "Protein", "LogIntensities", ["GROUP_ORIGINAL", "SUBJECT"])
    return d.select("Protein", "GROUP_ORIGINAL", "SUBJECT", R("fitted", 6).alias("fitted"), R("actual", 6).alias("actual"))


def _timed(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.select(F.col("p_brand").alias("Protein"), F.col("l_linenumber").alias("rankTime"), (F.col("l_suppkey") % 3).cast("string").alias("SUBJECT"), F.log2("l_extendedprice").alias("LogIntensities"))


@query("fit_polynomial_powers", "M06", None)
def _(t):
    return M.fit_polynomial_powers(_timed(t), "Protein").drop("predictions", "coefficients")


@query("poly_fits_table", "M07", None)
def _(t):
    return M.poly_fits_table(M.fit_polynomial_powers(_timed(t), "Protein"), "Protein").drop("predictions")


@query("poly_actual_matrix", "M07", """
WITH m AS (SELECT p_brand, l_linenumber, avg(log2(l_extendedprice)) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_brand AS "Protein", l_linenumber AS "rankTime", round(v - first_value(v) OVER (PARTITION BY p_brand ORDER BY l_linenumber), 7) AS value FROM m""")
def _(t):
    return M.poly_actual_matrix(_timed(t), "Protein", "rankTime", "LogIntensities").withColumn("value", R("value", 7))


@query("detrended_fits", "M08", None)
def _(t):
    a = _timed(t).groupBy(F.col("Protein").alias("gene"), F.concat_ws("-", "SUBJECT", F.col("rankTime").cast("string")).alias("column")).agg(F.avg(F.pow(F.lit(2.0), "LogIntensities")).alias("value"))
    a = cut(a)
    p = a.groupBy("gene").agg(F.avg("value").alias("value")).join(a.select("gene", "column"), "gene")
    part = F.split("column", "-")
    info = a.select("column").distinct().select("column", F.lit("R1").alias("receptor"), part[1].cast("int").alias("rankTime"), part[0].alias("SUBJECT"))
    return M.detrended_fits(a, p, info)


shapes.cte("lin", """SELECT Protein AS "Protein", GROUP_ORIGINAL AS g, pow(2, avg(LogIntensities)) / 1000 AS x FROM run_level GROUP BY ALL""", "run_level")


def _refs(t):
    m = cut(shapes.run_level(t).groupBy("Protein", F.col("GROUP_ORIGINAL").alias("location")).agg((F.pow(F.lit(2.0), F.avg("LogIntensities")) / 1000).alias("value")))
    return m


@query("location_fit_one_reference", "M09", shapes.with_("lin", body="""
SELECT a.g AS run, 'AF' AS location, round(sum(a.x * b.x) / sum(b.x * b.x), 7) AS coefficient FROM lin a JOIN lin b ON a."Protein" = b."Protein" AND b.g = 'AF' GROUP BY ALL"""))
def _(t):
    m = _refs(t)
    f = M.location_fit(m.withColumnRenamed("value", "y"), m.where(F.col("location") == "AF"), "Protein", "location", "y")
    return f.select("run", "location", R("coefficient", 7).alias("coefficient"))


@query("location_fit", "M09", None)
def _(t):
    m = _refs(t)
    return M.location_fit(m.withColumnRenamed("value", "y"), m.where(F.col("location").isin("AF", "NF", "RF")), "Protein", "location", "y", decoys=2, iterations=5)


@query("location_residuals", "M09", None)
def _(t):
    m = _refs(t)
    s, r = m.withColumnRenamed("value", "y"), m.where(F.col("location").isin("AF", "NF"))
    return M.location_residuals(s, r, M.location_fit(s, r, "Protein", "location", "y"), "Protein", "location", "y")


@query("location_matrix", "M13", shapes.with_("run_level", body="""
, b AS (SELECT Protein AS p, avg(LogIntensities) AS b FROM run_level WHERE GROUP_ORIGINAL = 'AF' GROUP BY ALL), m AS (SELECT Protein AS p, GROUP_ORIGINAL AS g, avg(LogIntensities) AS l FROM run_level GROUP BY ALL)
SELECT p AS "Protein", g AS location, round(pow(2, l - max(l) OVER (PARTITION BY p)), 7) AS value FROM m WHERE p IN (SELECT p FROM b)"""))
def _(t):
    q = cut(shapes.run_level(t))
    base = q.where(F.col("GROUP_ORIGINAL") == "AF").groupBy("Protein").agg(F.avg("LogIntensities").alias("b"))
    c = q.where(F.col("GROUP_ORIGINAL") != "AF").groupBy("Protein", F.col("GROUP_ORIGINAL").alias("location")).agg(F.avg("LogIntensities").alias("m")).join(base, "Protein")
    return M.location_matrix(c.select("Protein", "location", (F.col("m") - F.col("b")).alias("log2FC")), q, "AF").withColumn("value", R("value", 7))


@query("specific_proteins", "M14 R28", """
WITH r AS (SELECT p_brand AS p, l_returnflag AS a, l_linestatus AS b, round(avg(l_discount) * 100 - 5, 3) AS fc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
d AS (SELECT p, a AS loc, b AS other, fc FROM r UNION ALL SELECT p, b, a, -fc FROM r), n AS (SELECT loc, count(DISTINCT other) AS need FROM d GROUP BY ALL)
SELECT p AS "Protein", loc AS location, count(DISTINCT other) AS "nPassing" FROM d JOIN n USING (loc) WHERE fc > 0.05 GROUP BY p, loc, need HAVING count(DISTINCT other) >= need - 1""")
def _(t):
    d = li(t).groupBy(F.col("brand").alias("Protein"), F.concat_ws("-", "grp", "subj").alias("Label")).agg(R(F.avg("y") * 100 - 5, 3).alias("log2FC"), F.lit(0.001).alias("pvalue"))
    return M.specific_proteins(d, 1, 0.05)


@query("proteins_to_fit", "M15", shapes.with_("run_level", body="""SELECT DISTINCT Protein AS "Protein" FROM (SELECT Protein FROM run_level WHERE LogIntensities > 15.03 AND GROUP_ORIGINAL IN ('AF', 'NF', 'RF') GROUP BY Protein, GROUP_ORIGINAL HAVING count(*) >= 3)"""))
def _(t):
    return M.proteins_to_fit(shapes.run_level(t), ["AF", "NF", "RF"], 15.03)


@query("proteins_to_fit_by_features", "M15 R62", shapes.with_("msstats", body="""
, n AS (SELECT ProteinName AS p, Condition AS g, Run AS r, count(DISTINCT PeptideSequence) AS n FROM msstats WHERE Condition IN ('AF', 'NF', 'RF') GROUP BY ALL), q AS (SELECT quantile_cont(n, 0.75) AS q FROM n)
SELECT DISTINCT p AS "Protein" FROM (SELECT p FROM n, q WHERE n >= q GROUP BY p, g HAVING count(*) >= 3)"""))
def _(t):
    f = shapes.msstats(t).select(F.col("ProteinName").alias("Protein"), F.col("Condition").alias("GROUP_ORIGINAL"), F.col("Run").alias("RUN"), F.col("PeptideSequence").alias("FEATURE"))
    return M.proteins_to_fit_by_features(f, ["AF", "NF", "RF"])


@query("composite_backgrounds", "M16 R89", shapes.with_("run_level", body="""
, m AS (SELECT Protein AS p, split_part(SUBJECT_ORIGINAL, '.', 2) AS r, sum(CASE GROUP_ORIGINAL WHEN 'AF' THEN 0.25 ELSE 0.75 END * pow(2, LogIntensities)) AS v FROM run_level WHERE GROUP_ORIGINAL IN ('AF', 'NF') GROUP BY ALL)
SELECT Protein AS "Protein", RUN AS "RUN", round(LogIntensities, 6) AS v FROM run_level UNION ALL SELECT p, 'mix_' || r, round(log2(v), 6) FROM m"""))
def _(t):
    c = t.spark.createDataFrame([("mix", "AF", 0.25), ("mix", "NF", 0.75)], "name string, location string, coefficient double")
    return M.composite_backgrounds(shapes.run_level(t), c).select("Protein", "RUN", R("LogIntensities", 6).alias("v"))


def _factors(t):
    d = cut(_refs(t))
    return d, *M.factorize_nonnegative(d, "Protein", "location", "value", 3)


@query("factorize_nonnegative", "M10", None)
def _(t):
    return _factors(t)[1]


@query("factorization_scan", "M10", None)
def _(t):
    return factorscan.factorization_scan(_refs(t), "Protein", "location", "value")[0]


@query("groups_from_basis", "M11", """
WITH b AS (SELECT p_brand AS r, l_linestatus || l_returnflag AS f, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT r, f, w / sum(w) OVER (PARTITION BY r) AS share FROM b)
SELECT r AS "row", f AS factor, round(share, 8) AS share FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY share DESC, f) = 1 AND share > 0.9 / 6""")
def _(t):
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("row"), F.concat("l_linestatus", "l_returnflag").alias("factor")).agg(F.sum("l_quantity").alias("w"))
    return M.groups_from_basis(d, 6, 0.9).withColumn("share", R("share", 8))


@query("characterize_bases", "M12 E07", None)
def _(t):
    d = t.lineitem.groupBy(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("p"), F.col("l_returnflag").alias("c")).agg(F.sum("l_quantity").alias("v"))
    b, _ = M.factorize_nonnegative(d, "p", "c", "v", 2)
    return M.characterize_bases(b, 2, shapes.gmt(t), min_size=2, max_size=5000)


@query("factor_residuals", "M12", None)
def _(t):
    d, b, c = _factors(t)
    r = M.factor_residuals(d, "Protein", "location", "value", b, c)
    return M.linear_models(r.withColumn("grp", F.substring("location", 1, 1)), "Protein", "residual", {"m": ["grp"]})


@query("pca", "M17", None)
def _(t):
    return M.pca(shapes.run_level(t), "Protein", "RUN", "LogIntensities")


@query("kmeans", "M18", None)
def _(t):
    return M.kmeans(t.embeddings, "vec_id", "embedding", 8)


@query("cosine_pairs", "M19 R48", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3""")
def _(t):
    return M.cosine_pairs(t.embeddings, "vec_id", "embedding", 0.3).withColumn("cosine", R("cosine", 6))
