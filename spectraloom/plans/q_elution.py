"""Elution-profile queries: part sizes as fractions, suppliers as proteins, order prices as signal."""

from pyspark.sql import functions as F

from spectraloom.functions.session import attach, cut
from spectraloom.operators import elution as P
from spectraloom.operators.models import cosine_between_samples
from spectraloom.plans import shapes
from spectraloom.plans.q_ingest import polish_sql
from spectraloom.plans.registry import query

R = F.round
shapes.cte("tot", """SELECT *, intensity / sum(intensity) OVER (PARTITION BY sample, protein) AS x FROM sec""", "sec")
shapes.cte("dims", "SELECT (SELECT count(DISTINCT protein) FROM sec) AS np, (SELECT count(DISTINCT fraction) FROM sec) AS nf", "sec")


def tot(t):
    return P.scale_total(shapes.sec(t))


@query("summarize_runs", "P01 R60 R61", shapes.with_("sec", body="""
SELECT treatment, replicate, CAST(count(DISTINCT fraction) AS INTEGER) AS "numFractions", min(fraction) AS "minFraction", max(fraction) AS "maxFraction", count(*) AS nrow,
  array_to_string(list_sort(list_filter(range(min(fraction), max(fraction) + 1), lambda f: NOT list_contains(list(DISTINCT fraction), f))), ';') AS "missingFractions" FROM sec GROUP BY treatment, replicate"""))
def _(t):
    return P.summarize_runs(shapes.sec(t))


@query("fraction_qc", "P02 N01 R67", shapes.with_("sec", body=", src AS (SELECT protein AS f, sample || '|' || CAST(fraction AS VARCHAR) AS r, log2(intensity) AS v FROM sec), " + polish_sql("src") + """
, s AS (SELECT sample, fraction, treatment, replicate, count(DISTINCT protein) AS "numProteins", median(intensity) AS m FROM sec GROUP BY ALL)
SELECT sample, fraction, treatment, replicate, "numProteins", round(m, 3) AS "medIntensity", round(effect + overall, 5) AS "medPolishIntensity" FROM s JOIN polished ON r = sample || '|' || CAST(fraction AS VARCHAR)"""))
def _(t):
    return P.fraction_qc(shapes.sec(t)).withColumns({"medIntensity": R("medIntensity", 3), "medPolishIntensity": R("medPolishIntensity", 5)})


@query("longest_runs", "P03 R84", shapes.with_("sec", body="""
, h AS (SELECT sample, protein, fraction - row_number() OVER (PARTITION BY sample, protein ORDER BY fraction) AS g FROM sec WHERE intensity > 40000),
i AS (SELECT sample, protein, g, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT sample, protein, max(n) AS l, CAST(sum(n) AS BIGINT) AS c FROM i GROUP BY ALL)
SELECT d.sample, d.protein, coalesce(l, 0) AS "longestRun", coalesce(c, 0) AS "countFractions" FROM (SELECT DISTINCT sample, protein FROM sec) d LEFT JOIN m USING (sample, protein)"""))
def _(t):
    return P.longest_runs(shapes.sec(t), cutoff=40000)


@query("scale_total", "P04 R73", shapes.with_("tot", body="""
, s AS (SELECT sample, protein, sum(intensity) AS s FROM sec GROUP BY ALL)
SELECT sample, protein, fraction, round(x, 8) AS share, round(x * s / max(s) OVER (PARTITION BY protein), 8) AS relative FROM tot JOIN s USING (sample, protein)"""))
def _(t):
    a = tot(t).select("sample", "protein", "fraction", R("intensity_totalScaled", 8).alias("share"))
    b = P.scale_total(shapes.sec(t), True).select("sample", "protein", "fraction", R("intensity_totalScaled", 8).alias("relative"))
    return a.join(b, ["sample", "protein", "fraction"])


@query("scale_max", "P04", shapes.with_("sec", body="""
SELECT sample, protein, fraction, round(intensity / max(intensity) OVER (PARTITION BY sample, protein), 8) AS own, round(intensity / max(intensity) OVER (PARTITION BY protein), 8) AS overall FROM sec"""))
def _(t):
    s = shapes.sec(t)
    a = P.scale_max(s).select("sample", "protein", "fraction", R("intensity_maxScaled", 8).alias("own"))
    return a.join(P.scale_max(s, True).select("sample", "protein", "fraction", R("intensity_maxScaled", 8).alias("overall")), ["sample", "protein", "fraction"])


@query("profile_grid", "P05 R47", shapes.with_("tot", body="""
SELECT p.protein, c.sample, c.fraction, round(coalesce(x, 0), 8) AS value FROM (SELECT DISTINCT protein FROM sec) p CROSS JOIN (SELECT DISTINCT sample, fraction FROM sec) c LEFT JOIN tot t ON t.protein = p.protein AND t.sample = c.sample AND t.fraction = c.fraction"""))
def _(t):
    return P.profile_grid(tot(t)).withColumn("value", R("value", 8))


@query("top_fraction", "P05 R71", shapes.with_("sec", body="""
SELECT protein, round(avg(f), 6) AS top FROM (SELECT sample, protein, arg_max(fraction, (round(intensity, 4), -fraction)) AS f FROM sec GROUP BY ALL) GROUP BY ALL"""))
def _(t):
    return P.top_fraction(shapes.sec(t).withColumn("intensity", R("intensity", 4))).select("protein", R("meanMaxFraction", 6).alias("top"))


@query("profile_order", "P06", shapes.with_("tot", body="""
SELECT protein, round(avg(c), 6) AS center FROM (SELECT sample, protein, sum(x * fraction) / sum(x) AS c FROM tot GROUP BY ALL) GROUP BY ALL"""))
def _(t):
    return P.profile_order(tot(t), "intensity_totalScaled").select("protein", R("center", 6).alias("center"))


_Z = """, own AS (SELECT {c} AS c, sum(x) AS s, sum(x * x) AS q, count(*) AS k FROM {src} GROUP BY ALL), pr AS (SELECT a.{c} AS a, b.{c} AS b, sum(a.x * b.x) AS xy, count(*) AS m FROM {src} a JOIN {src} b ON {on} AND a.{c} < b.{c} GROUP BY ALL),
 r AS (SELECT o.c AS a, p.c AS b, coalesce(m, 0) / CAST(o.k + p.k - coalesce(m, 0) AS DOUBLE) AS j, ({n} * coalesce(xy, 0) - o.s * p.s) / sqrt(({n} * o.q - o.s * o.s) * ({n} * p.q - p.s * p.s)) AS r FROM own o JOIN own p ON o.c < p.c LEFT JOIN pr ON pr.a = o.c AND pr.b = p.c, dims)"""


@query("sample_correlation", "P07 R65", shapes.with_("tot", "dims", body=_Z.format(c="sample", src="tot", on="a.protein = b.protein AND a.fraction = b.fraction", n="(SELECT count(*) FROM (SELECT DISTINCT protein, fraction FROM tot))") + " SELECT a, b, round(r, 6) AS r FROM r"))
def _(t):
    return P.sample_correlation(tot(t)).withColumn("r", R("r", 6))


@query("shifted_sample_correlation", "P08", shapes.with_("tot", "dims", body="""
, u AS (SELECT protein, fraction - o AS at, sample || '/' || CAST(o AS VARCHAR) AS c, x FROM tot, range(-3, 4) q(o) WHERE fraction BETWEEN 5 AND 45)""" + _Z.format(c="c", src="u", on="a.protein = b.protein AND a.at = b.at", n="((SELECT count(DISTINCT protein) FROM u) * (41 + 6))") + """
, w AS (SELECT a, b, r FROM r UNION ALL SELECT b, a, r FROM r) SELECT split_part(a, '/', 1) AS "refSample", split_part(b, '/', 1) AS "otherSample", CAST(split_part(b, '/', 2) AS INTEGER) AS "offset", round(r, 6) AS r FROM w WHERE split_part(a, '/', 2) = '0'"""))
def _(t):
    return P.shifted_sample_correlation(tot(t), 5, 45, 3).withColumn("r", R("r", 6))


@query("best_offset", "P08", shapes.with_("tot", "dims", body="""
, u AS (SELECT protein, fraction - o AS at, sample || '/' || CAST(o AS VARCHAR) AS c, x FROM tot, range(-3, 4) q(o) WHERE fraction BETWEEN 5 AND 45)""" + _Z.format(c="c", src="u", on="a.protein = b.protein AND a.at = b.at", n="((SELECT count(DISTINCT protein) FROM u) * (41 + 6))") + """
, w AS (SELECT a, b, round(r, 9) AS r FROM r UNION ALL SELECT b, a, round(r, 9) FROM r), s AS (SELECT split_part(a, '/', 1) AS x, split_part(b, '/', 1) AS y, CAST(split_part(b, '/', 2) AS INTEGER) AS o, r FROM w WHERE split_part(a, '/', 2) = '0')
SELECT x AS "refSample", y AS "otherSample", o AS "offset" FROM s WHERE x <> y QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY r DESC, abs(o), o) = 1"""))
def _(t):
    return P.best_offset(P.shifted_sample_correlation(tot(t), 5, 45, 3).withColumn("r", R("r", 9)))


_FC = """, u AS (SELECT protein, sample || '/' || lpad(CAST(fraction AS VARCHAR), 4, '0') AS c, x FROM tot)""" + _Z.format(c="c", src="u", on="a.protein = b.protein", n="np")


@query("fraction_comparison", "P09", shapes.with_("tot", "dims", body=_FC + """
SELECT split_part(a, '/', 1) AS ref_sample, CAST(split_part(a, '/', 2) AS INTEGER) AS ref_fraction, split_part(b, '/', 1) AS other_sample, CAST(split_part(b, '/', 2) AS INTEGER) AS other_fraction, round(r, 5) AS pearson, round(j, 6) AS jaccard FROM r"""))
def _(t):
    return P.fraction_comparison(tot(t)).withColumns({"pearson": R("pearson", 5), "jaccard": R("jaccard", 6)})


@query("best_matching_fraction", "P09", shapes.with_("tot", "dims", body=_FC + """
, w AS (SELECT a, b, round(r, 9) AS r, j FROM r UNION ALL SELECT b, a, round(r, 9), j FROM r),
s AS (SELECT split_part(a, '/', 1) AS x, CAST(split_part(a, '/', 2) AS INTEGER) AS f, split_part(b, '/', 1) AS y, CAST(split_part(b, '/', 2) AS INTEGER) AS g, r, j FROM w)
SELECT x AS ref_sample, f AS ref_fraction, y AS other_sample, g AS other_fraction, round(r, 6) AS pearson, round(j, 6) AS jaccard FROM s WHERE x <> y AND r IS NOT NULL AND NOT isnan(r) QUALIFY row_number() OVER (PARTITION BY x, f, y ORDER BY r DESC, g) = 1"""))
def _(t):
    d = P.best_matching_fraction(P.fraction_comparison(tot(t)).withColumn("pearson", R("pearson", 9)))
    return d.withColumns({"pearson": R("pearson", 6), "jaccard": R("jaccard", 6)})


@query("correlation_by_offset", "P37", shapes.with_("tot", "dims", body=_FC + """
, s AS (SELECT split_part(a, '/', 1) AS x, split_part(b, '/', 1) AS y, CAST(split_part(b, '/', 2) AS INTEGER) - CAST(split_part(a, '/', 2) AS INTEGER) AS o, round(r, 5) AS r FROM r)
SELECT o AS "offset", x = y AS within, count(*) AS n, round(avg(r), 4) AS mean FROM s WHERE abs(o) <= 5 GROUP BY ALL"""))
def _(t):
    return P.correlation_by_offset(P.fraction_comparison(tot(t))).groupBy("offset", "within").agg(F.count(F.lit(1)).alias("n"), R(F.avg(R("pearson", 5)), 4).alias("mean"))


@query("protein_correlation_between_samples", "P10", shapes.with_("tot", "dims", body="""
, o AS (SELECT protein, sample, sum(x) AS s, sum(x * x) AS q FROM tot GROUP BY ALL), m AS (SELECT a.protein, a.sample AS a, b.sample AS b, sum(a.x * b.x) AS xy FROM tot a JOIN tot b ON a.protein = b.protein AND a.fraction = b.fraction AND a.sample <> b.sample GROUP BY ALL)
SELECT a.protein, a.sample AS ref_sample, b.sample AS other_sample, round((nf * coalesce(xy, 0) - a.s * b.s) / sqrt((nf * a.q - a.s * a.s) * (nf * b.q - b.s * b.s)), 5) AS r
FROM o a JOIN o b ON a.protein = b.protein AND a.sample <> b.sample LEFT JOIN m ON m.protein = a.protein AND m.a = a.sample AND m.b = b.sample, dims"""))
def _(t):
    return P.protein_correlation_between_samples(tot(t)).withColumn("r", R("r", 5))


@query("shift_ratio", "P11", None)
def _(t):
    return P.shift_ratio(tot(t), "intensity_totalScaled")


@query("cluster_profiles", "P12 E04", None)
def _(t):
    return P.cluster_profiles(tot(t), "intensity_totalScaled", 0.3, 2)


def _qc(t):
    s = shapes.sec(t)
    return s.groupBy("sample", "treatment", "replicate", "fraction").agg(F.avg(F.log2("intensity")).alias("medPolishIntensity"))


@query("fit_local_cubics", "P13", None)
def _(t):
    return P.fit_local_cubics(cut(_qc(t)))


@query("label_outliers", "P14", None)
def _(t):
    q = cut(_qc(t))
    return P.label_outliers(q, P.fit_local_cubics(q), 1.1)


@query("undo_normalization", "P15", shapes.with_("sec", body="SELECT sample, protein, fraction, round(intensity, 4) AS intensity FROM sec"))
def _(t):
    q = _qc(t).withColumn("medianResidual", F.col("fraction") / 100)
    return P.undo_normalization(P.normalize_by_residuals(shapes.sec(t), q)).select("sample", "protein", "fraction", R("intensity", 4).alias("intensity"))


@query("normalize_by_residuals", "P15", shapes.with_("sec", body="""
SELECT sample, protein, fraction, round(intensity / pow(2, fraction / 100.0), 4) AS intensity, round(intensity, 4) AS "originalIntensity" FROM sec"""))
def _(t):
    q = _qc(t).withColumn("medianResidual", F.col("fraction") / 100)
    d = P.normalize_by_residuals(shapes.sec(t), q)
    return d.select("sample", "protein", "fraction", R("intensity", 4).alias("intensity"), R("originalIntensity", 4).alias("originalIntensity"))


_BAD = "((fraction + length(sample) + ascii(sample)) % 9 = 0)"


@query("interpolate_fractions", "P16 R116", shapes.with_("sec", body=f"""
, b AS (SELECT DISTINCT sample, fraction FROM sec WHERE {_BAD} UNION SELECT s.sample, f FROM (SELECT DISTINCT sample FROM sec) s, range(0, 53) r(f) WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.sample = s.sample AND fraction = f)),
g AS (SELECT p.sample, p.protein, CAST(f AS INTEGER) AS fraction FROM (SELECT DISTINCT sample, protein FROM sec) p, range(0, 53) r(f)),
v AS (SELECT g.*, b.sample IS NOT NULL AS interpolated, CASE WHEN b.sample IS NULL THEN s.intensity END AS v FROM g LEFT JOIN b ON b.sample = g.sample AND b.fraction = g.fraction LEFT JOIN sec s ON s.sample = g.sample AND s.protein = g.protein AND s.fraction = g.fraction)
SELECT sample, protein, fraction, interpolated, round(CASE WHEN interpolated THEN (lag(v) OVER w + lead(v) OVER w) / 2 ELSE v END, 4) AS intensity FROM v WINDOW w AS (PARTITION BY sample, protein ORDER BY fraction)"""))
def _(t):
    bad = (F.col("fraction") + F.length("sample") + F.ascii("sample")) % 9 == 0
    q = _qc(t).select("sample", "fraction", bad.alias("isOutlier"))
    return P.interpolate_fractions(shapes.sec(t), q, (0, 52)).withColumn("intensity", R("intensity", 4))


@query("windowed_loess_normalize", "P17", None)
def _(t):
    return P.windowed_loess_normalize(shapes.sec(t))


@query("match_fraction_medians", "P18 R62", shapes.with_("sec", body="""
, m AS (SELECT sample, fraction, median(log2(intensity)) AS m FROM sec GROUP BY ALL)
SELECT s.sample, s.protein, s.fraction, round(CASE WHEN s.sample = 'NF' AND s.fraction BETWEEN 5 AND 40 AND r.m IS NOT NULL THEN intensity * pow(2, r.m - o.m) ELSE intensity END, 3) AS intensity
FROM sec s LEFT JOIN m o ON o.sample = s.sample AND o.fraction = s.fraction LEFT JOIN m r ON r.sample = 'AF' AND r.fraction = s.fraction"""))
def _(t):
    return P.match_fraction_medians(shapes.sec(t), "AF", ["NF"], (5, 40)).select("sample", "protein", "fraction", R("intensity", 3).alias("intensity"))


shapes.cte("smooth", """SELECT g.sample, g.protein, g.f AS fraction, sum(coalesce(t.x, 0) * w) / any_value(wt) AS s FROM (SELECT p.sample, p.protein, CAST(f AS INTEGER) AS f FROM (SELECT DISTINCT sample, protein FROM sec) p, range(1, 51) r(f)) g
   JOIN (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, exp(-0.5 * pow((i - j) / (2.68 * 0.3706505), 2)) AS w, sum(exp(-0.5 * pow((i - j) / (2.68 * 0.3706505), 2))) OVER (PARTITION BY i) AS wt FROM range(1, 51) a(i), range(1, 51) b(j) WHERE abs(i - j) <= 4 * 2.68 * 0.3706505) k ON k.i = g.f
   LEFT JOIN tot t ON t.sample = g.sample AND t.protein = g.protein AND t.fraction = k.j GROUP BY ALL""", "tot")


@query("smooth_gaussian", "P19 R86", shapes.with_("smooth", body="SELECT sample, protein, fraction, round(s, 8) AS smoothed FROM smooth"))
def _(t):
    return P.smooth_gaussian(tot(t), "intensity_totalScaled").withColumn("smoothed", R("smoothed", 8))


shapes.cte("pk", """SELECT s.sample, s.protein, s.fraction AS loc, s.s AS h, u.f1 AS st, d.f2 AS en FROM smooth s
  JOIN (SELECT sample, protein, max(fraction) AS top, min(fraction) - 1 AS f1, count(*) AS n FROM (SELECT *, fraction - row_number() OVER (PARTITION BY sample, protein, up ORDER BY fraction) AS g FROM (SELECT *, s > lag(s) OVER (PARTITION BY sample, protein ORDER BY fraction) AS up FROM smooth)) WHERE up GROUP BY sample, protein, g) u ON u.sample = s.sample AND u.protein = s.protein AND u.top = s.fraction AND u.n >= 2
  JOIN (SELECT sample, protein, min(fraction) - 1 AS top, max(fraction) AS f2, count(*) AS n FROM (SELECT *, fraction - row_number() OVER (PARTITION BY sample, protein, dn ORDER BY fraction) AS g FROM (SELECT *, s < lag(s) OVER (PARTITION BY sample, protein ORDER BY fraction) AS dn FROM smooth)) WHERE dn GROUP BY sample, protein, g) d ON d.sample = s.sample AND d.protein = s.protein AND d.top = s.fraction AND d.n >= 2""", "smooth")


@query("find_peaks", "P20 R83 R84", shapes.with_("pk", body="""
SELECT sample, protein, loc AS "peakLocation", CAST(st AS INTEGER) AS "peakStart", en AS "peakEnd", round(h, 8) AS "peakHeight",
  (SELECT round(sum(s * fraction) / sum(s), 5) FROM smooth m WHERE m.sample = pk.sample AND m.protein = pk.protein AND m.fraction BETWEEN loc - 2 AND loc + 2) AS "cofmN" FROM pk"""))
def _(t):
    p = P.find_peaks(tot(t), "intensity_totalScaled")
    return p.select("sample", "protein", "peakLocation", "peakStart", "peakEnd", R("peakHeight", 8).alias("peakHeight"), R("cofmN", 5).alias("cofmN"))


@query("good_peaks", "P21 R68", shapes.with_("pk", body="""
, v AS (SELECT g.sample, g.protein, CAST(f AS INTEGER) AS fraction, coalesce(x, 0) AS x FROM (SELECT DISTINCT sample, protein FROM sec) g CROSS JOIN range(1, 51) r(f) LEFT JOIN tot t ON t.sample = g.sample AND t.protein = g.protein AND t.fraction = f),
w AS (SELECT pk.sample, pk.protein, loc, h, sqrt(var_samp(x)) / avg(x) AS cv, bool_and(x > 0) FILTER (abs(fraction - loc) <= 2) AS filled FROM pk JOIN v ON v.sample = pk.sample AND v.protein = pk.protein AND v.fraction BETWEEN loc - 4 AND loc + 4 GROUP BY ALL)
SELECT sample, protein, loc AS "peakLocation", round(cv, 6) AS cv, h > 0.01 AND filled AND cv > 0.2 AS "goodPeak" FROM w"""))
def _(t):
    return P.find_peaks(tot(t), "intensity_totalScaled").select("sample", "protein", "peakLocation", R("cv", 6).alias("cv"), "goodPeak")


@query("good_peak_flags", "P21", shapes.with_("pk", body="""
, v AS (SELECT g.sample, g.protein, CAST(f AS INTEGER) AS fraction, coalesce(x, 0) AS x FROM (SELECT DISTINCT sample, protein FROM sec) g CROSS JOIN range(1, 51) r(f) LEFT JOIN tot t ON t.sample = g.sample AND t.protein = g.protein AND t.fraction = f),
w AS (SELECT pk.sample, pk.protein, loc, h, sqrt(var_samp(x)) / avg(x) AS cv, bool_and(x > 0) FILTER (abs(fraction - loc) <= 2) AS filled FROM pk JOIN v ON v.sample = pk.sample AND v.protein = pk.protein AND v.fraction BETWEEN loc - 4 AND loc + 4 GROUP BY ALL)
SELECT tot.sample, tot.protein, tot.fraction, w.loc IS NOT NULL AS "goodPeak" FROM tot LEFT JOIN w ON w.sample = tot.sample AND w.protein = tot.protein AND w.loc = tot.fraction AND h > 0.01 AND filled AND cv > 0.2"""))
def _(t):
    d = tot(t)
    return P.good_peak_flags(d, P.find_peaks(d, "intensity_totalScaled"))


def _peaks(t):
    return cut(P.find_peaks(tot(t), "intensity_totalScaled"))


@query("match_peaks", "P22 R53 R90", shapes.with_("pk", body="""
, a AS (SELECT sample, protein, loc FROM pk WHERE sample <> 'AF'), b AS (SELECT s.sample, protein, loc FROM pk, (SELECT DISTINCT sample FROM a) s WHERE pk.sample = 'AF'),
ab AS (SELECT a.sample, a.protein, a.loc AS x, arg_min(b.loc, (abs(a.loc - b.loc), b.loc)) AS y FROM a JOIN b USING (sample, protein) GROUP BY ALL), ba AS (SELECT b.sample, b.protein, b.loc AS y, arg_min(a.loc, (abs(a.loc - b.loc), a.loc)) AS x FROM a JOIN b USING (sample, protein) GROUP BY ALL),
m AS (SELECT sample, protein, x, y FROM ab JOIN ba USING (sample, protein, x, y)), e AS (SELECT sample, least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM m GROUP BY sample)
SELECT sample, protein, x AS "peakLocation", y AS "i_peakLocation", CASE WHEN NOT (y - x > x - lo OR y - x < x - hi) THEN y - x END AS "deltaPeak" FROM m JOIN e USING (sample)"""))
def _(t):
    p = _peaks(t).select("sample", "protein", "peakLocation")
    others = p.where(F.col("sample") != "AF")
    names = others.agg(F.collect_set("sample").alias("_names"))
    copies = attach(p.where(F.col("sample") == "AF").select("protein", "peakLocation"), names).select(F.explode("_names").alias("sample"), "protein", "peakLocation")
    m = P.match_peaks(others, copies, keys=["sample"])
    return m.select("sample", "protein", "peakLocation", "i_peakLocation", "deltaPeak")


def _aligned(t):
    d = shapes.sec(t).agg(F.min("fraction"), F.max("fraction")).first()
    return P.align_peaks_to_standard(_peaks(t), "AF", min_per_fraction=0, first=d[0], last=d[1], start_at=2)


@query("align_peaks_to_standard", "P23", None)
def _(t):
    return _aligned(t)[0]


@query("standard_fractions", "P23", None)
def _(t):
    return P.standard_fractions(tot(t), _aligned(t)[1])


def _standards(t):
    return t.part.select(F.col("p_size").alias("fraction"), (F.col("p_retailprice") * 100 / F.col("p_size")).alias("mw"))


_CAL = "cal AS (SELECT regr_slope(log10(p_retailprice * 100 / p_size), p_size) AS a, regr_intercept(log10(p_retailprice * 100 / p_size), p_size) AS b FROM part)"


@query("mass_calibration", "P24", f"WITH {_CAL} SELECT p_partkey, round(pow(10, b + a * p_size), 4) AS mass, round((log10(p_retailprice) - b) / a, 5) AS \"massFraction\" FROM part, cal")
def _(t):
    c = P.mass_calibration(_standards(t))
    d = P.mass_to_fraction(P.fraction_to_mass(t.part, c, "p_size"), c, "p_retailprice")
    return d.select("p_partkey", R("mass", 4).alias("mass"), R("massFraction", 5).alias("massFraction"))


@query("resample_integer_fractions", "P25 R116", shapes.with_("tot", body="""
, p AS (SELECT sample, treatment, protein, fraction + 0.25 AS x0, x AS y0, lead(fraction + 0.25) OVER w AS x1, lead(x) OVER w AS y1 FROM tot WINDOW w AS (PARTITION BY sample, treatment, protein ORDER BY fraction)),
g AS (SELECT DISTINCT sample, treatment, protein, CAST(f AS INTEGER) AS f FROM tot, range(1, 51) r(f))
SELECT g.sample, g.treatment, g.protein, g.f AS "standardFraction", round(y0 + (y1 - y0) * (f - x0) / (x1 - x0), 8) AS value FROM g LEFT JOIN p ON g.sample = p.sample AND g.treatment = p.treatment AND g.protein = p.protein AND g.f > p.x0 AND g.f < p.x1"""))
def _(t):
    d = tot(t).withColumn("standardFraction", F.col("fraction") + 0.25)
    r = P.resample_integer_fractions(d, "intensity_totalScaled", 1, 50)
    return r.select("sample", "treatment", "protein", "standardFraction", R("intensity_totalScaled", 8).alias("value"))


def _std(t):
    return cut(tot(t).withColumn("standardFraction", F.col("fraction").cast("double")))


def _centers(t):
    return _peaks(t).withColumn("cofmN_standardized", R("cofmN", 6))


_LINKED = """
, c AS (SELECT protein, sample, loc, cofmn, h, row_number() OVER (PARTITION BY protein ORDER BY cofmn, sample, loc) AS i FROM centres),
g AS (SELECT *, sum(CASE WHEN cofmn - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY protein ORDER BY i) AS isle FROM (SELECT *, lag(cofmn) OVER (PARTITION BY protein ORDER BY i) AS before FROM c)),
s AS (SELECT protein, isle, list(struct_pack(lo := cofmn, hi := cofmn, n := 1) ORDER BY i) AS l FROM g GROUP BY ALL),
z AS (WITH RECURSIVE z AS (SELECT protein, isle, l, 0 AS turn FROM s UNION ALL
  SELECT protein, isle, list_concat(list_append(l[:k - 1], struct_pack(lo := l[k].lo, hi := l[k + 1].hi, n := l[k].n + l[k + 1].n)), l[k + 2:]), turn + 1 FROM
    (SELECT *, list_position(d, list_min(d)) AS k FROM (SELECT *, [l[i + 1].hi - l[i].lo FOR i IN range(1, len(l))] AS d FROM z WHERE len(l) > 1)) WHERE d[k] <= 2)
  SELECT protein, isle, arg_max(l, turn) AS l FROM z GROUP BY ALL),
u AS (SELECT protein, isle, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS j FROM z),
k AS (SELECT protein, isle, j, x.n AS n, sum(x.n) OVER (PARTITION BY protein ORDER BY isle, j) AS upto, row_number() OVER (PARTITION BY protein ORDER BY isle, j) AS cluster FROM u),
linked AS (SELECT c.*, CAST(k.cluster AS INTEGER) AS cluster FROM c JOIN k ON k.protein = c.protein AND c.i > k.upto - k.n AND c.i <= k.upto)"""
shapes.cte("centres", """SELECT pk.sample, pk.protein, loc, h, round((SELECT sum(s * fraction) / sum(s) FROM smooth m WHERE m.sample = pk.sample AND m.protein = pk.protein AND m.fraction BETWEEN loc - 2 AND loc + 2), 6) AS cofmn FROM pk""", "pk")


@query("cluster_peaks", "P26", shapes.with_("centres", body=_LINKED + """
SELECT protein, cluster AS "peakCluster", round(avg(cofmn) + 0.00000001, 5) AS center, count(*) AS "numPeaks", round(avg(h), 8) AS "meanHeight" FROM linked GROUP BY ALL"""))
def _(t):
    c = P.cluster_peaks(_centers(t), ["protein"])[1]
    return c.select("protein", "peakCluster", R(F.col("center") + 1e-8, 5).alias("center"), "numPeaks", R("meanHeight", 8).alias("meanHeight"))


@query("peak_anova", "P27 R52", None)
def _(t):
    return P.peak_anova(_std(t), cut(P.cluster_peaks(_centers(t), ["protein"])[1]))


@query("peak_t_fraction_matched", "P28", None)
def _(t):
    return P.peak_t_fraction_matched(_std(t), cut(P.cluster_peaks(_centers(t), ["protein"])[1]))


@query("peak_t_area", "P29", None)
def _(t):
    return P.peak_t_area(P.peak_areas(_std(t), cut(P.cluster_peaks(_centers(t), ["protein"])[1])))


@query("full_contrast", "P30", None)
def _(t):
    return P.full_contrast(_std(t), _centers(t))


_GOOD = """
, fill AS (SELECT g.sample, g.protein, CAST(f AS INTEGER) AS fraction, coalesce(x, 0) AS x FROM (SELECT DISTINCT sample, protein FROM sec) g CROSS JOIN range(1, 51) r(f) LEFT JOIN tot t ON t.sample = g.sample AND t.protein = g.protein AND t.fraction = f),
good AS (SELECT sample, protein, loc FROM (SELECT pk.sample, pk.protein, loc, h, sqrt(var_samp(x)) / avg(x) AS cv, bool_and(x > 0) FILTER (abs(fraction - loc) <= {core}) AS filled FROM pk JOIN fill v ON v.sample = pk.sample AND v.protein = pk.protein AND v.fraction BETWEEN loc - 4 AND loc + 4 GROUP BY ALL)
   WHERE h > 0.01 AND filled AND cv > 0.2)"""


def _pairs_sql(center):
    return _GOOD.format(core=1) + f"""
, att AS (SELECT sample, protein, s AS start, min(loc) AS peak FROM (SELECT sample, protein, loc, unnest(range(loc - 1, loc + 2)) AS s FROM good) WHERE s BETWEEN 7 AND 44 GROUP BY ALL),
v AS (SELECT att.sample, att.protein, start, f.fraction AS f, f.x FROM att JOIN fill f ON f.sample = att.sample AND f.protein = att.protein AND abs(f.fraction - start) <= 6),
r AS (SELECT a.sample, a.start, a.protein AS p1, b.protein AS p2, {center} AS r FROM v a JOIN v b ON a.sample = b.sample AND a.start = b.start AND a.f = b.f AND a.protein < b.protein GROUP BY ALL)
SELECT sample, start, p1 AS protein1, p2 AS protein2, round(r, 5) AS r FROM r WHERE r > 0.7"""


def _good_peaks(t):
    """Peaks of all samples, good ones by height, filled neighbours and variation."""
    return cut(P.find_peaks(tot(t), "intensity_totalScaled", center_radius=1))


@query("windowed_pairs_correlation", "P31", shapes.with_("pk", body=_pairs_sql("corr(a.x, b.x)")))
def _(t):
    p = P.windowed_pairs(tot(t), _good_peaks(t), "intensity_totalScaled", threshold=0.7)
    return p.select("sample", "start", "protein1", "protein2", R("r", 5).alias("r"))


@query("windowed_pairs_cosine", "P31 M19", shapes.with_("pk", body=_pairs_sql("sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))")))
def _(t):
    p = P.windowed_pairs(tot(t), _good_peaks(t), "intensity_totalScaled", "cosine", threshold=0.7)
    return p.select("sample", "start", "protein1", "protein2", R("r", 5).alias("r"))


def _known(t):
    n = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("p"), "s_nationkey")
    return n.withColumnRenamed("p", "protein1").join(n.withColumnRenamed("p", "protein2"), "s_nationkey").where(F.col("protein1") < F.col("protein2"))


@query("windowed_pairs_posterior", "P31 F15", None)
def _(t):
    return P.windowed_pairs(tot(t), _good_peaks(t), "intensity_totalScaled", threshold=0.3, known=_known(t))


def _found(t):
    c = t.supplier.select(F.col("s_nationkey").cast("string").alias("complex_id"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("complex_name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("protein"))
    m = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("protein"), (F.abs("s_acctbal") + 1).alias("mw"))
    return P.coeluting_members(c, _good_peaks(t).withColumn("cofmN_standardized", F.col("cofmN")), m, P.mass_calibration(_standards(t)), max_distance=4.0, completeness=0.2)


@query("coeluting_members", "P32", None)
def _(t):
    return _found(t)


@query("score_coelution", "P33", None)
def _(t):
    p = P.windowed_pairs(tot(t), _good_peaks(t), "intensity_totalScaled", threshold=0.0)
    return P.score_coelution(cut(_found(t)), p)


@query("intensity_bins", "P34 R93", shapes.with_("sec", body="""
, s AS (SELECT sample, protein, round(sum(intensity), 2) AS v FROM sec GROUP BY ALL), q AS (SELECT quantile_cont(v, [i / 30.0 FOR i IN range(1, 31)]) AS q FROM s)
SELECT sample, protein, v AS "sumInts", CAST(len(list_filter(q, lambda e: e < v - 1e-6)) + 1 AS INTEGER) AS bin FROM s, q"""))
def _(t):
    s = shapes.sec(t).groupBy("sample", "protein").agg(R(F.sum("intensity"), 2).alias("intensity"))
    d = P.intensity_bins(s.withColumn("intensity", F.col("intensity")))
    return d.select("sample", "protein", "sumInts", "bin")


@query("trace_tables", "P36 R74", shapes.with_("sec", body="""
SELECT g.sample, g.protein, CAST(f AS INTEGER) AS fraction, round(coalesce(i, 0), 3) AS intensity FROM (SELECT DISTINCT sample, protein FROM sec) g CROSS JOIN range(1, 51) r(f)
LEFT JOIN (SELECT sample, protein, fraction, sum(intensity) AS i FROM sec GROUP BY ALL) x ON x.sample = g.sample AND x.protein = g.protein AND x.fraction = f"""))
def _(t):
    ann = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("protein"), "s_acctbal")
    w, _, _ = P.trace_tables(shapes.sec(t), ann, P.mass_calibration(_standards(t)), list(range(1, 51)))
    long = w.unpivot(["sample", "protein"], [str(f) for f in range(1, 51)], "fraction", "intensity")
    return long.select("sample", "protein", F.col("fraction").cast("int").alias("fraction"), R("intensity", 3).alias("intensity"))


@query("cosine_between_samples", "M19", shapes.with_("tot", body="""
, c AS (SELECT protein, fraction, coalesce(sum(x) FILTER (sample = 'AF'), 0) AS a, coalesce(sum(x) FILTER (sample = 'NF'), 0) AS b FROM tot WHERE sample IN ('AF', 'NF') GROUP BY ALL)
SELECT protein, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM c GROUP BY ALL"""))
def _(t):
    return cosine_between_samples(tot(t), "protein", "sample", "fraction", "intensity_totalScaled", "AF", "NF").withColumn("cosine", R("cosine", 6))


