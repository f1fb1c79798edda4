"""Relational idioms the operators are written with."""

from pyspark.sql import functions as F

from spectraloom.functions import columns as Cx
from spectraloom.operators import ingest as C
from spectraloom.plans import shapes
from spectraloom.plans.registry import query
from spectraloom.sources import text as S

R = F.round


@query("finite_rows", "R20 R24", shapes.with_("results", body='SELECT Protein AS "Protein", Label AS "Label", log2FC FROM results WHERE isfinite(log2FC)'.replace("log2FC FROM", 'log2FC AS "log2FC" FROM')))
def _(t):
    return C.finite_rows(shapes.results(t), "log2FC").select("Protein", "Label", "log2FC")


@query("exclude_runs", "R15 R21", shapes.with_("run_level", body="""SELECT Protein AS "Protein", RUN AS "RUN" FROM run_level WHERE GROUP_ORIGINAL NOT IN ('AF', 'RO')"""))
def _(t):
    return S.exclude_values(shapes.run_level(t), "GROUP_ORIGINAL", ["AF", "RO"]).select("Protein", "RUN")


@query("between_filter", "R22 R27 R32", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def _(t):
    return t.lineitem.where(F.col("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))


@query("resolve_alias", "R30 R31", shapes.with_("evidence", body='SELECT DISTINCT "Raw file" AS "RawFile", Charge AS "Charge" FROM evidence'))
def _(t):
    return C.fix_raw_file(shapes.evidence(t)).select("RawFile", "Charge").distinct()


@query("product_aggregate", "R70", "SELECT l_orderkey, round(product(1 - l_discount / 3), 8) AS p FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(R(F.product(1 - F.col("l_discount") / 3), 8).alias("p"))


@query("unpivot", "R75", """SELECT l_orderkey, l_linenumber, k, v FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) ON l_discount, l_tax INTO NAME k VALUE v)""")
def _(t):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "k", "v")


@query("set_operations", "R91 R92", """SELECT 'only_lines' AS part, count(*) AS n FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
 SELECT 'either', count(*) FROM (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders)""")
def _(t):
    a, b = t.lineitem.select("l_orderkey"), t.orders.select("o_orderkey", "o_orderstatus")
    only = a.distinct().join(b.where(F.col("o_orderstatus") == "F"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    either = a.union(b.select("o_orderkey")).distinct()
    tag = lambda d, s: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("part"), "n")
    return tag(only, "only_lines").unionByName(tag(either, "either"))


@query("literal_replace", "R104 R107 R108", r"""SELECT p_partkey, replace(replace(p_name, 'e', '[3]'), 'a', '(4)') AS r, CAST(len(string_split(p_name, 'e')) - 1 AS INTEGER) AS n FROM part""")
def _(t):
    return t.part.select("p_partkey", Cx.chained_replace("p_name", [("e", "[3]"), ("a", "(4)")]).alias("r"), F.size(Cx.locate_all("p_name", "e")).alias("n"))


@query("update_join", "R40 R44", """SELECT o_orderkey, coalesce(m.f, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN
  (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS f FROM lineitem WHERE l_quantity > 25 GROUP BY ALL) m ON o_orderkey = l_orderkey""")
def _(t):
    m = t.lineitem.where(F.col("l_quantity") > 25).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"), "l_linenumber")
    return Cx.update_join(t.orders.select("o_orderkey", "o_orderstatus"), m, ["o_orderkey"], "o_orderstatus", [-F.col("l_linenumber"), -F.ascii("o_orderstatus")])
