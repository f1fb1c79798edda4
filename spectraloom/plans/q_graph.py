"""Network queries: links are supplier-part pairs weighted by ordered quantity."""

from pyspark.sql import functions as F

from spectraloom.operators import graph as G
from spectraloom.operators import propagation as P
from spectraloom.plans import shapes
from spectraloom.plans.registry import query

R = F.round

shapes.cte("strong", "SELECT protein1 AS src, protein2 AS dst, combined_score FROM links WHERE combined_score > 640", "links")
shapes.cte("pairs2", "SELECT src, dst FROM strong UNION SELECT dst, src FROM strong", "strong")
shapes.cte("comp", """WITH RECURSIVE r AS (SELECT src AS node, src AS seen FROM pairs2 UNION SELECT r.node, b.dst FROM r JOIN pairs2 b ON r.seen = b.src)
   SELECT node, min(seen) AS component FROM r GROUP BY node""", "pairs2")
shapes.cte("wide_net", "SELECT protein1 AS src, protein2 AS dst FROM links WHERE combined_score > 400", "links")
shapes.cte("wide_both", "SELECT src, dst FROM wide_net UNION SELECT dst, src FROM wide_net", "wide_net")


def strong(t, limit=640):
    return G.load_links(shapes.links(t), limit).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"), "combined_score")


def _nodes(t):
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    p = t.part.where(F.col("p_type") == "ECONOMY").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("name"))
    return s.unionByName(p)


shapes.cte("node_set", """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier UNION ALL
   SELECT 'g' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_type = 'ECONOMY'""")


@query("load_links", "W01 R20", shapes.with_("links", body="SELECT * FROM links WHERE combined_score > 500 AND experimental > 500"))
def _(t):
    return G.load_links(shapes.links(t), 500, {"experimental": 500})


@query("subgraph", "W02 R50 R71", shapes.with_("links", "node_set", body="""
SELECT least(protein1, protein2) AS protein1, greatest(protein1, protein2) AS protein2, combined_score, experimental FROM links
WHERE combined_score > 200 AND experimental >= 300 AND protein1 IN (SELECT name FROM node_set) AND protein2 IN (SELECT name FROM node_set)"""))
def _(t):
    return G.subgraph(shapes.links(t), _nodes(t), 200, {"experimental": 300})


@query("node_sample", "W02 R88", None)
def _(t):
    return G.node_sample(shapes.links(t), 50)


@query("connector_edges", "W03 R51", shapes.with_("links", body="""
, e AS (SELECT least(protein1, protein2) AS protein1, greatest(protein1, protein2) AS protein2, protein2 AS cand, max(combined_score) / 1000.0 AS weight
   FROM links WHERE combined_score > 350 GROUP BY ALL)
SELECT protein1, protein2, CAST(weight AS DOUBLE) AS weight FROM e WHERE cand IN (SELECT cand FROM e GROUP BY cand HAVING count(*) > 1)"""))
def _(t):
    names = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"))
    return G.connector_edges(shapes.links(t), names, 350)


@query("sub_network", "W02", shapes.with_("links", "node_set", body="""
SELECT protein1, protein2, CAST(combined_score / 1000.0 AS DOUBLE) AS weight FROM links
WHERE combined_score > 300 AND protein1 IN (SELECT name FROM node_set) AND protein2 IN (SELECT name FROM node_set)"""))
def _(t):
    return G.sub_network(shapes.links(t), _nodes(t), 300)


@query("connected_components", "W04", shapes.with_("comp", body="SELECT node, component FROM comp"))
def _(t):
    return G.connected_components(strong(t))


@query("largest_component", "W04", shapes.with_("comp", "strong", body="""
SELECT src, dst, combined_score FROM strong WHERE src IN (SELECT node FROM comp WHERE component =
   (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"""))
def _(t):
    return G.largest_component(strong(t))


@query("hop_distances", "W05", shapes.with_("pairs2", body="""
, h AS (WITH RECURSIVE r AS (SELECT DISTINCT src AS source, src AS node, 0 AS hops FROM pairs2
   UNION SELECT r.source, b.dst, r.hops + 1 FROM r JOIN pairs2 b ON r.node = b.src WHERE r.hops < 4) SELECT * FROM r)
SELECT source, node, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY ALL"""))
def _(t):
    return G.hop_distances(strong(t), 4)


def _heats(t):
    return t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"), F.abs("s_acctbal").alias("heat"))


_WALK = """
, w AS (SELECT b.src, b.dst, 1.0::DOUBLE / d.n AS w FROM wide_both b JOIN (SELECT src, count(*) AS n FROM wide_both GROUP BY src) d ON b.{side} = d.src),
h AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node, abs(s_acctbal) AS heat FROM supplier WHERE 's' || CAST(s_suppkey AS VARCHAR) IN (SELECT src FROM wide_both)),
x AS (WITH RECURSIVE x AS (SELECT 0 AS k, node, heat FROM h UNION ALL
  SELECT k + 1, node, sum(v) FROM (SELECT x.k, w.dst AS node, 0.5 * x.heat * w.w AS v FROM x JOIN w ON x.node = w.src WHERE x.k < 50
     UNION ALL SELECT m.k, h.node, 0.5 * h.heat FROM h, (SELECT DISTINCT k FROM x WHERE k < 50) m) GROUP BY k, node) SELECT node, heat FROM x WHERE k = 50)"""


@query("random_walk", "W06", shapes.with_("wide_both", body=_WALK.format(side="src") + " SELECT node, round(heat, 2) AS heat FROM x"))
def _(t):
    e = G.load_links(shapes.links(t), 400).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))
    return G.random_walk(e, _heats(t), 0.5, tolerance=1e-12).select("node", R("heat", 2).alias("heat"))


@query("random_walk_row_normalized", "W06", shapes.with_("wide_both", body=_WALK.format(side="dst") + " SELECT node, round(heat, 2) AS heat FROM x"))
def _(t):
    e = G.load_links(shapes.links(t), 400).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))
    return G.random_walk(e, _heats(t), 0.5, tolerance=1e-12, transposed=True).select("node", R("heat", 2).alias("heat"))


@query("heat_diffusion", "W07", shapes.with_("wide_both", body="""
, d AS (SELECT src, count(*) AS n FROM wide_both GROUP BY src), q AS (SELECT CAST(max(n) AS DOUBLE) AS q FROM d),
h AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node, abs(s_acctbal) AS heat FROM supplier WHERE 's' || CAST(s_suppkey AS VARCHAR) IN (SELECT src FROM d)),
x AS (WITH RECURSIVE x AS (SELECT 0 AS k, node, heat FROM h UNION ALL
  SELECT k + 1, node, sum(v) FROM (SELECT x.k, b.dst AS node, -0.02 * x.heat * -1 / (x.k + 1) AS v FROM x JOIN wide_both b ON x.node = b.src WHERE x.k < 30
     UNION ALL SELECT x.k, x.node, -0.02 * x.heat * d.n / (x.k + 1) FROM x JOIN d ON x.node = d.src WHERE x.k < 30) GROUP BY k, node) SELECT node, sum(heat) AS heat FROM x GROUP BY node)
SELECT node, round(heat, 4) AS heat FROM x WHERE abs(heat) > 1e-3"""))
def _(t):
    e = G.load_links(shapes.links(t), 400).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))
    return G.heat_diffusion(e, _heats(t), 0.02).where(F.abs("heat") > 1e-3).select("node", R("heat", 4).alias("heat"))


@query("expected_heat", "W10", shapes.with_("wide_both", body=_WALK.format(side="src").replace("h AS (SELECT 's'", "real_heat AS (SELECT 's'", 1).replace(
    "x AS (WITH", "h AS (SELECT DISTINCT src AS node, 1.0::DOUBLE AS heat FROM wide_both), x AS (WITH", 1) + """
 SELECT node, round(heat * (SELECT sum(heat) FROM real_heat) / (SELECT count(*) FROM h), 2) AS expect_heat FROM x"""))
def _(t):
    e = G.load_links(shapes.links(t), 400).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))
    return G.expected_heat(e, _heats(t), 0.5).select("node", R("expect_heat", 2).alias("expect_heat"))


shapes.cte("core_net", "SELECT protein1 AS src, protein2 AS dst FROM links WHERE combined_score > 700", "links")
shapes.cte("core_both", "SELECT src, dst FROM core_net UNION SELECT dst, src FROM core_net", "core_net")
shapes.cte("core_comp", """WITH RECURSIVE r AS (SELECT src AS node, src AS seen FROM core_both UNION SELECT r.node, b.dst FROM r JOIN core_both b ON r.seen = b.src)
   SELECT node, min(seen) AS component FROM r GROUP BY node""", "core_both")
shapes.cte("big_both", """SELECT src, dst FROM core_both WHERE src IN (SELECT node FROM core_comp WHERE component =
   (SELECT component FROM core_comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))""", "core_comp")


def _core(t):
    return G.load_links(shapes.links(t), 700).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))


def _core_heats(t):
    """A heat for every second node of the core, so that observed and unobserved nodes differ."""
    nodes = P.simple_edges(_core(t)).select(F.col("src").alias("node")).distinct()
    return nodes.where(F.length("node") % 2 == 0).select("node", (F.substring("node", 2, 9).cast("double") % 17 + 1).alias("heat"))


_CORE_HEATS = "SELECT DISTINCT src AS node, CAST(CAST(substr(src, 2) AS BIGINT) % 17 + 1 AS DOUBLE) AS heat FROM {net} WHERE length(src) % 2 = 0"
#: powers of the walk from every node of the largest component; S(node, v) is half the sum over k
_POWERS = f"""
, h AS ({_CORE_HEATS.format(net="big_both")}), w AS (SELECT b.src, b.dst, 0.5::DOUBLE / d.n AS w FROM big_both b JOIN (SELECT src, count(*) AS n FROM big_both GROUP BY src) d ON b.src = d.src),
x AS (WITH RECURSIVE x AS (SELECT 0 AS k, src AS v, src AS node, 1.0::DOUBLE AS heat FROM (SELECT DISTINCT src FROM big_both) UNION ALL
  SELECT k + 1, v, dst, sum(heat * w) FROM x JOIN w ON x.node = w.src WHERE k < 45 GROUP BY k, v, dst) SELECT v, node, 0.5 * sum(heat) AS s FROM x GROUP BY v, node)"""


@query("random_walk_without_restart", "W06", shapes.with_("big_both", body=_POWERS + """
SELECT x.node, round(sum((s - CASE WHEN x.node = v THEN 0.5 ELSE 0 END) / 0.5 * heat), 5) AS heat FROM x JOIN h ON h.node = v GROUP BY x.node"""))
def _(t):
    return P.walk_operator(_core(t), _core_heats(t), 0.5, remove_restart=True).select("node", R("heat", 5).alias("heat"))


@query("random_walk_transposed_without_restart", "W06", shapes.with_("big_both", body=_POWERS + """
, c AS (SELECT node, sum(s) - 0.5 AS total FROM x GROUP BY node)
SELECT x.v AS node, round(sum((s - CASE WHEN x.node = v THEN 0.5 ELSE 0 END) / total * heat), 5) AS heat FROM x JOIN h USING (node) JOIN c USING (node) GROUP BY x.v"""))
def _(t):
    return P.walk_operator(_core(t), _core_heats(t), 0.5, row_normalized=True, remove_restart=True).select("node", R("heat", 5).alias("heat"))


@query("self_heat", "W08 W10", shapes.with_("big_both", body=_POWERS + " SELECT node, round(s, 8) AS self FROM x WHERE node = v"))
def _(t):
    return P.self_heats(G.largest_component(_core(t)), 0.5, 1e-12).select("node", R("self", 8).alias("self"))


@query("expected_heat_network_only", "W10", shapes.with_("big_both", body=_POWERS + """
SELECT node, round(sum(s) FILTER (node <> v) * (SELECT sum(heat) FROM h) / (SELECT count(DISTINCT src) FROM big_both), 6) AS expect_heat FROM x GROUP BY node"""))
def _(t):
    return P.expected_heat(G.largest_component(_core(t)), _core_heats(t), 0.5, network_only=True, tolerance=1e-12).select("node", R("expect_heat", 6).alias("expect_heat"))


@query("expected_heat_observed", "W10", shapes.with_("big_both", body=_POWERS + """
SELECT node, round(coalesce(sum(s) FILTER (node <> v), 0) * (SELECT sum(heat) FROM h) / (SELECT count(*) FROM h), 6) AS expect_heat FROM x WHERE v IN (SELECT node FROM h) GROUP BY node"""))
def _(t):
    return P.expected_heat(G.largest_component(_core(t)), _core_heats(t), 0.5, observed_only=True, network_only=True, tolerance=1e-12).select("node", R("expect_heat", 6).alias("expect_heat"))


def _wide(t):
    return G.largest_component(G.load_links(shapes.links(t), 560).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst")))


@query("propagated_heats", "W08", shapes.with_("big_both", body=_POWERS + """
SELECT node, round(coalesce(max(h0.heat), 0), 6) AS heat0, round(coalesce(sum(s * h.heat), 0), 5) AS prop_heat, round(coalesce(max(s) FILTER (node = v), 0) * coalesce(max(h0.heat), 0), 5) AS self_heat,
  round(coalesce(sum(s) FILTER (node <> v), 0) * (SELECT sum(heat) FROM h) / (SELECT count(DISTINCT src) FROM big_both), 5) AS expect_heat
FROM x LEFT JOIN h ON h.node = v LEFT JOIN h h0 ON h0.node = x.node GROUP BY x.node""".replace("SELECT node,", "SELECT x.node AS node,").replace("(node = v)", "(x.node = v)").replace("(node <> v)", "(x.node <> v)")))
def _(t):
    d = P.propagate_heats(G.largest_component(_core(t)), _core_heats(t), 0.5, network_only=True, tolerance=1e-12)
    return d.select("node", R("heat0", 6).alias("heat0"), R("prop_heat", 5).alias("prop_heat"), R("self_heat", 5).alias("self_heat"), R("expect_heat", 5).alias("expect_heat"))


@query("propagate_heats", "W08", None)
def _(t):
    return P.propagate_heats(_wide(t), _heats(t), 0.5)


@query("propagate_heats_network_only", "W08", None)
def _(t):
    return P.propagate_heats(_wide(t), _heats(t), 0.5, network_only=True, observed_only=True)


def _heat_sets(t):
    return _heats(t).withColumn("set", F.explode(F.array(F.lit("plain"), F.lit("squared")))).withColumn(
        "heat", F.when(F.col("set") == "plain", F.col("heat")).otherwise(F.col("heat") * F.col("heat"))
    )


@query("propagate_multi", "W09", None)
def _(t):
    return P.propagate_multi(_wide(t), _heat_sets(t), 0.5)


@query("propagate_multi_network_only", "W09", None)
def _(t):
    return P.propagate_multi(_wide(t), _heat_sets(t), 0.5, network_only=True)


@query("heat_contributions_to_all", "W11 R81", shapes.with_("big_both", body=_POWERS + """
, c AS (SELECT x.node AS "to", v AS "from", s * heat AS c FROM x JOIN h ON h.node = v), p AS (SELECT *, 100 * c / sum(c) OVER (PARTITION BY "to") AS pc FROM c WHERE c > 1e-9)
SELECT "to", "from", round(c + 1e-9, 5) AS contributed_heat, round(pc + 1e-7, 3) AS percent FROM p"""))
def _(t):
    e = G.largest_component(_core(t))
    nodes = P.simple_edges(e).select(F.col("src").alias("node")).distinct()
    d = G.heat_contributions(e, _core_heats(t), nodes, 0.5, tolerance=1e-12).where("contributed_heat > 1e-9")
    return d.select("to", "from", R(F.col("contributed_heat") + 1e-9, 5).alias("contributed_heat"), R(F.col("percent") + 1e-7, 3).alias("percent"))


@query("heat_contributions", "W11 R81", None)
def _(t):
    e = G.load_links(shapes.links(t), 560).select(F.col("protein1").alias("src"), F.col("protein2").alias("dst"))
    return G.heat_contributions(e, _heats(t), t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")), 0.5, tolerance=1e-6)


@query("spanning_forest", "W12", shapes.with_("comp", body="""
SELECT component, CAST(count(*) - 1 AS BIGINT) AS tree_edges FROM comp GROUP BY ALL HAVING count(*) > 1"""))
def _(t):
    e = strong(t)
    comp = G.connected_components(e)
    return G.spanning_forest(e).join(comp, F.col("src") == F.col("node")).groupBy("component").agg(F.count(F.lit(1)).alias("tree_edges"))


@query("one_edge_per_node", "W13", shapes.with_("links", body="""
, e AS (SELECT protein1 AS src, protein2 AS dst, row_number() OVER (ORDER BY combined_score DESC, protein1, protein2) AS i FROM links WHERE combined_score > 480),
m AS (WITH RECURSIVE m AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT e.i, CASE WHEN list_has_any(used, [src, dst]) THEN used ELSE list_concat(used, [src, dst]) END, CASE WHEN list_has_any(used, [src, dst]) THEN kept ELSE list_append(kept, e.i) END FROM m JOIN e ON e.i = m.i + 1)
  SELECT kept FROM m ORDER BY i DESC LIMIT 1)
SELECT src, dst FROM e WHERE i IN (SELECT unnest(kept) FROM m)"""))
def _(t):
    return G.one_edge_per_node(strong(t, 480), [-F.col("combined_score")])


def _complexes(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("complex_id")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("g"), F.col("l_partkey").cast("string")))), ";").alias("subunits_uniprot_id")
    )


@query("complexes_for_epic", "W15 R66 R101", """
WITH c AS (SELECT l_orderkey AS complex_id, list_sort(list(DISTINCT 'g' || CAST(l_partkey AS VARCHAR))) AS m FROM lineitem GROUP BY ALL)
SELECT complex_id, array_to_string(m, chr(9)) AS members FROM c WHERE len(m) > 2""")
def _(t):
    return G.complexes_for_epic(_complexes(t))


def _hops(t):
    return G.hop_distances(strong(t), 5).where(F.col("source") < F.col("node")).select(F.col("source").alias("gene1"), F.col("node").alias("gene2"), "hops")


def _members(t):
    gene = F.concat(F.lit("g"), F.col("l_partkey").cast("string"))
    return t.lineitem.select(F.col("l_orderkey").alias("complex_id"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("complex_name"), gene.alias("gene"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("protein")).distinct()


@query("decoy_complexes", "W14", None)
def _(t):
    return G.decoy_complexes(_members(t), _hops(t))


@query("targets_and_decoys", "W14", """
WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS g FROM lineitem), s AS (SELECT c, count(*) AS n FROM m GROUP BY c)
SELECT CAST(c AS VARCHAR) AS complex_id, false AS decoy, n AS genes FROM s UNION ALL SELECT 'decoy_' || c || CASE k WHEN 1 THEN '' ELSE '_' || k END, true, n FROM s, range(1, 3) r(k) WHERE n >= 2""")
def _(t):
    d = G.targets_and_decoys(_members(t), _hops(t), per_complex=2)
    return d.groupBy("complex_id", "decoy").agg(F.countDistinct("gene").alias("genes"))


shapes.cte("tsne", """SELECT 'g' || CAST(p_partkey AS VARCHAR) AS gene, p_brand AS cluster, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y, 'prey' AS type, p_type <> 'ECONOMY' AS "nameMatch" FROM part
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), NULL, s_acctbal / 100, CAST(s_nationkey AS DOUBLE), 'bait', NULL FROM supplier""")


def _tsne(t):
    p = t.part.select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene"), F.col("p_brand").alias("cluster"), F.col("p_size").cast("double").alias("x"),
        (F.col("p_retailprice") / 100).alias("y"), F.lit("prey").alias("type"), (F.col("p_type") != "ECONOMY").alias("nameMatch"),
    )
    s = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("gene"), F.lit(None).cast("string").alias("cluster"), (F.col("s_acctbal") / 100).alias("x"),
        F.col("s_nationkey").cast("double").alias("y"), F.lit("bait").alias("type"), F.lit(None).cast("boolean").alias("nameMatch"),
    )
    return p.unionByName(s)


@query("module_centers", "W16 R62", shapes.with_("tsne", body="""
SELECT cluster, median(x) AS x, round(median(y), 6) AS y, count(*) AS "N", sqrt(count(*)) AS radius FROM tsne WHERE "nameMatch" AND type = 'prey' GROUP BY ALL"""))
def _(t):
    return G.module_centers(_tsne(t), ["cluster"]).withColumn("y", R("y", 6))


@query("module_edges", "W16", shapes.with_("tsne", "bait_prey", body="""
SELECT bait, cluster, count(*) AS "N" FROM bait_prey JOIN tsne ON prey = gene WHERE "nameMatch" AND type = 'prey' GROUP BY ALL"""))
def _(t):
    return G.module_edges(_tsne(t), shapes.bait_prey(t))


@query("edge_view", "W16", shapes.with_("tsne", "bait_prey", body="""
, e AS (SELECT bait, prey, a.x, a.y, b.x AS xend, b.y AS yend, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length
   FROM bait_prey JOIN tsne a ON bait = a.gene JOIN tsne b ON prey = b.gene)
SELECT bait, prey, round(length, 6) AS length, round(CASE WHEN length > 20 THEN x + (xend - x) * 10 / length ELSE xend END, 6) AS xend_stub,
   round(CASE WHEN length > 20 THEN y + (yend - y) * 10 / length ELSE yend END, 6) AS yend_stub FROM e"""))
def _(t):
    e = G.edge_view(_tsne(t), shapes.bait_prey(t), 20, 10)
    return e.select("bait", "prey", *[R(c, 6).alias(c) for c in ("length", "xend_stub", "yend_stub")])


@query("baits_per_prey", "W16", shapes.with_("bait_prey", body='SELECT prey, count(*) AS "baitPerPrey" FROM bait_prey GROUP BY ALL'))
def _(t):
    return G.baits_per_prey(shapes.bait_prey(t))


@query("modules_from_distance", "W18", shapes.with_("comp", body="""
, s AS (SELECT component, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) >= 4)
SELECT node AS gene, component AS cluster, size FROM comp JOIN s USING (component)"""))
def _(t):
    d = shapes.links(t).select(F.col("protein1").alias("a"), F.col("protein2").alias("b"), (1000 / F.col("combined_score")).alias("distance"))
    return G.modules_from_distance(d, 1000 / 640.5, 4)


@query("modules_by_average_linkage", "W18", None)
def _(t):
    d = G.largest_component(strong(t)).select(F.col("src").alias("a"), F.col("dst").alias("b"), (1000 / F.col("combined_score")).alias("distance"))
    return G.modules_by_average_linkage(d)
