"""Domain-shaped tables derived from the driver tables, in Spark and in SQL.

Each shape has a function (``msstats(t)``) and a SQL common table expression of
the same name in ``CTE``; ``with_(...)`` assembles the WITH clause of an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.plans.registry import Tables

CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    CTE[name] = sql
    NEEDS[name] = tuple(needs.split())


def with_(*names: str, body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order) + " " + body


# --- long peptide table ---------------------------------------------------------

cte("msstats", """
  SELECT p_brand AS ProteinName, CAST(l_partkey AS VARCHAR) AS PeptideSequence, l_linenumber AS PrecursorCharge,
         'L' AS IsotopeLabelType, l_returnflag || l_linestatus AS Condition,
         l_returnflag || l_linestatus || '.' || CAST(l_suppkey % 3 AS VARCHAR) AS BioReplicate,
         l_returnflag || l_linestatus || '_' || CAST(l_suppkey % 3 AS VARCHAR) AS Run,
         l_extendedprice AS Intensity
  FROM lineitem JOIN part ON l_partkey = p_partkey""")


def msstats(t: Tables) -> DataFrame:
    cond = F.concat("l_returnflag", "l_linestatus")
    rep = (F.col("l_suppkey") % 3).cast("string")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ProteinName"),
        F.col("l_partkey").cast("string").alias("PeptideSequence"),
        F.col("l_linenumber").alias("PrecursorCharge"),
        F.lit("L").alias("IsotopeLabelType"),
        cond.alias("Condition"),
        F.concat_ws(".", cond, rep).alias("BioReplicate"),
        F.concat_ws("_", cond, rep).alias("Run"),
        F.col("l_extendedprice").alias("Intensity"),
    )


# --- search-engine evidence and its key table -----------------------------------

cte("evidence", """
  SELECT l_returnflag || l_linestatus || '_' || CAST(l_suppkey % 3 AS VARCHAR) AS "Raw file",
         CASE WHEN p_size = 1 THEN 'CON__' || p_brand WHEN p_size = 2 THEN 'REV__' || p_brand
              WHEN p_size = 3 THEN p_brand || ';' || p_type WHEN p_size = 4 THEN '' ELSE p_brand END AS Proteins,
         '_' || replace(p_name, ' ', '(ox)') || CAST(l_partkey AS VARCHAR) || '_' AS "Modified sequence",
         CASE WHEN l_discount < 0.02 THEN 'MULTI-MATCH' ELSE 'MULTI-MSMS' END AS Type,
         l_linenumber AS Charge, CAST(l_quantity AS INTEGER) AS "MS/MS count",
         CASE WHEN l_discount = 0.0 THEN NULL WHEN l_discount = 0.01 THEN 0.0 ELSE l_extendedprice END AS Intensity
  FROM lineitem JOIN part ON l_partkey = p_partkey""")


def evidence(t: Tables) -> DataFrame:
    brand = F.col("p_brand")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.concat("l_returnflag", "l_linestatus"), F.lit("_"), (F.col("l_suppkey") % 3).cast("string")).alias("Raw file"),
        F.when(F.col("p_size") == 1, F.concat(F.lit("CON__"), brand))
        .when(F.col("p_size") == 2, F.concat(F.lit("REV__"), brand))
        .when(F.col("p_size") == 3, F.concat_ws(";", brand, "p_type"))
        .when(F.col("p_size") == 4, F.lit(""))
        .otherwise(brand)
        .alias("Proteins"),
        F.concat(F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("(ox)")), F.col("l_partkey").cast("string"), F.lit("_")).alias("Modified sequence"),
        F.when(F.col("l_discount") < 0.02, "MULTI-MATCH").otherwise("MULTI-MSMS").alias("Type"),
        F.col("l_linenumber").alias("Charge"),
        F.col("l_quantity").cast("int").alias("MS/MS count"),
        F.when(F.col("l_discount") == 0.0, None).when(F.col("l_discount") == 0.01, 0.0).otherwise(F.col("l_extendedprice")).alias("Intensity"),
    )


cte("keys", """
  SELECT DISTINCT l_returnflag || l_linestatus || '_' || CAST(l_suppkey % 3 AS VARCHAR) AS RawFile,
         l_returnflag || l_linestatus AS Condition,
         l_returnflag || l_linestatus || '.' || CAST(l_suppkey % 3 AS VARCHAR) AS BioReplicate, 'L' AS IsotopeLabelType
  FROM lineitem""")


def keys(t: Tables) -> DataFrame:
    cond = F.concat("l_returnflag", "l_linestatus")
    rep = (F.col("l_suppkey") % 3).cast("string")
    return t.lineitem.select(
        F.concat_ws("_", cond, rep).alias("RawFile"),
        cond.alias("Condition"),
        F.concat_ws(".", cond, rep).alias("BioReplicate"),
        F.lit("L").alias("IsotopeLabelType"),
    ).distinct()


# --- run-level protein table ----------------------------------------------------

cte("run_level", """
  SELECT ProteinName AS Protein, Condition AS GROUP_ORIGINAL, BioReplicate AS SUBJECT_ORIGINAL, Run AS RUN,
         avg(ln(Intensity) / ln(2.0)) AS LogIntensities
  FROM msstats GROUP BY ALL""", "msstats")


def run_level(t: Tables) -> DataFrame:
    return (
        msstats(t)
        .groupBy(
            F.col("ProteinName").alias("Protein"),
            F.col("Condition").alias("GROUP_ORIGINAL"),
            F.col("BioReplicate").alias("SUBJECT_ORIGINAL"),
            F.col("Run").alias("RUN"),
        )
        .agg(F.avg(F.log2("Intensity")).alias("LogIntensities"))
    )


# --- group-comparison results ---------------------------------------------------
# log2FC is quantised to thousandths so that ranks tie in the same way everywhere.

cte("results", """
  SELECT 'P' || CAST(l_partkey AS VARCHAR) AS Protein, 'S' || CAST(p_size AS VARCHAR) AS site,
         l_returnflag || '-' || l_linestatus AS Label,
         CASE WHEN sum(l_quantity) > 150 THEN 'Infinity'::DOUBLE WHEN sum(l_quantity) < 3 THEN '-Infinity'::DOUBLE
              ELSE round(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5, 3) END AS log2FC,
         CASE WHEN sum(l_quantity) > 150 OR sum(l_quantity) < 3 THEN NULL
              ELSE round((1 + sum(l_extendedprice * 100) % 9973) / 10000, 6) END AS pvalue,
         round(0.25 + CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 3) AS SE, CAST(count(*) + 2 AS BIGINT) AS DF
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_partkey, p_size, l_returnflag, l_linestatus""")


def results(t: Tables) -> DataFrame:
    q = F.sum("l_quantity")
    extreme = (q > 150) | (q < 3)

    def hundredths(c: str) -> Column:
        return F.sum(F.round(F.col(c) * 100).cast("bigint"))

    cents = hundredths("l_extendedprice")
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_partkey", "p_size", "l_returnflag", "l_linestatus")
        .agg(
            F.when(q > 150, float("inf")).when(q < 3, float("-inf")).otherwise(F.round(hundredths("l_discount") / F.count(F.lit(1)) - 5, 3)).alias("log2FC"),
            F.when(extreme, None).otherwise(F.round((1 + cents % 9973) / 10000, 6)).alias("pvalue"),
            F.round(0.25 + hundredths("l_tax") / F.count(F.lit(1)) / 100, 3).alias("SE"),
            (F.count(F.lit(1)) + 2).alias("DF"),
        )
        .select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("Protein"),
            F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("site"),
            F.concat_ws("-", "l_returnflag", "l_linestatus").alias("Label"),
            "log2FC",
            "pvalue",
            "SE",
            "DF",
        )
    )


CTE["results"] = CTE["results"].replace(
    "sum(l_extendedprice * 100) % 9973", "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) % 9973"
)

# --- gene sets and gene groups --------------------------------------------------

cte("gmt", """
  SELECT p_brand || ' ' || p_type AS ont, 'g' || CAST(p_partkey AS VARCHAR) AS gene FROM part
  UNION
  SELECT 'size ' || CAST(p_size AS VARCHAR) AS ont, 'g' || CAST(p_partkey AS VARCHAR) AS gene FROM part""")


def gmt(t: Tables) -> DataFrame:
    gene = F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("gene")
    return (
        t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("ont"), gene)
        .unionByName(
            t.part.select(F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("ont"), gene)
        )
        .distinct()
    )


cte("gene_groups", """
  SELECT DISTINCT n_name || ' q' || CAST(CAST(l_quantity AS INTEGER) // 10 AS VARCHAR) AS grp, 'g' || CAST(l_partkey AS VARCHAR) AS gene
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")


def gene_groups(t: Tables) -> DataFrame:
    band = F.floor(F.col("l_quantity") / 10).cast("string")
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat("n_name", F.lit(" q"), band).alias("grp"),
            F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("gene"),
        )
        .distinct()
    )


# --- bait-prey ------------------------------------------------------------------

cte("apms", """
  SELECT n_name AS bait, n_name || '_' || CAST(l_linenumber % 3 AS VARCHAR) AS run,
         CASE WHEN p_size = 7 THEN 'NATION_' || CAST(l_partkey % 25 AS VARCHAR) ELSE 'g' || CAST(l_partkey AS VARCHAR) END AS prey,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS spc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey GROUP BY ALL""")


def apms(t: Tables) -> DataFrame:
    pk = F.col("l_partkey")
    return (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.part, pk == F.col("p_partkey"))
        .groupBy(
            F.col("n_name").alias("bait"),
            F.concat_ws("_", "n_name", (F.col("l_linenumber") % 3).cast("string")).alias("run"),
            F.when(F.col("p_size") == 7, F.concat(F.lit("NATION_"), (pk % 25).cast("string")))
            .otherwise(F.concat(F.lit("g"), pk.cast("string")))
            .alias("prey"),
        )
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("spc"))
    )


cte("bait_prey", """
  SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS bait, 'g' || CAST(l_partkey AS VARCHAR) AS prey FROM lineitem""")


def bait_prey(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("bait"),
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("prey"),
    ).distinct()


# --- elution profiles -----------------------------------------------------------

cte("sec", """
  SELECT l_returnflag || l_linestatus AS sample, l_returnflag AS treatment,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS replicate, p_size AS fraction,
         's' || CAST(l_suppkey AS VARCHAR) AS protein, sum(l_extendedprice) AS intensity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")


def sec(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("sample"),
            F.col("l_returnflag").alias("treatment"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("replicate"),
            F.col("p_size").alias("fraction"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("protein"),
        )
        .agg(F.sum("l_extendedprice").alias("intensity"))
    )


# --- graph edges ----------------------------------------------------------------

cte("links", """
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS protein1, 'g' || CAST(l_partkey AS VARCHAR) AS protein2,
         CAST(sum(CAST(l_quantity AS BIGINT)) * 8 AS BIGINT) AS combined_score,
         CAST(count(*) * 300 AS BIGINT) AS experimental
  FROM lineitem GROUP BY ALL""")


def links(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("protein1"),
        F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("protein2"),
    ).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) * 8).alias("combined_score"),
        (F.count(F.lit(1)) * 300).alias("experimental"),
    )


# --- site results and kinase knowledge ------------------------------------------

cte("site_results", """
  SELECT p_brand || '_S' || CAST(p_size AS VARCHAR) || ';' || p_brand || '_T' || CAST(p_partkey AS VARCHAR) AS Protein, Label, log2FC, pvalue
  FROM results JOIN part ON Protein = 'P' || CAST(p_partkey AS VARCHAR)""", "results")


def site_results(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    packed = F.concat("p_brand", F.lit("_S"), F.col("p_size").cast("string"), F.lit(";"), "p_brand", F.lit("_T"), key)
    return results(t).join(t.part, F.col("Protein") == F.concat(F.lit("P"), key)).select(packed.alias("Protein"), "Label", "log2FC", "pvalue")


cte("kinase_data", """
  SELECT 'K_' || p_type || '_' || CAST(p_size % 7 AS VARCHAR) AS "CTRL_GENE_NAME", p_brand AS "TARGET_GENE_NAME", 'S' AS "TARGET_RES", p_size AS "TARGET_POS",
         p_brand AS "TARGET_UP_ID" FROM part""")


def kinase_data(t: Tables) -> DataFrame:
    return t.part.select(
        F.concat(F.lit("K_"), "p_type", F.lit("_"), (F.col("p_size") % 7).cast("string")).alias("CTRL_GENE_NAME"),
        F.col("p_brand").alias("TARGET_GENE_NAME"), F.lit("S").alias("TARGET_RES"), F.col("p_size").alias("TARGET_POS"), F.col("p_brand").alias("TARGET_UP_ID"),
    )


# --- sequences and peptides -----------------------------------------------------

cte("seqs", """SELECT 'D' || CAST(doc_id AS VARCHAR) AS uniprot, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents""")
cte("peps", """SELECT uniprot, sequence, substr(sequence, 1 + CAST(substr(uniprot, 2) AS INTEGER) % 50, 12) AS clean FROM seqs""", "seqs")


def seqs(t: Tables) -> DataFrame:
    return t.documents.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("uniprot"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")
    )


def peps(t: Tables) -> DataFrame:
    """Twelve-letter stretches of each sequence, whole sequence kept alongside."""
    return seqs(t).withColumn("clean", F.expr("substring(sequence, 1 + cast(substring(uniprot, 2) as int) % 50, 12)"))
