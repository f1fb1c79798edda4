"""Identifier translation: one engine, many lookups."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.columns import as_col, first_row, pack_ordered, unpack
from spectraloom.functions.session import cut, spread
from spectraloom.operators.sites import split_protein_site


def translate(
    df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, out: str, fill_missing: bool = False, first_only: bool = True,
    order: list[Column] | None = None,
) -> DataFrame:
    """Attach ``lookup[target]`` where ``lookup[source]`` equals ``column``; every row is kept.

    With several matches the first by ``order`` (default: the target itself) is
    taken, or all of them. Work is done on distinct ids and joined back.
    """
    table = lookup.where(F.col(source).isNotNull()).select(F.col(source).alias("_s"), F.col(target).alias("_t"), *[o.alias(f"_o{i}") for i, o in enumerate(order or [])])
    if first_only:
        table = first_row(table, ["_s"], [*[F.col(f"_o{i}") for i in range(len(order or []))], F.col("_t")])
    table = table.select("_s", "_t").distinct()
    got = df.join(table, df[column] == table["_s"], "left").drop("_s")
    value = F.coalesce("_t", column) if fill_missing else F.col("_t")
    return got.withColumn(out, value).drop("_t")


def id_map_lookup(id_map: DataFrame, id_type: str) -> DataFrame:
    """Rows of one id type; on a table partitioned by ``idType`` only that partition is read."""
    return id_map.where(F.col("idType") == id_type).select("uniprot", "id")


def translate_id_type(df: DataFrame, column: str, id_map: DataFrame, id_type: str, out: str, reverse: bool = False, fill_missing: bool = False) -> DataFrame:
    m = id_map_lookup(id_map, id_type)
    source, target = ("id", "uniprot") if reverse else ("uniprot", "id")
    return translate(df, column, m, source, target, out, fill_missing)


def string_uniprot_table(raw: DataFrame) -> DataFrame:
    """``species, packed, string_id`` rows with ``packed`` = ``accession|name`` split."""
    parts = F.split("packed", r"\|")
    return raw.select("string_id", parts[0].alias("uniprot"), parts[1].alias("uniprot_name"))


def translate_isoform_gene(df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """Gene name of an isoform id: the base id is looked up, ``-iso n`` is appended."""
    d = df.withColumns({"_base": F.regexp_replace(column, "-[0-9]+$", ""), "_iso": F.regexp_extract(column, "-([0-9]+)$", 1)})
    d = translate(d, "_base", lookup, source, target, "_gene")
    gene = F.when(F.col("_iso") != "", F.concat(F.col("_gene"), F.lit("-iso"), F.col("_iso"))).otherwise(F.col("_gene"))
    return d.withColumn(out, gene).drop("_base", "_iso", "_gene")


def translate_packed(
    df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, out: str, sep: str = ";", replace_missing: bool = True,
    simplify: bool | Callable[[Column], Column] = False, allow_duplicates: bool = False,
) -> DataFrame:
    """Packed ids to packed names, in order; duplicate packed names are made unique with ``.id``.

    ``simplify`` may be True (sorted distinct) or a function on the array of names.
    """
    ids = df.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.posexplode(unpack(column, sep)).alias("_i", "_one"))
    t = translate(ids, "_one", lookup, source, target, "_name", fill_missing=replace_missing)
    rows = F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_i", "_name"))))
    names = F.transform(rows, lambda r: r["_name"])
    if simplify is True:
        names = F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))
    elif simplify:
        names = simplify(names)
    packed = t.groupBy(column).agg(F.array_join(names, sep).alias("_p"), F.max("_name").isNotNull().alias("_any")).where("_any").drop("_any")
    if not allow_duplicates:
        again = packed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        packed = packed.join(again, "_p").withColumn("_p", F.when(F.col("_n") > 1, F.concat_ws(".", "_p", column)).otherwise(F.col("_p"))).drop("_n")
    return df.join(packed.select(column, F.col("_p").alias(out)), column, "left").select(*df.columns, out)


def translate_packed_sites(df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, out: str, sep: str = ";", unique_only: bool = False) -> DataFrame:
    """Packed ``P_S5`` sites to packed ``GENE_S5`` sites; unknown proteins keep their id."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct().select(column, F.posexplode(unpack(column, sep)).alias("_i", "_one"))
    protein, site = split_protein_site("_one")
    d = translate(d.withColumns({"_protein": protein, "_site": site}), "_protein", lookup, source, target, "_gene", fill_missing=True)
    name = F.concat_ws("_", "_gene", "_site")
    if unique_only:
        d = d.groupBy(column, name.alias("_n")).agg(F.min("_i").alias("_i"))
        name = F.col("_n")
    packed = d.groupBy(column).agg(pack_ordered(name, "_i", sep=sep).alias(out))
    return df.join(packed, column, "left").select(*df.columns, out)


def translate_packed_any(df: DataFrame, column: str, lookup: DataFrame, source: str, target: str, out: str, **options) -> DataFrame:
    """Packed ids to packed ids of another type, untranslated ones dropped."""
    return translate_packed(df, column, lookup, source, target, out, replace_missing=False, **options)


def alias_to_symbol(df: DataFrame, column: str, aliases: DataFrame, out: str, prefix: str = "") -> DataFrame:
    """Official symbol of an alias; unknown aliases stay, with an optional prefix."""
    d = translate(df, column, aliases, "alias", "symbol", "_sym")
    return d.withColumn(out, F.coalesce("_sym", F.concat(F.lit(prefix), as_col(column)))).drop("_sym")


def alias_counts(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """How many distinct aliases are replaced, kept and not found."""
    d = translate(df.select(column).distinct(), column, aliases, "alias", "symbol", "_sym")
    return d.agg(
        F.count(F.lit(1)).alias("unique_aliases"), F.count_if(F.col("_sym") != F.col(column)).alias("replaced"), F.count_if(F.col("_sym").isNull()).alias("not_found")
    )


def add_descriptions(df: DataFrame, column: str, descriptions: DataFrame, add_symbol: bool = False, out: str = "description") -> DataFrame:
    text = F.concat_ws(" : ", "symbol", "description") if add_symbol else F.col("description")
    table = descriptions.select(F.col("uniprot").alias("_s"), text.alias("_d"), F.col("description").alias("_raw"))
    table = first_row(table, ["_s"], [F.col("_raw")]).select("_s", F.col("_d").alias(out))
    return df.join(table, df[column] == table["_s"], "left").drop("_s")


#: left proteins that are sent to all tasks
FEW_PROTEINS = 100_000


def ortholog_protein_pairs(homologs: DataFrame, left_map: DataFrame, right_map: DataFrame) -> DataFrame:
    """Protein pairs of two species from gene homologs and two gene-to-protein maps."""
    l = left_map.select(F.col("id").alias("left_gene"), F.col("uniprot").alias("left_uniprot")).distinct()
    r = spread(right_map.select(F.col("id").alias("right_gene"), F.col("uniprot").alias("right_uniprot")), "right_gene", "right_uniprot").distinct()
    # distinct sides make distinct pairs; a few left proteins go to all right ones, which stay spread by protein
    one = cut(homologs.select("left_gene", "right_gene").distinct().join(l, "left_gene"))
    one = F.broadcast(one) if one.count() <= FEW_PROTEINS else one
    return one.join(r, "right_gene").select("left_uniprot", "right_uniprot", "left_gene", "right_gene")


def map_aliases(ids: DataFrame, aliases: DataFrame, column: str = "id") -> DataFrame:
    """Ids to network ids through alias sources.

    Repeatedly take the source that names most of the still unmapped ids (ties:
    source name), use its first id per alias, and go on until no source helps.
    """
    left = cut(ids.select(F.col(column).alias("alias")).distinct())
    table = cut(aliases.join(left, "alias", "left_semi").select("string_id", "alias", "source"))
    parts = []
    while True:
        counts = table.join(left, "alias", "left_semi").groupBy("source").agg(F.countDistinct("alias").alias("n"))
        best = counts.orderBy(F.col("n").desc(), "source").first()
        if best is None:
            break
        hit = table.where(F.col("source") == best["source"]).join(left, "alias", "left_semi").groupBy("alias").agg(F.min("string_id").alias("string_id"), F.first("source").alias("source"))
        hit = cut(hit)
        parts.append(hit)
        left = cut(left.join(hit, "alias", "left_anti"))
    if not parts:
        return table.limit(0).select("alias", "string_id", "source")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preferred_names(df: DataFrame, column: str, info: DataFrame, out: str = "preferred_name") -> DataFrame:
    return translate(df, column, info, "string_id", "preferred_name", out)


def compounds_to_genes(compound_reaction: DataFrame, reaction_ortholog: DataFrame, ortholog_gene: DataFrame) -> DataFrame:
    """Compound to reaction to ortholog group to gene, with the number of paths."""
    d = compound_reaction.join(reaction_ortholog, "reaction").join(ortholog_gene, "ortholog")
    return d.groupBy("compound", "gene").agg(F.count(F.lit(1)).alias("N"))


def strip_prefix(c: str | Column, prefix: str) -> Column:
    return F.regexp_replace(as_col(c), "^" + re.escape(prefix), "")
