"""Delimited tables, FASTA, SAM, PDB, JSON results, archives and job logs.

Readers split into a scan and a parser: parsers take a DataFrame of text, so
the same code runs on files, on table columns and under ``readStream.text``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.functions.columns import base_name
from spectraloom.functions.session import spread


def table_or_path(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A DataFrame passes through; a path is read as a delimited table."""
    return source if isinstance(source, DataFrame) else read_delimited(spark, source, **options)


def read_delimited(spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None, sep: str = "\t", header: bool = True, null: str = "NA", file_column: str | None = None) -> DataFrame:
    """Delimited files; a known schema avoids the extra inference pass.

    A gzip file is one split: repartition after reading a large one.
    """
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", null)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.withColumn(file_column, base_name(F.input_file_name())) if file_column else df


def read_named(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Headerless file with given column names and types."""
    return read_delimited(spark, path, schema, sep, header=False)


def read_skipping(spark: SparkSession, path: str, skip: int, columns: list[str], sep: str = "\t") -> DataFrame:
    """File whose table starts after ``skip`` lines and a header; short rows are padded with null.

    The preamble and header are told apart by their place: lines of one file
    block are numbered in a row, and the first ``skip + 1`` of each file's first
    block are left out. Blank lines are dropped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    first = lines.where("_block = 0").groupBy(F.col("_file").alias("_f")).agg(F.min("_n").alias("_first"))
    body = lines.join(first, F.col("_file") == F.col("_f"))
    body = body.where(((F.col("_block") > 0) | (F.col("_n") - F.col("_first") > skip)) & (F.trim("value") != ""))
    part = F.split("value", sep)
    return body.select(*[F.try_element_at(part, F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Local parquet snapshot of a reference table, partition pruned when it was written partitioned."""
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", compression: str | None = None) -> None:
    w = df.write.mode("overwrite").option("sep", sep).option("header", True).option("nullValue", "NA")
    (w.option("compression", compression) if compression else w).csv(path)


# --- FASTA ----------------------------------------------------------------------

def parse_fasta(records: DataFrame, column: str = "value", expand_ids: bool = True) -> DataFrame:
    """Records (``>header\\nSEQ...``) to ``header, db, uniprot, uniprotName, sequence``.

    ``sp|ID|NAME`` headers are split; others are the id as they stand. Packed
    ids (``A;B``) become one row each.
    """
    text = F.regexp_replace(F.col(column), r"^\s*>?", "")
    header = F.split(text, "\n", 2)[0]
    seq = F.regexp_replace(F.coalesce(F.try_element_at(F.split(text, "\n", 2), F.lit(2)), F.lit("")), r"\s", "")
    d = records.select(F.trim(header).alias("header"), seq.alias("sequence")).where(F.col("header") != "")
    part = F.split("header", r"\|")
    piped = F.col("header").contains("|")
    d = d.select(
        "header", F.when(piped, part[0]).alias("db"), F.when(piped, part[1]).otherwise(F.col("header")).alias("uniprot"),
        F.when(piped, F.split(F.try_element_at(part, F.lit(3)), " ")[0]).alias("uniprotName"), "sequence",
    )
    return d.withColumn("uniprot", F.explode(F.split("uniprot", ";"))) if expand_ids else d


def read_fasta(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_fasta(spark.read.option("lineSep", "\n>").text(path), **options)


# --- SAM, FASTQ, PDB ------------------------------------------------------------

SAM_COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]  # fixed values: SAM fields


def parse_sam(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Alignment lines to typed columns with strand from the flag."""
    part = F.split(column, "\t")
    whole = {"flag", "pos", "mapq", "pnext", "tlen"}
    d = lines.where(~F.col(column).startswith("@"))
    d = d.select(*keep, *[(part[i].cast("int") if c in whole else part[i]).alias(c) for i, c in enumerate(SAM_COLUMNS)])
    return d.withColumn("strand", F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path).withColumn("file", base_name(F.input_file_name())), keep=("file",))


def parse_pdb(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed-width ATOM records."""
    c = F.col(column)
    field = lambda start, size: F.trim(F.substring(c, start, size))
    return lines.where(c.startswith("ATOM")).select(
        *keep, field(7, 5).cast("int").alias("serial"), field(13, 4).alias("name"), field(18, 3).alias("resid"), field(22, 1).alias("chain"),
        field(23, 4).cast("int").alias("resno"), field(31, 8).cast("double").alias("x"), field(39, 8).cast("double").alias("y"), field(47, 8).cast("double").alias("z"), field(77, 2).alias("elesy"),
    )


# --- JSON results ---------------------------------------------------------------

RESULT_SCHEMA = "chain_pair_iptm array<array<double>>, iptm double, ptm double, ranking_score double"


def parse_pair_scores(results: DataFrame, file: str = "file", chain_names: bool | None = None) -> DataFrame:
    """One row per chain pair ``i < j``; job and model number come from the file name.

    Chain names are taken from the job name when its parts match the chains.
    """
    d = results.withColumn("job", F.regexp_extract(file, "fold_([^/]*)_summary", 1)).withColumn("modelnum", F.regexp_extract(file, r"(\d+)\.json$", 1).cast("int"))
    d = d.select("*", F.posexplode("chain_pair_iptm").alias("_i", "_row")).select("*", F.posexplode("_row").alias("_j", "pairIptm")).where(F.col("_i") < F.col("_j"))
    parts = F.split("job", "_")
    named = F.size(parts) == F.size("chain_pair_iptm") if chain_names is None else F.lit(chain_names)
    return d.select(
        "job", "modelnum", "iptm", "ptm", F.col("ranking_score").alias("rankingScore"), (F.col("_i") + 1).alias("protIdx1"), (F.col("_j") + 1).alias("protIdx2"), "pairIptm",
        F.when(named, F.try_element_at(parts, F.col("_i") + 1)).alias("prot1"), F.when(named, F.try_element_at(parts, F.col("_j") + 1)).alias("prot2"),
    )


def read_pair_scores(spark: SparkSession, path: str) -> DataFrame:
    return parse_pair_scores(spark.read.schema(RESULT_SCHEMA).option("multiLine", True).json(path).withColumn("file", F.input_file_name()))


def parse_json_text(df: DataFrame, text: str, file: str) -> DataFrame:
    return df.select(F.col(file).alias("file"), F.from_json(text, RESULT_SCHEMA).alias("j")).select("file", "j.*")


def unzip_members(files: DataFrame, pattern: str = "summary_confidences") -> DataFrame:
    """``file, text`` of the archive members whose name holds ``pattern``."""

    def members(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(n, z.read(n).decode("utf-8")) for n in z.namelist() if pattern in n]
            yield pd.DataFrame(rows, columns=["file", "text"])

    return files.select("content").mapInPandas(members, "file string, text string")


def read_pair_scores_archive(spark: SparkSession, path: str) -> DataFrame:
    files = spread(spark.read.format("binaryFile").load(path), "path")
    return parse_pair_scores(parse_json_text(unzip_members(files), "text", "file"))


# --- job logs -------------------------------------------------------------------

def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``path.log:...]message`` lines to log name, job, task and message."""
    part = F.split(column, r"\]", 2)
    name = F.split(part[0], r"\.log")[0]
    ids = F.split(name, "-")
    return lines.select("*", name.alias("logBaseName"), F.try_element_at(ids, F.lit(-2)).cast("int").alias("jobID"), F.try_element_at(ids, F.lit(-1)).cast("int").alias("taskID"), F.trim(part[1]).alias("message"))


def exclude_values(df: DataFrame, column: str | Column, values: list) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.where(~c.isin(values))
