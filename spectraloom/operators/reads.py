"""Sequencing reads, splice sites, structure contacts, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.columns import base_name
from spectraloom.operators.relational import distance_join, range_join
from spectraloom.operators.sites import align_pairs, aligned_position_map

# fixed values: the 27-base leader and the splice centres of the reference genome
LEADER = "CTTTCGATCTCTTGTAGATCTGTTCTC"
SPLICE_CENTERS = {
    "genomic": 67, "S": 21553, "orf3": 25382, "E": 26237, "M": 26470, "orf6": 27041, "orf7": 27385, "orf8": 27885, "N": 28257, "nonc_9b": 28280, "Nstar": 28878,
}
# fixed values: van der Waals radii by element
RADII = {"H": 1.2, "C": 1.7, "N": 1.55, "O": 1.52, "S": 1.8}


def reverse_complement(c: str | Column) -> Column:
    return F.translate(F.reverse(c), "ACGTacgt", "TGCAtgca")


def reads_with_leader(reads: DataFrame, sequence: str = "sequence", literal: str = LEADER) -> DataFrame:
    """Reads that hold the literal on either strand."""
    back = literal[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return reads.where(F.col(sequence).contains(literal) | F.col(sequence).contains(back))


def trim_leader(reads: DataFrame, sequence: str = "sequence", quality: str | None = "quality", literal: str = LEADER) -> DataFrame:
    """Cut the literal (either strand, rightmost) and everything left of it."""
    back = literal[::-1].translate(str.maketrans("ACGT", "TGCA"))
    c = F.col(sequence)
    last = lambda x: F.when(c.contains(x), F.length(c) - F.length(F.substring_index(c, x, -1)))
    cut = F.coalesce(F.greatest(last(literal), last(back)), F.lit(0))
    out = reads.withColumn("_cut", cut)
    if quality is not None and quality in reads.columns:
        out = out.withColumn(quality, F.col(quality).substr(F.col("_cut") + 1, F.length(quality)))
    return out.withColumn(sequence, c.substr(F.col("_cut") + 1, F.length(c))).drop("_cut")


def fastq_records(lines: DataFrame, order: str, keys: list[str], column: str = "value") -> DataFrame:
    """Four-line records from numbered lines (``order`` from 0 in each file)."""
    d = lines.withColumn("_r", F.floor(F.col(order) / 4)).withColumn("_k", F.pmod(order, F.lit(4)))
    pick = lambda k: F.max(F.when(F.col("_k") == k, F.col(column)))
    return d.groupBy(*keys, F.col("_r").alias("record")).agg(pick(0).alias("name"), pick(1).alias("sequence"), pick(3).alias("quality"))


def start_position_counts(alignments: DataFrame, file: str = "file") -> DataFrame:
    return alignments.where(F.col("strand") == "+").groupBy(file, "pos").agg(F.count(F.lit(1)).alias("N"))


def position_map(genomes: DataFrame, reference: str) -> DataFrame:
    """``fasta, ref_pos, other_pos`` of letters aligned to the reference sequence.

    One alignment per genome, so the pair table is as wide as the genome list.
    """
    d = align_pairs(genomes.select("fasta", F.lit(reference).alias("from_seq"), F.col("sequence").alias("to_seq")))
    d = aligned_position_map(d, ["fasta"], None)
    both = (F.col("FromAA") != "-") & (F.col("ToAA") != "-")
    return d.select("fasta", F.col("FromAA").alias("ref"), F.col("ToAA").alias("other"), F.col("FromPos").alias("ref_pos"), F.col("ToPos").alias("other_pos"), both.alias("aligned"))


def label_splice_sites(starts: DataFrame, genome_of_file: DataFrame, positions: DataFrame, centers: dict[str, int] | None = None, radius: int = 5) -> DataFrame:
    """Start counts with reference position and the splice site around it; unmatched rows stay."""
    table = starts.sparkSession.createDataFrame([(k, v, v - radius, v + radius) for k, v in (centers or SPLICE_CENTERS).items()], "splice_name string, splice_center int, _lo int, _hi int")
    d = starts.join(genome_of_file.select("file", "fasta"), "file", "left")
    p = positions.where("aligned").select("fasta", F.col("other_pos").alias("pos"), "ref_pos")
    d = d.join(p, ["fasta", "pos"], "left")
    known = range_join(d.where(F.col("ref_pos").isNotNull()), table, "ref_pos", "_lo", "_hi", 4 * radius, inclusive=False, how="left")
    gone = d.where(F.col("ref_pos").isNull()).withColumn("splice_name", F.lit(None).cast("string")).withColumn("splice_center", F.lit(None).cast("int"))
    return known.drop("_lo", "_hi").unionByName(gone)


def total_reads(read_counts: DataFrame, fastq_map: DataFrame) -> DataFrame:
    """Full join of task counts (``key, totalReads``) with task files (``key`` = ``task:fastq``)."""
    a = read_counts.select(F.split("key", ":")[0].alias("taskFile"), "totalReads")
    b = fastq_map.select(F.split("key", ":")[0].alias("taskFile"), F.split("key", ":")[1].alias("fastqFile"))
    return a.join(b, "taskFile", "full").withColumn("file", F.regexp_replace(base_name("fastqFile"), r"\.fastq(\.gz)?", ""))


def mean_pair_scores(scores: DataFrame) -> DataFrame:
    m = scores.groupBy("job", "protIdx1", "protIdx2").agg(F.avg("pairIptm").alias("meanPairIptm"), F.avg("rankingScore").alias("meanRankingScore"))
    return scores.join(m, ["job", "protIdx1", "protIdx2"])


def residue_contacts(atoms: DataFrame, errors: DataFrame | None = None, gap: float = 0.5, key: str = "file") -> DataFrame:
    """Residue pairs across chains closer than their radii plus ``gap``, per structure.

    Residues are also numbered over the whole multimer (earlier chains' lengths
    added); the error of the pair (``file, i, j, pae``) is looked up by those numbers.
    """
    radius = F.coalesce(*[F.when(F.col("elesy") == k, v) for k, v in RADII.items()])
    a = atoms.select(key, "chain", "resno", "x", "y", "z", radius.alias("r"))
    b = a.select(key, F.col("chain").alias("chainCol"), F.col("resno").alias("resnoCol"), "x", "y", "z", F.col("r").alias("rCol"))
    near = distance_join(a, b, ["x", "y", "z"], 2 * max(RADII.values()) + gap, [key])
    hit = near.where((F.col("chain") < F.col("chainCol")) & (F.col("distance") - F.col("r") - F.col("rCol") < gap))
    c = hit.select(key, F.col("chain").alias("chainRow"), F.col("resno").alias("resnoRow"), "chainCol", "resnoCol").distinct()
    size = atoms.groupBy(key, "chain").agg(F.max("resno").alias("_l"))
    before = size.withColumn("_off", F.coalesce(F.sum("_l").over(Window.partitionBy(key).orderBy("chain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for side in ("Row", "Col"):
        o = before.select(key, F.col("chain").alias(f"chain{side}"), "_off")
        c = c.join(o, [key, f"chain{side}"]).withColumn(f"mmerResno{side}", F.col(f"resno{side}") + F.col("_off")).drop("_off")
    if errors is None:
        return c
    e = errors.select(key, F.col("i").alias("mmerResnoRow"), F.col("j").alias("mmerResnoCol"), "pae")
    return c.join(e, [key, "mmerResnoRow", "mmerResnoCol"], "left")


def job_log_table(lines: DataFrame, order: str, chains: list[str], types: list[str]) -> DataFrame:
    """One row per job, task and model: seed, chains, alignment sizes, templates, start and seconds.

    ``lines`` are parsed log lines with an order column inside each log. The
    running alignment id counts pipeline starts within a log.
    """
    job = ["logBaseName", "jobID", "taskID"]
    start = F.col("message").contains("Running monomer pipeline on chain")
    w = Window.partitionBy("logBaseName").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("msaID", F.sum(start.cast("int")).over(w))
    word = F.split("message", " ")
    seeds = d.where(F.col("message").contains("Using random seed")).select(*job, word[3].alias("seed"))
    pieces = F.split("message", ":? ")
    long = d.where(start).select(*job, "msaID", pieces[5].alias("chainID"), pieces[6].alias("sequenceName"))
    wide = long.groupBy(*job).pivot("chainID", chains).agg(F.first("sequenceName"))
    kind = F.regexp_replace(F.split("message", " size: ")[0], "[ )(]+", "_")
    sizes = d.where(F.col("message").contains("MSA size")).select(*job, "msaID", kind.alias("msaType"), F.regexp_extract("message", r"MSA size: ([0-9]+) sequences", 1).cast("int").alias("msaSize"))
    sizes = sizes.join(long.select("logBaseName", "msaID", "chainID"), ["logBaseName", "msaID"])
    columns = sorted(f"{a}_{b}" for a in types for b in chains)
    sizes = sizes.withColumn("_c", F.concat_ws("_", "msaType", "chainID")).groupBy(*job).pivot("_c", columns).agg(F.first("msaSize"))
    tmpl = d.where(F.col("message").contains("Total number of templates")).select(*job, "msaID", F.regexp_extract("message", r" ([0-9]+)\.", 1).cast("int").alias("n"))
    tmpl = tmpl.join(long.select("logBaseName", "msaID", "chainID"), ["logBaseName", "msaID"]).withColumn("_c", F.concat(F.lit("templates_"), "chainID"))
    tmpl = tmpl.groupBy(*job).pivot("_c", [f"templates_{c}" for c in chains]).agg(F.first("n"))
    begun = d.where(F.col("message").startswith("Running model model_")).select(*job, word[2].alias("model"), word[4].alias("pair"))
    ended = d.where(F.col("message").startswith("Total JAX model model_")).select(
        *job, word[3].alias("model"), word[5].alias("pair"), F.regexp_extract("message", r"([0-9.]+)s$", 1).cast("double").alias("predictTime")
    )
    out = seeds.join(wide, job).join(sizes, job).join(tmpl, job).join(begun, job)
    return out.join(ended, [*job, "model", "pair"], "full")
