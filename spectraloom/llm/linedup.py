"""Deletion of repeated line runs by a suffix array over line numbers.

Lines are numbered by the order of their digests; prefix doubling ranks the
suffixes of every document by their first 1, 2, 4, ... lines. Only suffixes that
still tie with another are carried on: a line that occurs once ends every
repeated run. Two runs of length L are equal when their ranks at the largest
power of two in L agree at the start and at the end, that is, when they lie in
one interval of the suffix array whose longest common prefix reaches L.

A repeated run counts from ``min_words`` words on. It is found through the
shortest stretches with that many words that begin, or end, at each of its
lines; together they cover the run, and each is repeated itself. In every
interval the earliest stretch (by doc_id, place) stays and the later copies'
lines are deleted, overlapping repeats inside one document included.

Hot lines are counted with a map-side combine and joined by splittable joins;
ranks come from range partitions, never from one sorted group. Windows run
inside one document.

Null ids come first in the order, a null text stays null, a text without lines
to delete stays as it is. Rows equal in id and text are one document given
twice and lose the same lines; with equal ids and different texts the smaller
key of the text comes first. Other columns are kept, ``n_chars`` is not touched
here. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import free_names, lines_of, row_key, shuffle_width, staged


def word_count(line: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.translate(line, "\t\r\n\f\u000b", "     "), " ", -1), ""))


def dense_ranks(values: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Number distinct rows in the order of ``columns``: range partitions, numbered inside, plus the rows before."""
    n = shuffle_width(values.sparkSession)
    t = staged(values.repartitionByRange(n, *columns).withColumn("_p", F.spark_partition_id()), "ranks")
    ahead = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # at most n rows
    ahead = ahead.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*columns))
    return t.withColumn("_i", inside).join(F.broadcast(ahead), "_p").select(*columns, (F.col("_ahead") + F.col("_i")).alias(out))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that occur more than once: key, doc_id, i, words, rank."""
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(lines_of()).alias("i", "line"))
    # digests are made once; long texts do not travel
    rows = staged(rows.select("key", "doc_id", "i", F.unhex(F.md5("line")).alias("digest"), word_count(F.col("line")).alias("words")), "lines")
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = dense_ranks(counted.select("digest"), ["digest"], "rank")
    found = rows.join(ranks, "digest").select("key", "doc_id", "i", "words", "rank")
    return staged(found.repartition(shuffle_width(docs.sparkSession), "key").dropDuplicates(["key", "i"]), "repeated-lines")


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest stretches of repeated lines with ``min_words`` words: key, doc_id, first, last."""
    doc = Window.partitionBy("key").orderBy("i")
    d = lines.withColumn("block", F.col("i") - F.row_number().over(doc))
    d = d.withColumn("upto", F.sum("words").over(Window.partitionBy("key", "block").orderBy("i"))).withColumn("before", F.col("upto") - F.col("words"))
    forth = Window.partitionBy("key", "block").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("key", "block").orderBy("upto").rangeBetween(1 - min_words, 0)
    d = d.select(
        "key", "doc_id", "i", "before", "upto",
        F.max("i").over(forth).alias("f_last"), F.max("upto").over(forth).alias("f_upto"), F.min("i").over(back).alias("b_first"), F.min("before").over(back).alias("b_before"),
    )
    both = F.array(
        F.when(F.col("f_upto") - F.col("before") >= min_words, F.struct(F.col("i").alias("first"), F.col("f_last").alias("last"))),
        F.when(F.col("upto") - F.col("b_before") >= min_words, F.struct(F.col("b_first").alias("first"), F.col("i").alias("last"))),
    )
    return d.select("key", "doc_id", F.explode(F.array_distinct(F.array_compact(both))).alias("w")).select("key", "doc_id", "w.first", "w.last").dropDuplicates(["key", "first", "last"])


def suffix_ranks(lines: DataFrame, longest: int) -> DataFrame:
    """Ranks of suffixes by their first 2^level lines, level by level, ties only: level, key, i, rank."""
    level, step = 0, 1
    ranks = lines.select(F.lit(0).alias("level"), "key", "i", "rank")
    out = ranks
    while 2 * step <= longest:
        ahead = ranks.select("key", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        pairs = ranks.join(ahead, ["key", "i"]).select("key", "i", "rank", "next")
        tied = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        order = dense_ranks(tied.select("rank", "next"), ["rank", "next"], "longer")
        level, step = level + 1, 2 * step
        ranks = staged(pairs.join(order, ["rank", "next"]).select(F.lit(level).alias("level"), "key", "i", F.col("longer").alias("rank")), f"suffixes-{level}")
        out = out.unionByName(ranks)
    return out


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Runs of lines that repeat an earlier place, merged: key, doc_id, first, last."""
    lines = repeated_lines(docs)
    found = staged(stretches(lines, min_words).withColumn("size", F.col("last") - F.col("first") + 1), "stretches")
    longest = found.agg(F.max("size")).first()[0] or 0
    ranks = suffix_ranks(lines, longest)
    found = found.withColumn("level", F.floor(F.log2("size") + F.lit(1e-9)).cast("int"))
    begin = ranks.select("level", "key", F.col("i").alias("first"), F.col("rank").alias("begin"))
    end = ranks.select("level", "key", (F.col("i") + F.expr("shiftleft(1, level)") - 1).alias("last"), F.col("rank").alias("end"))
    found = found.join(begin, ["level", "key", "first"]).join(end, ["level", "key", "last"])
    found = staged(found.select("key", "doc_id", "first", "last", "size", "begin", "end", F.struct("doc_id", "key", "first").alias("at")), "runs")
    # a table of its own: the join with a much repeated interval can then be split
    interval = staged(found.groupBy("size", "begin", "end").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1"), "intervals")
    later = found.join(interval, ["size", "begin", "end"]).where(~F.col("at").eqNullSafe(F.col("earliest")))
    doc = Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    later = later.select("key", "doc_id", "first", "last", F.max("last").over(doc).alias("reach"))
    fresh = F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1), 1).otherwise(0)
    later = later.withColumn("run", F.sum(fresh).over(Window.partitionBy("key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy("key", "run").agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def drop_repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with the later copies of repeated runs cut out of ``text``; adds n_lines and n_deleted.

    Underscores are put before names that ``docs`` has.
    """
    key, place, total, gone = free_names(docs, "key", "runs", "n_lines", "n_deleted")
    runs = repeated_runs(docs, min_words).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(place)).withColumnRenamed("key", key)
    d = docs.withColumn(key, row_key()).join(runs, key, "left")
    lines = lines_of()
    kept = F.filter(lines, lambda line, i: ~F.exists(place, lambda r: (i >= r["first"]) & (i <= r["last"])))
    cut = F.aggregate(place, F.lit(0), lambda a, r: (a + r["last"] - r["first"] + 1).cast("int"))
    columns = [F.when(F.col(place).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return d.select(*columns, F.size(lines).alias(total), F.coalesce(cut, F.lit(0)).alias(gone))
