"""Fill-in-middle: documents cut into prefix, middle and suffix by counted regular expressions.

A token is a run of ASCII letters or any other single code point.
``regexp_count`` gives the number n of tokens; two places drawn from the
document's id cut there. One pattern per row, made of the two token counts with
possessive quantifiers (``(unit){a}+``, so the match never backtracks and never
recurses), captures the three parts in one match. Everything is a projection:
no row moves, and a text is only held while its row is worked on.

Forms: ``psm`` writes ``<P>prefix<S>suffix<M>middle``, ``spm`` writes
``<S>suffix<P>prefix<M>middle``, ``plain`` is the text itself. A text that is
empty or holds one of the marks stays plain, so a mark in an output that is not
plain is always one that was put there, and ``restored`` gives the text back.

Null text is empty text. A null id draws as an empty id. Equal rows get equal
results, each of its own. Other columns, also ones named like the results, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: the same unit inside the pattern of a row; a run of letters is never given back
POSSESSIVE_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"


def _draws(doc_id: str, seed: int) -> Column:
    """Four unsigned 32-bit draws from ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _row_pattern(before: Column, between: Column) -> Column:
    unit = F.lit(POSSESSIVE_UNIT)
    return F.concat(F.lit("(?s)\\A("), unit, F.lit("{"), before.cast("string"), F.lit("}+)("), unit, F.lit("{"), between.cast("string"), F.lit("}+)(.*)\\z"))


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix, output of every row; the parts are null where plain."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _draws("doc_id", seed).alias("draws"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    one, two = F.col("draws")[0] % (F.col("n") + 1), F.col("draws")[1] % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKS) | (F.col("draws")[2] % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("draws")[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("before"), F.abs(one - two).alias("between"))
    # a text that is cut holds no mark, so a mark can part the groups of the match
    parted = F.regexp_replace("text", _row_pattern(F.col("before"), F.col("between")), F.lit(f"$1{MIDDLE}$2{MIDDLE}$3"))
    rows = rows.select("doc_id", "text", "n", "form", F.when(F.col("form") != "plain", F.split(parted, MIDDLE, -1)).alias("parts"))
    rows = rows.select("doc_id", "text", "n", "form", *[F.col("parts")[i].alias(part) for i, part in enumerate(("prefix", "middle", "suffix"))])
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.withColumn("output", output)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text again, from the output and the form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, MARKS, -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The operator's rows with digests in place of texts."""
    rows = fill_in_middle(docs)
    length = [F.char_length(part).cast("long").alias(f"{part}_chars") for part in ("prefix", "middle")]
    rows = rows.select("doc_id", "n", "form", *length, "output", restored().alias("restored"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])
