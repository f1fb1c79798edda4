"""Personal data by candidate gradient boosting, on DataFrame functions only.

Generators propose overlapping spans: the four base patterns (email, ip, card,
phone) and looser ones (addresses spelled with "at" and "dot", telephone
numbers without a plus sign, long digit groups). A base candidate that passes
its check is a base span. Boosted trees learn from the base candidates, passed
against failed, on format and context; their scores are calibrated into one
threshold per kind on held-out candidates, and looser candidates at or above it
that touch no base span are added. Base spans always stay.

The trees are fitted on all labelled candidates but a third;
everything else covers every candidate of every whole text. With fewer than
``LEAST`` candidates of either label nothing is added.

Offsets count code points, ends exclusive. Null text is empty text. Every row is
a document, whatever its id; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import staged

KINDS = ("email", "ip", "card", "phone")
# possessive forms of the base patterns: equal matches, linear time; \G lets a match follow right after another
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "card": r"(?<![0-9.+-])[0-9]{3,6}(?:[ -][0-9]{3,6}){2,4}(?![0-9.-])",
}
LEAST, PRECISION = 50, 0.95
WORDS = r"(?i)(tel|phone|call|fax|mail|card|visa|host|addr|ip|contact)[^a-z]*$"


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_rest(digits: Column) -> Column:
    """Luhn sum modulo 10 of at most 30 digits."""
    n = F.length(digits)
    places = F.when((n > 0) & (n <= 30), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = (n - i) % 2 == 1
        return F.when(doubled & (d > 4), d * 2 - 9).when(doubled, d * 2).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda a, i: (a + value(i)).cast("int")) % 10


def passes(kind: Column, value: Column) -> Column:
    """The base checks."""
    digits = digits_of(value)
    n = F.length(digits)
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    card = F.when(n.between(16, 19), luhn_rest(digits) == 0).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).otherwise(n.between(8, 15))


def _proposed(text: Column, kind: str, base: bool, pattern: str) -> Column:
    """Matches in order, with the length of the gap before each and what stands around it."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def one(v: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.coalesce(F.get(gaps, i + 1), F.lit(""))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("i"), F.char_length(before).alias("gap"), v.alias("value"),
            F.substring(before, -16, 16).alias("before"), F.substring(after, 1, 16).alias("after"),
        )

    mark = F.contains(text, F.lit("@")) if kind == "email" and base else F.contains(text, F.lit("at")) if kind == "email" else text.rlike("[0-9]")
    empty = "array<struct<kind:string,base:boolean,i:int,gap:int,value:string,before:string,after:string>>"
    return F.when(mark, F.transform(values, one).cast(empty)).otherwise(F.array().cast(empty))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id; candidates: row, kind, base, start, end, value, before, after, passed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*[_proposed(F.col("_t"), k, b, p) for b, group in ((True, BASE), (False, LOOSE)) for k, p in group.items()])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t")).select("doc_id", every.alias("found"))
    d = staged(d.withColumn("row", F.monotonically_increasing_id()), "candidates")
    c = d.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "base", "kind").orderBy("i")
    c = c.withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(order)).withColumn("start", F.col("end") - F.char_length("value"))
    c = c.withColumn("passed", F.col("base") & passes(F.col("kind"), F.col("value")))
    return d.select("row", "doc_id"), staged(c.select("row", "kind", "base", "start", "end", "value", "before", "after", "passed"), "spans")


def _features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    v = F.col("value")
    digits = digits_of(v)
    groups = F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    left, right = F.substring("before", -1, 1), F.substring("after", 1, 1)
    made = {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
    made |= {
        "chars": F.char_length(v), "digits": F.length(digits), "signs": F.char_length(F.regexp_replace(v, "[A-Za-z0-9]", "")), "letters": F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "groups": F.size(groups), "first_group": F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), "last_group": F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), "different": F.size(F.array_distinct(F.split(digits, ""))), "luhn": luhn_rest(digits),
        "large_part": F.exists(groups, lambda g: (F.length(g) > 3) | (F.coalesce(g.try_cast("int"), F.lit(999)) > 255)), "dots": F.size(F.split(v, r"\.")), "at": F.contains(v, F.lit("@")) | F.contains(v, F.lit("at")),
        "left_word": left.rlike(r"[\p{L}_]"), "left_digit": left.rlike("[0-9]"), "left_sign": left.rlike(r"[^\s\p{L}0-9]"), "right_word": right.rlike(r"[\p{L}_]"), "right_digit": right.rlike("[0-9]"), "right_sign": right.rlike(r"[^\s\p{L}0-9]"),
        "left_name": F.col("before").rlike(WORDS), "left_equals": F.col("before").rlike(r"[=:]\s*[\"']?$"),
    }
    return c.select("*", *[e.cast("double").alias(f"f_{n}") for n, e in made.items()]), [f"f_{n}" for n in made]


def added_spans(c: DataFrame) -> DataFrame | None:
    """Looser candidates that the calibrated trees accept and that touch no base span: row, kind, start, end."""
    labelled = staged(c.where("base"), "fit")
    good, bad = labelled.agg(F.count_if("passed"), F.count_if(~F.col("passed"))).first()
    if min(good, bad) < LEAST:
        return None
    with_features, names = _features(labelled)
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    held = F.pmod(F.xxhash64("row", "start"), F.lit(3)) == 0
    data = assemble.transform(with_features.withColumn("label", F.col("passed").cast("double"))).select("row", "kind", "start", "label", "features")
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=1, subsamplingRate=1.0).fit(data.where(~held))

    def scored(d: DataFrame) -> DataFrame:
        return model.transform(d).withColumn("p", F.round(vector_to_array("probability")[1], 3))

    # calibration: the lowest score from which held-out candidates reach the precision, per kind
    at = scored(data.where(held)).groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
    limits = {}
    for kind in KINDS:
        n = right = 0
        for r in sorted((r for r in at if r["kind"] == kind), key=lambda r: -r["p"]):
            n, right = n + r["n"], right + r["good"]
            if right >= PRECISION * n:
                limits[kind] = r["p"]
    if not limits:
        return None
    floor = reduce(lambda e, k: e.when(F.col("kind") == k, F.lit(float(limits[k]))), limits, F).otherwise(F.lit(2.0))
    loose = scored(assemble.transform(_features(c.where(~F.col("base")))[0])).where(F.col("p") >= floor).select("row", "kind", "start", "end")
    base = c.where("passed").select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    free = loose.join(base, (loose["row"] == base["row"]) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    # overlapping additions: the one that begins first, the longer of equals
    first = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return free.withColumn("reach", F.max("end").over(first)).where(F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).drop("reach")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``."""
    rows, c = candidates(docs)
    spans = c.where("passed").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    extra = added_spans(c)
    if extra is not None:
        spans = spans.unionByName(extra.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.count_if(~F.col("base")).alias("n_added"),
        F.array_sort(F.collect_list(F.struct(number.alias("n"), "start", "end", "kind", "base"))).alias("all"),
    )

    def text(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    d = rows.join(per_row, "row", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<n:bigint,start:bigint,end:bigint,kind:string,base:boolean>>")))
    zero = F.lit(0).cast("long")
    return d.select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS], F.sha2(text(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"), F.coalesce("n_added", zero).alias("n_added"),
    )
