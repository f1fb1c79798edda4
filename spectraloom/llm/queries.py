"""The registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm import bagminhash, collocations, decontam, fim, fingerprints, katz, langid, licenses, linedup, packing, pii, quality, records
from spectraloom.llm.common import new_folder
from spectraloom.llm.tokens import default_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, folder, "documents"))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.fit_quality(docs, _table(spark, folder, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "p_text", "p_meta", "score", "keep")


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), default_path())


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.drop_repeated_runs(_table(spark, folder, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def op7_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    return katz.score(_table(spark, folder, "documents"), order=2)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_successors(_table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "records")
    records.write_records(_table(spark, folder, "documents"), path, default_path())
    records.write_index(spark, path)
    return records.record_digests(spark, path)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.fit_languages(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.fill_in_middle_digests(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_personal_data, op2_quality, op3_near_duplicates, op4_packing, op5_line_dedup, op6_licenses, op7_katz_scores, op8_fingerprints, op9_decontamination, op10_token_records, op11_collocations, op12_languages, op13_fill_in_middle)
}

_LINE_DEDUP = """
WITH l AS (SELECT doc_id, md5(coalesce(text, '')) AS k, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, k, i, ls[i] AS line, len(list_filter(string_split(translate(ls[i], chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, k, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, k ORDER BY i) AS upto FROM w),
p AS (SELECT a.doc_id, a.k, a.i AS s, b.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i >= a.i AND b.upto - (a.upto - a.n) >= 50),
u AS (SELECT doc_id, k, s, min(e) AS e FROM p GROUP BY doc_id, k, s UNION SELECT doc_id, k, max(s) AS s, e FROM p GROUP BY doc_id, k, e),
x AS (SELECT u.*, row_number() OVER (PARTITION BY array_to_string(l.ls[u.s:u.e], chr(10)), u.e - u.s ORDER BY u.doc_id, u.k, u.s) AS turn FROM u JOIN l ON u.doc_id = l.doc_id AND u.k = l.k),
d AS (SELECT DISTINCT doc_id, k, unnest(range(s, e + 1)) AS i FROM x WHERE turn > 1),
m AS (SELECT w.doc_id, w.k, count(*) AS n_lines, count(d.i) AS n_deleted, coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (WHERE d.i IS NULL), '') AS kept
      FROM w LEFT JOIN d ON w.doc_id = d.doc_id AND w.k = d.k AND w.i = d.i GROUP BY w.doc_id, w.k)
SELECT m.doc_id, m.n_lines::INTEGER AS n_lines, m.n_deleted::INTEGER AS n_deleted, CASE WHEN m.n_deleted = 0 THEN l.text ELSE m.kept END AS text FROM m JOIN l ON m.doc_id = l.doc_id AND m.k = l.k
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"regexp_replace(lower({column}), {_quoted(licenses.COPYRIGHT_LINE)}, '', 'g')"
    for other, usual in licenses.SPELLINGS:
        if other != usual:
            out = f"regexp_replace({out}, {_quoted(chr(92) + 'b' + other + chr(92) + 'b')}, {_quoted(usual)}, 'g')"
    return f"trim(regexp_replace({out}, {_quoted('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+')}, ' ', 'g'))"


_LICENSES = f"""
WITH k AS (SELECT DISTINCT license, {_canonical('t')} AS c FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.KNOWN)}) v(license, t)),
u AS (SELECT doc_id, true AS whole, CASE WHEN contains(text, chr(10)) THEN 0 ELSE 1 END AS n, text AS unit FROM documents
      UNION ALL SELECT doc_id, false AS whole, 1 AS n, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE contains(text, chr(10)))
SELECT u.doc_id, k.license, bool_or(u.whole) AS whole, sum(u.n)::BIGINT AS n_lines FROM u JOIN k ON {_canonical('u.unit')} = k.c WHERE k.c <> '' GROUP BY u.doc_id, k.license
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT lang, id, unnest(w) AS one, unnest(range(len(w))) AS i FROM p),
l AS (SELECT lang, one, lead(one) OVER q AS two, lead(one, 2) OVER q AS three FROM i WINDOW q AS (PARTITION BY id ORDER BY i)),
o AS (SELECT lang, 1 AS m, one AS phrase FROM l UNION ALL SELECT lang, 2 AS m, one || ' ' || two AS phrase FROM l WHERE two IS NOT NULL
      UNION ALL SELECT lang, 3 AS m, one || ' ' || two || ' ' || three AS phrase FROM l WHERE three IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f, lang || chr(9) || phrase AS key FROM o GROUP BY lang, m, phrase),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, m, phrase, w, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= 10),
c AS (SELECT *, lang || chr(9) || array_to_string(w[1:k], ' ') AS head, lang || chr(9) || array_to_string(w[k + 1:], ' ') AS tail FROM k),
x AS (SELECT c.*, b.f AS l, e.f AS r, (1000000 * c.a * c.a) // (b.f * e.f) AS score FROM c JOIN f b ON b.key = c.head JOIN f e ON e.key = c.tail),
s AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM f WHERE m = 3 AND f >= 10 UNION ALL SELECT lang, w[2] || ' ' || w[3] AS phrase, f FROM f WHERE m = 3 AND f >= 10) GROUP BY lang, phrase),
z AS (SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank
      FROM s LEFT JOIN g ON s.m = 2 AND g.lang = s.lang AND g.phrase = s.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * s.a)
SELECT z.lang, z.rank::BIGINT AS rank, z.phrase, z.a::BIGINT AS a, z.l::BIGINT AS l, z.r::BIGINT AS r, t.n, z.score::BIGINT AS score FROM z JOIN t ON t.lang = z.lang WHERE z.rank <= 2000
"""

_FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
v AS (SELECT doc_id, text, u, len(u) AS n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM v),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

SQL: dict[str, str] = {"op5_line_dedup": _LINE_DEDUP, "op6_licenses": _LICENSES, "op11_collocations": _COLLOCATIONS, "op13_fill_in_middle": _FILL_IN_MIDDLE}
