"""The registered queries of the training-data operators, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, interpolation, jaccard_groups, language, licenses, media, mixing, quality, ranked_search, simhash, spelling, token_counts, token_files
from .common import read

BYTE_BPE = "byte_bpe_50k.json"


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score_documents(read(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs.withColumn("path", licenses.tree_path(F.col("doc_id"))))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.similar_sets(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scores, op2_media_columns, op3_language, op4_token_counts, op5_licenses, op6_simhash, op7_token_files, op8_source_mix, op9_quality, op10_decontaminate,
              op11_jaccard_groups, op12_ranked_search, op13_spelling)
}
WORDS_SQL = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP8_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE) / ((SELECT count(*) FROM sizes)::DOUBLE * n) AS rate FROM sizes),
split AS (SELECT source, greatest(1, ceil(rate / 16.0))::INT AS pieces, rate / greatest(1, ceil(rate / 16.0)) AS r FROM rates),
cdf(source, r, k, t, c) AS (
    SELECT source, r, 0, exp(-r), exp(-r) FROM split
    UNION ALL SELECT source, r, k + 1, t * r / (k + 1), c + t * r / (k + 1) FROM cdf WHERE k < 79
),
draws AS (
    SELECT doc_id, d.source, j, ('0x' || substr(md5('copies:2024:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM documents d JOIN split s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(range(1, s.pieces + 1)) AS j)
),
drawn AS (SELECT doc_id, count(*) AS copies FROM draws w JOIN cdf ON w.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= w.u GROUP BY doc_id),
repeated AS (SELECT doc_id, unnest(range(1, copies + 1))::INT AS copy_no FROM drawn)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy_no, substr(md5('order:2024:' || d.doc_id || ':' || copy_no), 1, 16) AS mix_key
FROM repeated JOIN documents d USING (doc_id)
"""

OP10_SQL = f"""
WITH words AS (
    SELECT 'd' AS side, doc_id AS id, {WORDS_SQL.format(text="text")} AS w FROM documents
    UNION ALL SELECT 'b', item_id, {WORDS_SQL.format(text="text")} FROM benchmark
),
sizes_of AS (SELECT DISTINCT least(5, len(w)) AS k FROM words WHERE side = 'b' AND len(w) > 0),
shingles AS (
    SELECT DISTINCT side, id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
    FROM (SELECT side, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words JOIN sizes_of ON k <= len(w) AND (side = 'd' OR k = least(5, len(w))))
),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item, count(*)::DOUBLE / any_value(n) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.k = b.k AND d.side = 'd' AND b.side = 'b' JOIN sizes ON sizes.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)
"""

SIZE_SQL = "(SELECT count(*) FROM documents)"
FOLDER_SQL = "(doc_id // 1000) || '/' || (doc_id // 100) || CASE WHEN doc_id % 10 = 0 THEN '' ELSE '/' || (doc_id // 10) END"


def _terms_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{licenses.TERM}'), lambda t: t <> '')"


TEMPLATE_SQL = ", ".join(
    f"({i}, '{name}', {shared}, '" + text.replace("'", "''") + "')" for i, (name, shared, text) in enumerate(licenses.templates())
)
#: Every unit of every text against every template; no leading terms.
OP5_SQL = f"""
WITH lines AS (SELECT doc_id, text, doc_id % 2 = 0 AS whole, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
heads AS (SELECT *, list_position(list_transform(lines, lambda x: NOT regexp_matches(x, '{licenses.COMMENT}')), true) AS code FROM lines),
units AS (
    SELECT doc_id, unit, row_number() OVER () AS uid FROM (
        SELECT doc_id, unnest(list_distinct(list_concat(lines, regexp_split_to_array(text, '{licenses.SENTENCE}'), regexp_split_to_array(text, '{licenses.PARAGRAPH}'),
          [CASE WHEN whole THEN text ELSE '' END, array_to_string(CASE WHEN coalesce(code, 0) = 0 THEN lines ELSE lines[1:code - 1] END, chr(10))]))) AS unit
        FROM heads) WHERE unit <> ''
),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_terms_sql("text")}) AS term FROM documents) GROUP BY term),
templates AS (SELECT * FROM (VALUES {TEMPLATE_SQL}) v(template, license, shared, words)),
tf AS (SELECT uid, term, count(*) AS n FROM (SELECT uid, unnest({_terms_sql("unit")}) AS term FROM units) GROUP BY 1, 2),
ttf AS (SELECT template, term, count(*) AS n FROM (SELECT template, unnest({_terms_sql("words")}) AS term FROM templates) GROUP BY 1, 2),
weighed AS (SELECT uid, tf.term, (1 + ln(n)) * (ln(least({licenses.RARE}.0::DOUBLE, (1.0::DOUBLE + {SIZE_SQL}) / (1 + coalesce(df, 0)))) + 1) AS w FROM tf LEFT JOIN df ON tf.term = df.term),
tweighed AS (SELECT template, ttf.term, (1 + ln(n)) * (ln(least({licenses.RARE}.0::DOUBLE, (1.0::DOUBLE + {SIZE_SQL}) / (1 + coalesce(df, 0)))) + 1) AS w FROM ttf LEFT JOIN df ON ttf.term = df.term),
lengths AS (SELECT uid, sqrt(sum(w * w)) AS length FROM weighed GROUP BY uid),
tlengths AS (SELECT template, sqrt(sum(w * w)) AS length FROM tweighed GROUP BY template),
dots AS (SELECT uid, template, sum(a.w * b.w) AS dot FROM weighed a JOIN tweighed b ON a.term = b.term GROUP BY 1, 2),
cosines AS (
    SELECT doc_id, license, shared, round(dot / (l.length * t.length), 9) AS cosine
    FROM dots JOIN lengths l ON dots.uid = l.uid JOIN tlengths t ON dots.template = t.template JOIN units ON units.uid = dots.uid JOIN templates ON templates.template = dots.template
),
tags AS (SELECT doc_id, regexp_extract(text, '{licenses.SPDX}', 1) AS license FROM documents),
told AS (
    SELECT doc_id, license, 1.0::DOUBLE AS cosine, 0 AS untagged, 0 AS shared FROM tags WHERE license <> ''
    UNION ALL SELECT doc_id, license, cosine, 1, shared FROM cosines WHERE cosine >= {licenses.SIMILARITY}
),
best AS (SELECT doc_id, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY untagged, shared, cosine DESC, license) AS nth FROM told) WHERE nth = 1),
files AS (SELECT doc_id, {FOLDER_SQL} AS folder, {FOLDER_SQL} || '/' || CASE WHEN doc_id % 2 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path FROM documents),
folders AS (SELECT folder, arg_min(license, path) AS folder_license FROM files JOIN best ON files.doc_id = best.doc_id WHERE files.doc_id % 2 = 0 GROUP BY folder),
up AS (SELECT doc_id, 2 AS depth, (doc_id // 1000) || '/' || (doc_id // 100) AS folder FROM documents UNION ALL SELECT doc_id, 3, (doc_id // 1000) || '/' || (doc_id // 100) || '/' || (doc_id // 10) FROM documents WHERE doc_id % 10 <> 0),
near AS (SELECT doc_id, arg_max(folder, depth) AS from_folder, arg_max(folder_license, depth) AS inherited FROM up JOIN folders USING (folder) GROUP BY doc_id)
SELECT files.doc_id, path, best.license AS own_license, cosine, coalesce(best.license, inherited) AS license, CASE WHEN best.license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN best.license IS NULL THEN from_folder END AS from_folder
FROM files LEFT JOIN best ON files.doc_id = best.doc_id LEFT JOIN near ON files.doc_id = near.doc_id
"""

OP11_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
reach(id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, least FROM reach JOIN links ON links.a = reach.id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(least) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

TERMS_SQL = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"

OP12_SQL = f"""
WITH found AS (SELECT doc_id, unnest({TERMS_SQL.format(text="text")}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM found GROUP BY doc_id),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM found GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, docs),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({TERMS_SQL.format(text="text")}) AS term FROM benchmark) GROUP BY 1, 2),
scores AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), size GROUP BY 1, 2
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op11_jaccard_groups": OP11_SQL, "op12_ranked_search": OP12_SQL, "op5_licenses": OP5_SQL, "op8_source_mix": OP8_SQL, "op10_decontaminate": OP10_SQL}
