"""Queries over what models answered: JSON candidates, patches in every shape, repaired pages, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.html import FENCE
from ..operators import answers as A
from ..sources.tables import spread, table

#: What stands around patches, one shape per page.
SHAPES = 9


def _answers(spark, sf_dir):
    """Answers to pages: patches as an object in a fence, a bare list in a fence, an object in prose, the whole answer, behind thoughts, none, broken, behind an empty fence; a whole page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    number = F.concat(F.lit("n"), F.length("html").cast("string"))
    one = F.concat(F.lit('{"old_str": "</title>", "new_str": "'), number, F.lit('</title>"}'))
    two = F.concat(one, F.lit(', {"old_str": "no such text", "new_str": ""}'))
    kind = F.col("page_id") % SHAPES
    text = (
        F.when(kind == 0, F.concat(F.lit(f"Here:\n{FENCE}json\n{{\"patches\": ["), two, F.lit(f"]}}\n{FENCE}\nDone.")))
        .when(kind == 1, F.concat(F.lit(f"{FENCE}\n["), one, F.lit(f"]\n{FENCE}")))
        .when(kind == 2, F.lit('I changed {nothing}: {"patches": []} as it is fine.'))
        .when(kind == 3, F.concat(F.lit(' {"note": 1, "patches": ['), one, F.lit("]} ")))
        .when(kind == 4, F.concat(F.lit('<think>{"patches": []}</think>['), two, F.lit("]")))
        .when(kind == 5, F.lit("I can't help."))
        .when(kind == 6, F.concat(F.lit(f"{FENCE}json\n{{\"patches\": [{{\"old_str\": \"<p>\"}}]}}\n{FENCE}\n"), F.regexp_replace("html", "<p>", "<q>")))
        .when(kind == 7, F.concat(F.lit(f"{FENCE}json\n[]\n{FENCE}\n{FENCE}json\n["), one, F.lit(f"]\n{FENCE}")))
        .otherwise(F.concat(F.lit(f"{FENCE}html\n"), F.col("html"), F.lit(f"\n{FENCE}")))
    )
    return pages.select(F.col("page_id").alias("id"), "html", text.alias("answer"))


def answer_patches(spark, sf_dir):
    """How many patches each answer has (null: none), and the first one's new text."""
    rows = _answers(spark, sf_dir).select("id", A.patches_of(F.col("answer")).alias("p"))
    return rows.select("id", F.when(F.col("p").isNotNull(), F.size("p")).cast("long").alias("patches"), F.get("p", 0)["new"].alias("first"))


def answer_repairs(spark, sf_dir):
    rows = A.repaired(_answers(spark, sf_dir))
    return rows.select("id", "how", "applied", "total", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("html_md5"))


def _said(spark, sf_dir):
    """Turns with objects between their words: in a fence, bare, with braces inside a string, never closed."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    value = F.concat(F.lit('{"n": '), F.length("text").cast("string"), F.lit(', "t": "a } \\" {", "in": {"x": [1]}}'))
    text = (
        F.when(kind == 0, F.concat(F.lit(f"ok\n{FENCE}JSON\n"), value, F.lit(f"\n{FENCE} {{\"n\": 0}}"))).when(kind == 1, F.concat(F.lit("so "), value, F.lit(' or {"n": 1}')))
        .when(kind == 2, F.concat(F.lit(f"{FENCE}\n"), value, F.lit(f"\n{FENCE}"))).when(kind == 3, F.concat(F.lit("{{{ "), value)).otherwise(F.lit("  nothing "))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"), text.alias("answer"))


def answer_candidates(spark, sf_dir):
    """All candidates of JSON in a turn, and the number in the first that is an object."""
    rows = _said(spark, sf_dir).withColumn("c", A.json_candidates(F.col("answer"), every=True))
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("candidates"), F.md5(F.array_join("c", "|").cast("binary")).alias("texts_md5"), F.try_variant_get(A.first_object(F.col("c")), "$.n", "long").alias("n"))


def _scores(spark, sf_dir):
    k = F.col("o_orderkey")
    points = F.floor("o_totalprice") % 101
    whole = F.to_json(F.struct((points + 0.75).alias("total"), (k % 10).alias("rendering"), F.lit("good").alias("rendering_reason"), F.array(F.col("o_orderpriority")).alias("bugs"), F.lit("none").alias("highlights"), F.lit("so so").alias("summary")))
    text = F.when(k % 4 == 0, whole).when(k % 4 == 1, points.cast("string")).when(k % 4 == 2, F.concat(points.cast("string"), F.lit(".9"))).otherwise("null")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(text).alias("score"))


def score_shapes(spark, sf_dir):
    """Totals of scores that are numbers, objects or nothing."""
    return _scores(spark, sf_dir).select("o_orderkey", A.total_score(F.col("score")).alias("total"))


def repair_starts(spark, sf_dir):
    """Starting scores of repairs, of results with a whole score."""
    rows = _scores(spark, sf_dir).select("o_orderkey", A.final_score(F.col("score")).alias("f")).where("f is not null")
    return rows.select(
        "o_orderkey", F.col("f.rendering.score").alias("rendering"), F.col("f.rendering.reason").alias("reason"), F.col("f.interaction.score").alias("interaction"), F.col("f.total_score").alias("total_score"),
        F.array_join("f.bugs", ",").alias("bugs"), F.size("f.highlights").cast("long").alias("highlights"), F.size("f.missing_features").cast("long").alias("missing"), F.col("f.summary").alias("summary"),
    )


OWN = "'n' || length(html)"
ONCE = "(length(html) - length(replace(html, '</title>', ''))) / 8 = 1"
VALID = "length(html) >= 200"
N = "length(text)"
OBJECT = f"""'{{"n": ' || {N} || ', "t": "a }} \\" {{", "in": {{"x": [1]}}}}'"""
ORACLES = {
    "answer_patches": f"SELECT page_id AS id, CAST(CASE WHEN page_id % {SHAPES} IN (0, 4) THEN 2 WHEN page_id % {SHAPES} IN (1, 3, 7) THEN 1 WHEN page_id % {SHAPES} = 2 THEN 0 END AS BIGINT) AS patches, CASE WHEN page_id % {SHAPES} IN (0, 1, 3, 4, 7) THEN {OWN} || '</title>' END AS first FROM pages",
    "answer_repairs": f"""WITH p AS (SELECT *, page_id % {SHAPES} AS kind, {ONCE} AS once, trim(html, ' ' || chr(9) || chr(10) || chr(13)) AS bare, regexp_extract(regexp_replace(html, '<p>', '<q>', 'g'), '(?is)(<!DOCTYPE.*?</html>|<html.*?</html>)', 1) AS page FROM pages),
      d AS (SELECT page_id AS id, html, page, bare, kind, CASE WHEN kind = 2 THEN 'unchanged' WHEN kind IN (0, 1, 3, 4, 7) AND once AND {VALID} THEN 'patched' WHEN kind = 6 AND length(page) >= 200 THEN 'rewritten'
        WHEN kind = 8 AND length(bare) >= 200 AND regexp_matches(lower(substr(bare, 1, 200)), '<!doctype|<html') AND (regexp_matches(lower(bare), '</html>|</body>') OR (length(bare) >= 500 AND regexp_matches(lower(bare), '^(<!doctype|<html)'))) THEN 'rewritten' END AS how,
        CAST(CASE WHEN kind IN (0, 1, 3, 4, 7) AND once THEN 1 ELSE 0 END AS BIGINT) AS applied, CAST(CASE WHEN kind IN (0, 4) THEN 2 WHEN kind IN (1, 3, 7) THEN 1 ELSE 0 END AS BIGINT) AS total FROM p)
      SELECT id, how, applied, total, md5(CASE how WHEN 'unchanged' THEN html WHEN 'patched' THEN replace(html, '</title>', {OWN} || '</title>') WHEN 'rewritten' THEN CASE kind WHEN 6 THEN page ELSE bare END ELSE '' END) AS html_md5 FROM d""",
    "answer_candidates": f"""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS kind, {OBJECT} AS o, {N} AS n FROM conversations),
      l AS (SELECT conv_id, turn, kind, n, CASE kind WHEN 0 THEN [o, '{{"n": 0}}', 'ok' || chr(10) || '{FENCE}JSON' || chr(10) || o || chr(10) || '{FENCE} {{"n": 0}}'] WHEN 1 THEN [o, '{{"n": 1}}', 'so ' || o || ' or {{"n": 1}}']
        WHEN 2 THEN [o, '{FENCE}' || chr(10) || o || chr(10) || '{FENCE}'] WHEN 3 THEN [o, '{{{{{{ ' || o] ELSE ['nothing'] END AS texts FROM c)
      SELECT conv_id, turn, CAST(len(texts) AS BIGINT) AS candidates, md5(array_to_string(texts, '|')) AS texts_md5, CAST(CASE WHEN kind <= 3 THEN n END AS BIGINT) AS n FROM l""",
    "score_shapes": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS total FROM orders",
    "repair_starts": """SELECT o_orderkey, CAST(o_orderkey % 10 AS DOUBLE) AS rendering, 'good' AS reason, 0.0::DOUBLE AS interaction, CAST(floor(o_totalprice) AS BIGINT) % 101 + 0.75::DOUBLE AS total_score, o_orderpriority AS bugs,
      CAST(0 AS BIGINT) AS highlights, CAST(0 AS BIGINT) AS missing, 'so so' AS summary FROM orders WHERE o_orderkey % 4 = 0""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
