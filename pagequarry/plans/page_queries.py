"""Queries over pages and model answers: extraction, static features, probes and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scoring as S
from ..sources.tables import PAGES_SQL, RESPONSES_SQL, responses, rich_pages

BOOLEAN = ["has_doctype", *H.FLAGS, "has_text_input", *(f"has_{t}" for t in H.SEMANTIC_TAGS)]
COUNTS = ["html_size", "ext_count", "semantic_layout_count", "h1_count", "h2_count", "addeventlistener_count", "event_handler_count", "inline_style_count", *(f"{t}_count" for t in H.SEMANTIC_TAGS)]
PROBES = ["probe_keyboard", "probe_canvas_click", "probe_form", "probe_select", "probe_range", "probe_checkbox", "probe_drag", "probe_gameplay"]


def page_features(spark, sf_dir):
    f = H.features(F.col("html"))
    joined = {"input_types": F.array_join(f["input_types"], ","), "external_resources": F.array_join(f["external_resources"], " "), "issues": F.array_join(f["issues"], "; ")}
    return rich_pages(spark, sf_dir).select("page_id", *((joined.get(k, c)).alias(k) for k, c in f.items()))


def page_probes(spark, sf_dir):
    return rich_pages(spark, sf_dir).select("page_id", *(c.alias(k) for k, c in H.probes(H.features(F.col("html"))).items()))


def _evidence():
    """Recorded evidence by page_id, standing for what a browser measured."""
    k = F.col("page_id")
    return {
        "console_errors": (k % 4).cast("int") % 2, "console_warnings": (k % 9).cast("int"), "page_err_count": F.when(k % 17 == 0, 1).otherwise(0), "rendered": k % 23 != 0,
        "fps_quality": F.element_at(F.array(*map(F.lit, ("smooth", "choppy", "frozen", "not measured"))), (k % 4 + 1).cast("int")), "structural_unbound_buttons": (k % 3).cast("int"), "structural_total_buttons": (k % 7).cast("int"),
        "structural_overlays": F.when(k % 19 == 0, 1).otherwise(0), "button_response_rate": (k % 5).cast("double") / 4, "button_responsive": k % 2 == 0, "keys_responded": (k % 6).cast("int"), "keyboard_responsive": k % 3 == 0,
        "hover_effects_detected": k % 2 == 1, "drag_responsive": k % 5 == 0, "form_submit_changed": k % 7 == 0, "gameplay_state_changed": k % 4 == 0, "has_below_fold": k % 2 == 0,
        "avg_latency_ms": F.when(k % 8 != 0, (k * 13 % 200).cast("double")), "interactions_timed_out": F.when(k % 11 == 0, 5).otherwise(0), "responsive_has_horizontal_overflow": k % 10 == 0, "responsive_mobile_broken": k % 12 == 0,
    }


def page_scores(spark, sf_dir):
    k = F.col("page_id")
    f = {n: F.col(n) for n in [*BOOLEAN, *COUNTS]}
    e = {n: F.col(n) for n in _evidence()}
    pages = rich_pages(spark, sf_dir).select("page_id", *(c.alias(n) for n, c in H.features(F.col("html")).items() if n in f), *(c.alias(n) for n, c in _evidence().items()))
    tests = {"test_pass_rate": (k * 7 % 11).cast("double") / 10, "tests_total": (k % 6).cast("int")}
    scores = S.composite(f, e, tests, F.when(k % 3 != 0, (k % 26).cast("int")), (k % 26).cast("int"), k % 4 != 0)
    return pages.select("page_id", *(c.cast("long").alias(n) for n, c in scores.items()))


def response_pages(spark, sf_dir):
    """The page of every answer, strictly and with recovery: length and digest, and the state of the answer."""
    text = F.col("response")
    out = responses(spark, sf_dir).select("item_id", H.extract(text, False).alias("strict"), H.extract(text, True).alias("page"), H.response_state(text).alias("state"))
    return out.select("item_id", "state", F.length("strict").cast("long").alias("strict_size"), F.length("page").cast("long").alias("page_size"), F.md5(F.col("page").cast("binary")).alias("page_md5"), F.coalesce(F.length("page") < 200, F.lit(True)).alias("rejected"))


def response_states(spark, sf_dir):
    return responses(spark, sf_dir).groupBy(H.response_state(F.col("response")).alias("state")).agg(F.count("*").alias("n"))


def page_injection(spark, sf_dir):
    """Pages with a helper script before the last closing body tag."""
    return rich_pages(spark, sf_dir).select("page_id", F.md5(H.inject(F.col("html"), "<script>h()</script>").cast("binary")).alias("page_md5"))


def record_uids(spark, sf_dir):
    """Ids of raw records: zero-filled line number and 12 hexadecimal digits of a digest of the first 2000 characters."""
    q = F.concat(F.lit("q"), F.col("item_id").cast("string"), F.col("response"))
    return responses(spark, sf_dir).select("item_id", F.concat(F.lpad(F.col("item_id").cast("string"), 6, "0"), F.lit("_"), F.substring(F.md5(F.substring(q, 1, 2000).cast("binary")), 1, 12)).alias("uid"))


def _any(column: str, marks) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + m.replace("'", "''") + "')" for m in marks) + ")"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(html, {_q(pattern)}))"


KEYBOARD = _any("low", H.KEYBOARD_MARKS)
DOWN, MOVE = _any("low", ("mousedown", "pointerdown")), _any("low", ("mousemove", "pointermove"))
CLICK = _any("low", ("click", "mousedown", "pointerdown", "mouseup"))
DRAG = f"(({DOWN} AND {MOVE}) OR (contains(low, 'touchstart') AND contains(low, 'touchmove')))"
TYPES = f"array_to_string(list_filter([CASE WHEN {KEYBOARD} THEN 'keyboard' END, CASE WHEN {CLICK} THEN 'mouse_click' END, CASE WHEN {DRAG} THEN 'mouse_drag' END, CASE WHEN contains(low, 'touchstart') THEN 'touch' END], lambda x: x IS NOT NULL), ',')"
FLAG_SQL = [f"regexp_matches(html, {_q(p)}) AS {n}" for n, p in H.FLAGS.items()]
TAG_SQL = [x for t in H.SEMANTIC_TAGS for x in (f"{_count(f'(?i)<{t}' + chr(92) + 'b')} AS {t}_count", f"{_count(f'(?i)<{t}' + chr(92) + 'b')} > 0 AS has_{t}")]
LISTENERS, INLINE, ASSIGNED = _count("addEventListener"), _count(f"(?i)\\bon(?:{H.EVENTS})\\s*="), _count(f"(?i)\\.\\s*on(?:{H.EVENTS})\\s*=")
RESOURCES = f"list_sort(list_distinct(regexp_extract_all(html, {_q('(?:src|href)=[' + chr(34) + chr(39) + '](https?://[^' + chr(34) + chr(39) + ']+)[' + chr(34) + chr(39) + ']')}, 1)))"
FEATURES = f"""WITH {PAGES_SQL}, base AS (SELECT page_id, html, lower(html) AS low FROM rich), f AS (SELECT page_id, low, length(html) AS html_size, starts_with(lower(regexp_replace(html, '^\\s+', '')), '<!doctype') AS has_doctype, {", ".join(FLAG_SQL)},
  regexp_matches(html, {_q(H.TYPED_INPUT)}) OR len(list_filter(regexp_extract_all(html, '(?i)<input[^>]*>'), lambda x: NOT contains(lower(x), 'type='))) > 0 AS has_text_input, {RESOURCES} AS res, {", ".join(TAG_SQL)},
  {_count("(?i)<h1" + chr(92) + "b")} AS h1_count, {_count("(?i)<h2" + chr(92) + "b")} AS h2_count, {LISTENERS} AS addeventlistener_count, {LISTENERS} + {INLINE} + {ASSIGNED} AS event_handler_count,
  {_count(chr(92) + "bstyle" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + chr(39) + "]")} AS inline_style_count, {TYPES} AS input_types FROM base),
feats AS (SELECT *, len(res) AS ext_count, array_to_string(res, ' ') AS external_resources, {" + ".join(f"CAST(has_{t} AS BIGINT)" for t in H.SEMANTIC_TAGS)} AS semantic_layout_count,
  CASE WHEN has_doctype THEN '' ELSE 'Missing DOCTYPE declaration' END || CASE WHEN html_size < 200 THEN CASE WHEN has_doctype THEN '' ELSE '; ' END || 'HTML very short (' || html_size || ' chars)' ELSE '' END AS issues FROM f)"""
COLUMNS = ", ".join(["page_id", *BOOLEAN, *COUNTS, "input_types", "external_resources", "issues"])
PROBE_SQL = {
    "probe_keyboard": "contains(input_types, 'keyboard')", "probe_canvas_click": "contains(input_types, 'mouse_click') OR has_canvas", "probe_form": "has_text_input OR has_textarea", "probe_select": "has_select", "probe_range": "has_range",
    "probe_checkbox": "has_checkbox", "probe_drag": "contains(input_types, 'mouse_drag')", "probe_gameplay": "(has_canvas AND (has_requestanimationframe OR has_threejs)) OR contains(input_types, 'keyboard')",
}
SC = lambda v, o, n: f"CAST(greatest(0, least({n}, round_even(({v})::DOUBLE / {o} * {n}, 0))) AS BIGINT)"
IT, FUNC = "(k % 4 <> 0)", "CASE WHEN k % 4 <> 0 THEN 55 ELSE 65 END"
SCORES = f"""{FEATURES}, x AS (SELECT *, page_id AS k, (page_id % 4) % 2 AS errs, page_id % 9 AS warns, (page_id % 5)::DOUBLE / 4 AS rate, (page_id * 7 % 11)::DOUBLE / 10 AS tpr, page_id % 6 AS keys, CASE WHEN page_id % 11 = 0 THEN 5 ELSE 0 END AS late, {" + ".join(f"CAST(has_{t} AS INT)" for t in H.SEMANTIC_TAGS)} AS sem FROM feats),
p AS (SELECT *, greatest(0, CASE WHEN k % 23 <> 0 THEN CASE WHEN {IT} AND NOT has_script AND NOT has_canvas AND NOT has_svg THEN 4 ELSE 10 END - errs * 3 - least(warns, 5) - CASE WHEN k % 17 = 0 THEN 5 ELSE 0 END - CASE WHEN errs + warns > 0 THEN 1 ELSE 0 END ELSE 0 END
    - CASE k % 4 WHEN 2 THEN 5 WHEN 1 THEN 4 ELSE 0 END - CASE WHEN has_lang_attr THEN 0 ELSE 1 END - CASE WHEN k % 7 > 0 AND (k % 3)::DOUBLE / nullif(k % 7, 0) > 0.3 THEN 2 ELSE 0 END - CASE WHEN k % 19 = 0 THEN 2 ELSE 0 END) AS rend,
  greatest(0, least(CASE WHEN k % 3 <> 0 THEN k % 26 ELSE 8 END, 25) - CASE WHEN k % 10 = 0 THEN 4 ELSE 0 END - CASE WHEN has_meta_viewport THEN 0 ELSE 3 END - CASE WHEN k % 12 = 0 THEN 3 ELSE 0 END - CASE WHEN NOT has_style AND NOT has_css_transitions THEN 3 ELSE 0 END) AS vis,
  greatest(0, least(20, CASE WHEN rate > 0 THEN CAST(round_even(rate * 5, 0) AS INT) WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN keys >= 5 THEN 4 WHEN keys >= 3 THEN 3 WHEN keys >= 1 THEN 1 WHEN k % 3 = 0 THEN 1 ELSE 0 END
    + CASE WHEN k % 2 = 1 THEN 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END
    + CASE WHEN k % 8 = 0 THEN 0 WHEN k * 13 % 200 < 50 THEN 2 WHEN k * 13 % 200 < 150 THEN 1 ELSE 0 END - least(4, late))) AS inter,
  greatest(0, 15 - CASE WHEN ext_count >= 8 THEN 3 WHEN ext_count >= 5 THEN 1 ELSE 0 END - CASE WHEN inline_style_count > 30 THEN 3 WHEN inline_style_count > 15 THEN 1 ELSE 0 END - CASE WHEN sem = 0 THEN 4 WHEN sem < 2 THEN 3 WHEN sem < 4 THEN 1 ELSE 0 END
    - CASE WHEN has_doctype THEN 0 ELSE 2 END - CASE WHEN has_title THEN 0 ELSE 2 END - CASE WHEN has_meta_viewport THEN 0 ELSE 2 END) AS code FROM x),
d AS (SELECT page_id, k, {SC("rend", 10, 10)} AS rendering, {SC("vis", 25, 20)} AS visual_design, CASE WHEN k % 6 > 0 THEN {SC("tpr", 1, "(" + FUNC + ")")} ELSE {SC("k % 26", 25, "(" + FUNC + ")")} END AS functionality,
  CASE WHEN NOT {IT} THEN 0 WHEN tpr >= 0.995 AND {SC("inter", 20, 10)} > 0 AND late = 0 THEN 10 ELSE {SC("inter", 20, 10)} END AS interaction, {SC("code", 15, 5)} AS code_quality FROM p)"""

ORACLES = {
    "page_features": f"{FEATURES} SELECT {COLUMNS} FROM feats",
    "page_probes": f"{FEATURES} SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in PROBE_SQL.items()) + " FROM feats",
    "page_scores": f"{SCORES} SELECT page_id, rendering, visual_design, functionality, interaction, code_quality, greatest(0, least(100, rendering + visual_design + functionality + interaction + code_quality)) AS total_score FROM d",
    "response_states": f"""WITH {RESPONSES_SQL} SELECT CASE WHEN trim(response) = '' THEN 'empty' WHEN regexp_matches(response, '(?is)<html[^>]*>.*?</html>') OR regexp_matches(response, '(?is){H.FENCE}html\\s*\\n.*?<html.*?{H.FENCE}') OR contains(response, '{H.FENCE}svg') THEN 'ok'
      WHEN contains(lower(response), '<html') OR contains(lower(response), '<!doctype') OR contains(lower(response), '{H.FENCE}html') THEN 'truncated_or_unextractable_html' ELSE 'no_extractable_html' END AS state, count(*) AS n FROM responses GROUP BY 1""",
    "page_injection": f"""WITH {PAGES_SQL} SELECT page_id, md5(CASE WHEN regexp_matches(html, '(?i)</body>') THEN regexp_replace(html, '(?is)^(.*)(</body>)', '\\1<script>h()</script>\\2') ELSE html || '<script>h()</script>' END) AS page_md5 FROM rich""",
    "record_uids": f"WITH {RESPONSES_SQL} SELECT item_id, lpad(CAST(item_id AS VARCHAR), 6, '0') || '_' || substr(md5(substr('q' || item_id || response, 1, 2000)), 1, 12) AS uid FROM responses",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "response_pages"]}
