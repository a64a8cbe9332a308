"""Queries over benchmark items: validation, audit, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.tables import table

ACTION_LIST = ("click", "", "assert_count", "assert_js_value", "screenshot", "assert_screenshot_changed", "fly", "eval_js", "assert_visible", "wait", "assert_screenshot_not_blank", "type")
SELECTORS = ("button", "", "a,,b", "body", "svg, canvas")
EXPRESSIONS = ("document.querySelector('a, ')", "f(x)", "(x", "  ", "x[href^=const", "x='it'")
PROMPTS = ("Make a  form", "Make a game", "Make a chart")


def _pick(values, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def items(spark, sf_dir):
    """Items with nested test cases from line items: an item per order, a case per line number, a step per row."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").repartition("l_orderkey")  # narrow rows travel, steps are made behind
    pos = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    quantity = F.col("l_quantity").cast("long")
    step = F.struct(pos.alias("pos"), _pick(ACTION_LIST, F.col("l_orderkey") + F.col("l_partkey")).alias("action"), _pick(SELECTORS, F.col("l_suppkey")).alias("selector"), _pick(EXPRESSIONS, F.col("l_partkey")).alias("expression"), (quantity % 4).alias("gte"), F.when(quantity % 5 == 0, quantity % 3).alias("eq"))
    cases = line.select(F.col("l_orderkey").alias("item"), "l_linenumber", step.alias("s")).groupBy("item", "l_linenumber").agg(F.sort_array(F.collect_list("s")).alias("steps"))
    name = F.when(F.col("l_linenumber") == 7, "Empty submit shows validation").when(F.col("item") % 9 == 0, F.lit(None)).when(F.col("l_linenumber") == 5, "Visible reaction ").when(F.col("l_linenumber") == 6, "Add feature button, bold button, heatmap").otherwise(F.concat(F.lit("Case  "), (F.col("l_linenumber") % 3).cast("string")))
    nested = cases.groupBy("item").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("id"), name.alias("name"), F.lit(1.0).alias("weight"), "steps"))).alias("test_cases"))
    prompt = F.when(F.col("item") % 11 != 0, _pick(PROMPTS, F.col("item"))).alias("prompt")
    return nested.select(F.when(F.col("item") % 97 != 0, F.col("item").cast("string")).alias("item_id"), prompt, "test_cases")


def item_violations(spark, sf_dir):
    return Q.all_violations(items(spark, sf_dir))


def item_violation_counts(spark, sf_dir):
    return Q.all_violations(items(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


def item_audit(spark, sf_dir):
    return Q.audit(items(spark, sf_dir))


def item_risk_table(spark, sf_dir):
    return Q.risk_table(Q.audit(items(spark, sf_dir)))


def item_risky(spark, sf_dir):
    return Q.risky_items(Q.audit(items(spark, sf_dir)))


def item_risk_examples(spark, sf_dir):
    return Q.examples(Q.audit(items(spark, sf_dir)))


def bilingual_cases(spark, sf_dir):
    """Nested items of two editions (customers with their orders as cases, an order's lines as steps), compared by position."""
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("action"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # an order's lines are few
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")

    def edition(other: bool):
        k = F.col("o_orderkey")
        actions = F.transform("steps", lambda s: F.struct(s["action"].alias("action")))
        cut = F.when(k % 7 == 0, F.slice(actions, 1, 1)).when(k % 11 == 0, F.reverse(actions)).otherwise(actions) if other else actions
        case_id = F.when(k % 13 == 0, F.lit("x")).otherwise(k.cast("string")) if other else k.cast("string")
        weight = F.when(k % 17 == 0, F.lit(2.0)).otherwise(F.lit(1.0)) if other else F.lit(1.0)
        kept = orders.where("o_orderkey % 19 <> 0") if other else orders
        cases = kept.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(k.alias("n"), case_id.alias("id"), weight.alias("weight"), cut.alias("steps")))).alias("t"))
        people = table(spark, sf_dir, "customer").join(cases, F.col("c_custkey") == F.col("o_custkey"), "left")
        bare = F.transform("t", lambda c: F.struct(c["id"].alias("id"), c["weight"].alias("weight"), c["steps"].alias("steps")))
        p = F.col("c_custkey")
        item_id = F.when(p % 23 == 0, F.lit("other")).otherwise(F.col("c_name")) if other else F.col("c_name")
        category = F.when(p % 29 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")) if other else F.col("c_mktsegment")
        return people.select(p.alias("pos"), item_id.alias("item_id"), F.when(p % 31 == 0, "en").otherwise("zh").alias("language"), category.alias("category"), bare.alias("test_cases"))

    return Q.case_alignment(edition(False), edition(True), ["category"])


def bilingual_case_counts(spark, sf_dir):
    return bilingual_cases(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("items"))


def item_unbalanced(spark, sf_dir):
    return Q.unbalanced_steps(items(spark, sf_dir))


def item_action_counts(spark, sf_dir):
    return Q.steps(items(spark, sf_dir)).where("action <> ''").groupBy("action").agg(F.count("*").alias("n"), F.countDistinct("item_id", "tc_id").alias("cases"))


def bilingual_alignment(spark, sf_dir):
    """Two editions by position: parts, and the same with some rows, ids and fields changed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("item_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("sub_type"), F.col("p_size").cast("long").alias("size"))
    k = F.col("pos")
    other = part.where(k % 50 != 0).withColumns({"item_id": F.when(k % 40 == 1, F.concat("item_id", F.lit("x"))).otherwise(F.col("item_id")), "category": F.when(k % 30 == 2, F.lit(None)).otherwise(F.col("category")), "size": F.when(k % 20 == 3, F.col("size") + 1).otherwise(F.col("size"))})
    return Q.alignment(part.where(k % 60 != 4), other, ["category", "sub_type", "size"])


def event_json_objects(spark, sf_dir):
    """The JSON object inside each event's text, and the number in it."""
    texts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("answer {bad "), "props", F.lit(" end")).alias("text"))
    return Q.json_objects(texts).select("id", F.get_json_object("object", "$.k").cast("long").alias("k"))


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


PICK = lambda values, at: f"list_extract({_sql_list(values)}, CAST({at} % {len(values)} + 1 AS INT))"
STEPS = f"""WITH s AS (SELECT CASE WHEN l_orderkey % 97 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS item_id, l_orderkey AS ik, CAST(l_linenumber AS VARCHAR) AS tc_id, (l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos, CASE WHEN l_orderkey % 11 <> 0 THEN {PICK(PROMPTS, "l_orderkey")} END AS prompt,
    CASE WHEN l_linenumber = 7 THEN 'empty submit shows validation' WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_linenumber = 5 THEN 'visible reaction' WHEN l_linenumber = 6 THEN 'add feature button, bold button, heatmap' ELSE 'case ' || (l_linenumber % 3) END AS name, {PICK(ACTION_LIST, "(l_orderkey + l_partkey)")} AS action, {PICK(SELECTORS, "l_suppkey")} AS selector, {PICK(EXPRESSIONS, "l_partkey")} AS expression,
    CAST(floor(l_quantity) AS BIGINT) % 4 AS gte, CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 5 = 0 THEN CAST(floor(l_quantity) AS BIGINT) % 3 END AS eq FROM lineitem),
m AS (SELECT *, coalesce(max(CAST(action = 'screenshot' AS INT)) OVER (PARTITION BY ik, tc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seeded, action IN ('assert_js_value', 'eval_js') AS runs FROM s)"""
RULES = f"""{STEPS}, v AS (SELECT item_id, tc_id, pos, 'missing action' AS rule FROM m WHERE action = '' UNION ALL SELECT item_id, tc_id, pos, 'unknown action' FROM m WHERE action <> '' AND action NOT IN {_in(Q.ACTIONS)}
  UNION ALL SELECT item_id, tc_id, pos, 'empty selector' FROM m WHERE action IN {_in(Q.SELECTING)} AND selector IN ('', 'a,,b') UNION ALL SELECT item_id, tc_id, pos, 'vacuous body count' FROM m WHERE action = 'assert_count' AND selector = 'body' AND (gte > 1 OR coalesce(eq, 0) > 1)
  UNION ALL SELECT item_id, tc_id, pos, 'screenshot seed missing' FROM m WHERE action = 'assert_screenshot_changed' AND NOT seeded UNION ALL SELECT item_id, tc_id, pos, 'empty expression' FROM m WHERE runs AND trim(expression) = ''
  UNION ALL SELECT item_id, tc_id, pos, 'malformed querySelector' FROM m WHERE runs AND contains(expression, 'querySelector') UNION ALL SELECT item_id, tc_id, pos, 'truncated fragment' FROM m WHERE runs AND contains(expression, '[href^=const')
  UNION ALL SELECT item_id, tc_id, pos, 'unbalanced delimiters' FROM m WHERE runs AND expression = '(x' UNION ALL SELECT DISTINCT ON (ik) item_id, NULL, NULL, 'missing id' FROM m WHERE item_id IS NULL UNION ALL SELECT DISTINCT ON (ik) item_id, NULL, NULL, 'missing prompt' FROM m WHERE prompt IS NULL
  UNION ALL SELECT DISTINCT ON (ik, tc_id) item_id, tc_id, NULL, 'missing case name' FROM m WHERE name IS NULL)"""
AUDIT = f"""{RULES}, c AS (SELECT ik, item_id, tc_id, any_value(prompt) AS prompt, any_value(coalesce(name, '')) AS name, count(*) AS n, string_agg(action || '|' || selector || '|' || expression || '|' || gte || '|' || coalesce(CAST(eq AS VARCHAR), ''), ';' ORDER BY pos) AS sig,
      bool_or(action = 'assert_screenshot_changed') AS changed, bool_or(action IN {_in(Q.SEMANTIC)}) AS semantic FROM m GROUP BY 1, 2, 3),
  d AS (SELECT *, row_number() OVER (PARTITION BY ik, sig ORDER BY tc_id) > 1 AS same_steps, name <> '' AND row_number() OVER (PARTITION BY ik, name ORDER BY tc_id) > 1 AS same_name FROM c),
  audit AS (SELECT item_id, tc_id, 'exact_duplicate_steps' AS risk FROM d WHERE same_steps UNION ALL SELECT item_id, tc_id, 'duplicate_tc_name' FROM d WHERE same_name
    UNION ALL SELECT item_id, tc_id, 'cross_template_empty_submit' FROM d WHERE tc_id = '7' AND coalesce(prompt, '') <> 'Make a  form'
    UNION ALL SELECT item_id, tc_id, r FROM d, (VALUES ('cross_template_add_button'), ('cross_template_markdown_editor'), ('cross_template_heatmap')) v(r) WHERE tc_id = '6' AND name <> ''
    UNION ALL SELECT item_id, tc_id, 'visual_change_only_tc' FROM d WHERE changed AND NOT semantic AND (n <= 5 OR name = 'visible reaction')
    UNION ALL SELECT item_id, tc_id, 'generic_screenshot_not_blank' FROM m WHERE action = 'assert_screenshot_not_blank' UNION ALL SELECT item_id, tc_id, 'broad_surface_visible' FROM m WHERE action = 'assert_visible' AND selector = 'svg, canvas'
    UNION ALL SELECT item_id, tc_id, 'screenshot_changed_without_prior_screenshot' FROM m WHERE action = 'assert_screenshot_changed' AND NOT seeded UNION ALL SELECT item_id, tc_id, 'validator_error' FROM v)"""
SEVERITY_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in Q.SEVERITY.items()) + ") s(name, severity)"
CASES = """WITH lines AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS acts FROM lineitem GROUP BY 1),
  o AS (SELECT o_custkey AS pos, o_orderkey AS k, coalesce(acts, []) AS acts FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey),
  a AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY k) AS n, CAST(k AS VARCHAR) AS id, 1.0 AS weight FROM o),
  b AS (SELECT pos, k, CASE WHEN k % 7 = 0 THEN acts[1:1] WHEN k % 11 = 0 THEN list_reverse(acts) ELSE acts END AS acts, row_number() OVER (PARTITION BY pos ORDER BY k) AS n, CASE WHEN k % 13 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS id,
    CASE WHEN k % 17 = 0 THEN 2.0 ELSE 1.0 END AS weight FROM o WHERE k % 19 <> 0),
  c AS (SELECT c_custkey AS pos, c_custkey % 23 <> 0 AS same, (SELECT count(*) FROM a WHERE a.pos = c_custkey) AS na, (SELECT count(*) FROM b WHERE b.pos = c_custkey) AS nb FROM customer),
  z AS (SELECT a.pos, a.n AS case_no, a.id AS ia, b.id AS ib, a.weight AS wa, b.weight AS wb, a.acts AS sa, b.acts AS sb FROM a JOIN b ON a.pos = b.pos AND a.n = b.n JOIN c ON c.pos = a.pos WHERE same),
  mismatches AS (SELECT pos, CAST(NULL AS BIGINT) AS "case", 'id_mismatch' AS kind, 'item_id' AS field FROM c WHERE NOT same UNION ALL SELECT pos, NULL, 'language_mismatch', 'language' FROM c WHERE same AND pos % 31 = 0
    UNION ALL SELECT pos, NULL, 'metadata_mismatch', 'category' FROM c WHERE same AND pos % 29 = 0 UNION ALL SELECT pos, NULL, 'tc_count_mismatch', 'test_cases' FROM c WHERE same AND na <> nb
    UNION ALL SELECT pos, case_no, 'tc_id_mismatch', 'id' FROM z WHERE ia <> ib UNION ALL SELECT pos, case_no, 'tc_weight_mismatch', 'weight' FROM z WHERE wa <> wb
    UNION ALL SELECT pos, case_no, 'step_count_mismatch', 'steps' FROM z WHERE len(sa) <> len(sb) UNION ALL SELECT pos, case_no, 'step_action_sequence_mismatch', 'steps' FROM z WHERE len(sa) = len(sb) AND sa <> sb)"""
ORACLES = {
    "item_violations": f"{RULES} SELECT * FROM v",
    "item_violation_counts": f"{RULES} SELECT rule, count(*) AS n, count(DISTINCT item_id) AS items FROM v GROUP BY rule",
    "item_audit": f"{AUDIT} SELECT item_id, tc_id, risk FROM audit",
    "item_risk_table": f"""{AUDIT}, n AS (SELECT risk, count(*) AS count FROM audit GROUP BY risk), g AS (SELECT n.*, severity FROM n JOIN {SEVERITY_SQL} ON n.risk = name)
      SELECT risk, severity, count, row_number() OVER (ORDER BY list_position(['error', 'high', 'medium', 'low'], severity), count DESC, risk) AS place FROM g""",
    "item_risky": f"{AUDIT} SELECT item_id, count(*) AS risk_count FROM audit WHERE risk <> 'validator_error' GROUP BY item_id ORDER BY risk_count DESC, item_id NULLS FIRST LIMIT 50",
    "item_risk_examples": f"""{AUDIT}, e AS (SELECT DISTINCT risk, item_id, tc_id FROM audit), n AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY item_id NULLS FIRST, tc_id NULLS FIRST) AS nth FROM e) SELECT * FROM n WHERE nth <= 25""",
    "bilingual_cases": f"{CASES} SELECT * FROM mismatches",
    "bilingual_case_counts": f"{CASES} SELECT kind, count(*) AS n, count(DISTINCT pos) AS items FROM mismatches GROUP BY kind",
    "item_unbalanced": f"{STEPS} SELECT item_id, tc_id, pos, expression FROM m WHERE runs AND expression = '(x'",
    "item_action_counts": f"{STEPS} SELECT action, count(*) AS n, count(DISTINCT item_id || '/' || tc_id) AS cases FROM m WHERE action <> '' GROUP BY action",
    "bilingual_alignment": """WITH a AS (SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS item_id, p_brand AS category, CAST(p_size AS BIGINT) AS size FROM part),
      b AS (SELECT pos, CASE WHEN pos % 40 = 1 THEN item_id || 'x' ELSE item_id END AS item_id, CASE WHEN pos % 30 = 2 THEN NULL ELSE category END AS category, CASE WHEN pos % 20 = 3 THEN size + 1 ELSE size END AS size FROM a WHERE pos % 50 <> 0),
      j AS (SELECT coalesce(l.pos, b.pos) AS pos, l.item_id AS ai, b.item_id AS bi, l.category AS ac, b.category AS bc, l.size AS az, b.size AS bz FROM (SELECT * FROM a WHERE pos % 60 <> 4) l FULL JOIN b ON l.pos = b.pos)
      SELECT pos, 'missing_right' AS kind, 'item_id' AS field FROM j WHERE bi IS NULL UNION ALL SELECT pos, 'missing_left', 'item_id' FROM j WHERE ai IS NULL UNION ALL SELECT pos, 'id_mismatch', 'item_id' FROM j WHERE ai <> bi
      UNION ALL SELECT pos, 'metadata_mismatch', 'category' FROM j WHERE ai = bi AND ac IS DISTINCT FROM bc UNION ALL SELECT pos, 'metadata_mismatch', 'size' FROM j WHERE ai = bi AND az IS DISTINCT FROM bz""",
    "event_json_objects": "SELECT event_id AS id, CAST(regexp_extract(props, '\"k\": *([0-9-]+)', 1) AS BIGINT) AS k FROM events",
}
QUERIES = {name: globals()[name] for name in ORACLES}
