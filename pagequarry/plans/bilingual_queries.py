"""Queries over two editions of a benchmark: synchronising steps' texts and scripts, strict comparison of open objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.glossary import TERMS, YIELDS
from ..operators import bilingual as B
from ..sources.staging import cut
from ..sources.tables import table

PHRASES = (
    "Add to cart", "next|prev", "Save or cancel", "turn off lights", "Turn left", "Restart_game", "Score: 10", "no such thing", "date 日期", "open-settings menu", "Monday", "May total", "hello", "real   estate return",
    "value is undefined", "all lights off", "comments (?:share|copy)", "返回 back",
)
ACTIONS = ("assert_text_contains", "click_text", "assert_js_value", "wait", "eval_js", "assert_text_not_contains", "assert_js_value", "eval_js")
LEFT, RIGHT = ("/", "const t = document.body.textContent; text.includes('", "patterns = ['", "el.innerHTML + el.innerText == '", "f('"), ("/i.test(document.body.innerText)", "')", "']; el.innerText", "'", "')")
RISK = "text.includes('save') || text.includes('cancel') || text.includes('open') || body.includes('close') && document.body.innerText"
FILES = ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE", "NOWHERE")


def _at(values, place):
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def _steps(spark, sf_dir):
    """Steps of an order: an action, a phrase as text or pattern, or a script that holds it."""
    k = F.col("l_partkey") + F.col("l_linenumber")
    action, phrase = _at(ACTIONS, F.col("l_orderkey") + F.col("l_linenumber")), _at(PHRASES, F.col("l_partkey"))
    script = F.when(k % 29 == 0, RISK).otherwise(F.concat(_at(LEFT, k), phrase, _at(RIGHT, k)))
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", action.alias("action"), F.when(k % 2 == 0, phrase).alias("text"), F.when(k % 2 == 1, phrase).alias("text_pattern"), F.when(~F.col("action_free"), script).alias("expression"))
    rows = table(spark, sf_dir, "lineitem").withColumn("action_free", action.isin("wait", "click_text"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(step)).alias("steps"))  # an order's lines are few


def _main(spark, sf_dir):
    """Items from customers, with orders as cases and lines as steps."""
    orders = table(spark, sf_dir, "orders").join(_steps(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    case = F.struct(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("id"), "steps")
    cases = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(case)).alias("t"))
    bare = F.transform("t", lambda c: F.struct(c["id"].alias("id"), F.transform(c["steps"], lambda s: s.dropFields("l_linenumber", "l_partkey", "l_suppkey")).alias("steps")))
    people = table(spark, sf_dir, "customer").join(cases, F.col("c_custkey") == F.col("o_custkey"), "left")
    return people.select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("item_id"), F.lit("en").alias("language"), F.col("c_name").alias("prompt"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("category"), bare.alias("test_cases"))


def _synced(spark, sf_dir):
    main = cut(_main(spark, sf_dir), "main-edition")  # read by both editions
    k = F.col("pos")
    other = main.withColumns({"language": F.lit("zh"), "prompt": F.when(k % 17 != 0, F.concat(F.lit("客户 "), "prompt")), "category": F.when(k % 5 == 0, "old").otherwise(F.col("category"))})
    return B.synced(main, other)


def glossary_alternatives(spark, sf_dir):
    """Counterparts of terms in parts' names and phrases."""
    text = F.concat_ws(" ", "p_name", _at(PHRASES, F.col("p_partkey")))
    rows = table(spark, sf_dir, "part").select("p_partkey", B.alternatives(text).alias("a"))
    return rows.select("p_partkey", F.array_join("a", ",").alias("alternatives"))


def edition_steps(spark, sf_dir):
    """Every step of the new edition."""
    rows, _, _ = _synced(spark, sf_dir)
    cases = rows.select("pos", "prompt", "category", "language", "changed", F.posexplode("test_cases").alias("case", "tc"))
    steps = cases.select("pos", F.md5(F.coalesce("prompt", F.lit("")).cast("binary")).alias("prompt_md5"), "category", "language", "changed", F.col("tc.id").alias("tc_id"), F.posexplode("tc.steps").alias("step", "s"))
    return steps.select("pos", "prompt_md5", "category", "language", "changed", "tc_id", "step", "s.action", "s.text", "s.text_pattern", "s.expression")


def edition_step_counters(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


def edition_risks(spark, sf_dir):
    return _synced(spark, sf_dir)[2].select("pos", "label")


def _objects(spark, sf_dir, other: bool):
    """Items as JSON objects without a common schema; the other edition differs here and there."""
    k, o, p = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_partkey")
    keyed = F.col("l_suppkey") if not other else F.when(p % 43 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))
    pattern = F.concat(F.lit("p"), (p % 9).cast("string"))
    pattern = F.when(p % 3 == 0, F.concat(pattern, F.lit("|x"))).otherwise(pattern) if other else pattern
    action = _at(("click_text", "wait", "assert_text_contains"), p)
    optional = F.when(p % 47 == 0, F.lit(None)).otherwise(F.lit(True)) if other else F.lit(True)
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(action.alias("action"), keyed.alias("selector"), pattern.alias("text_pattern"), optional.alias("optional"), p.alias("_source")).alias("s"))
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["s"]).alias("steps"))
    orders = table(spark, sf_dir, "orders").join(steps, o == F.col("l_orderkey"), "left")
    orders = orders.where(o % 61 != 0) if other else orders
    name = F.when(o % 41 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")) if other else F.col("o_orderpriority")
    case = F.struct(o.alias("n"), F.struct(o.alias("id"), name.alias("name"), F.col("steps")).alias("c"))
    cases = orders.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(case)), lambda x: x["c"]).alias("test_cases"))
    people = table(spark, sf_dir, "customer").where("c_mktsegment <> 'FURNITURE'" if other else "true").where(k % 53 != 0 if other else F.lit(True))
    title = F.when(k % 37 == 0, "other").otherwise(F.col("c_name")) if other else F.col("c_name")
    item = F.to_json(F.struct(k.alias("id"), F.lit("zh" if other else "en").alias("language"), F.col("c_nationkey").alias("category"), title.alias("title"), (k * (2 if other else 1)).alias("_row"), F.col("test_cases")))
    return people.join(cases, k == F.col("o_custkey"), "left").select(F.col("c_mktsegment").alias("file"), k.alias("pos"), F.parse_json(item).alias("item"))


def _strict(spark, sf_dir):
    return B.strict_alignment(_objects(spark, sf_dir, False), _objects(spark, sf_dir, True), FILES)


def edition_strict(spark, sf_dir):
    """Everything in which two editions differ but for what the language may change."""
    return _strict(spark, sf_dir).where(~F.col("kind").startswith("allowed_"))


def edition_strict_counts(spark, sf_dir):
    return B.alignment_summary(_strict(spark, sf_dir))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _list(values):
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _pick(values, place):
    return f"list_extract({_list(values)}, CAST(({place}) % {len(values)} + 1 AS INT))"


TERMS_SQL = ", ".join(f"({i}, {_quoted(t)}, {_list(a)})" for i, (t, a) in enumerate(TERMS.items()))
K = "(l_partkey + l_linenumber)"
#: Each phrase against each term by a regular expression of its own.
GLOSSED = rf"""terms AS (SELECT * FROM (VALUES {TERMS_SQL}) v(rank, term, alts)), phrases AS (SELECT unnest({_list(dict.fromkeys([*PHRASES, "save", "cancel", "open", "close"]))}) AS phrase),
  probes AS (SELECT phrase, regexp_replace(lower(phrase), '\\[bBdDsSwW]|\(\?:|\(\?i\)|[\[\]{{}}^$+*?.()]', ' ', 'g') AS probe FROM phrases),
  hits AS (SELECT phrase, rank, term, alts FROM probes JOIN terms ON regexp_matches(probe, '(^|[^a-z0-9])' || replace(term, ' ', '[\s_\-]*') || '($|[^a-z0-9])')),
  kept AS (SELECT * FROM hits h WHERE NOT (term = '{next(iter(YIELDS))}' AND EXISTS (SELECT 1 FROM hits g WHERE g.phrase = h.phrase AND g.term = '{next(iter(YIELDS.values()))}'))),
  alts AS (SELECT phrase, alt, min(rank * 100 + i) AS place FROM (SELECT phrase, rank, unnest(alts) AS alt, unnest(range(len(alts))) AS i FROM kept) WHERE NOT contains(phrase, alt) GROUP BY phrase, alt),
  glossed AS (SELECT p.phrase, coalesce(list(alt ORDER BY place) FILTER (alt IS NOT NULL), []) AS added FROM phrases p LEFT JOIN alts USING (phrase) GROUP BY p.phrase)"""
RISK_ADDED = "||".join(f"(SELECT '(' || '{v}.includes(''{w}'')||' || array_to_string(list_transform(added, lambda a: '{v}.includes(\"' || a || '\")'), '||') || ')' FROM glossed WHERE phrase = '{w}') || '{sep}'" for v, w, sep in (("text", "save", " || "), ("text", "cancel", " || "), ("text", "open", " || "), ("body", "close", " && document.body.innerText")))
STEPS = rf"""{GLOSSED}, raw AS (SELECT *, {_pick(ACTIONS, "l_orderkey + l_linenumber")} AS action, {_pick(PHRASES, "l_partkey")} AS phrase, {K} AS k FROM lineitem),
  scripted AS (SELECT *, action IN ('assert_js_value', 'eval_js') AS runs, CASE WHEN action IN ('wait', 'click_text') THEN NULL WHEN k % 29 = 0 THEN {_quoted(RISK)} ELSE {_pick(LEFT, "k")} || phrase || {_pick(RIGHT, "k")} END AS script FROM raw),
  edited AS (SELECT s.*, len(added) AS n_added, NOT runs AND action <> 'wait' AND len(added) > 0 AS texts, runs AND k % 29 = 0 AS risky, runs AND k % 29 <> 0 AND k % 5 = 3 AS skipped,
    CASE WHEN NOT runs OR k % 29 = 0 OR len(added) = 0 THEN 0 WHEN k % 5 = 0 THEN CAST(phrase <> 'value is undefined' AS INT) WHEN k % 5 = 1 THEN 2 WHEN k % 5 = 2 THEN 3 ELSE 0 END AS how, added
    FROM scripted s JOIN glossed USING (phrase)),
  steps AS (SELECT *, CASE WHEN texts THEN phrase || '|' || array_to_string(list_transform(added, lambda a: regexp_replace(a, '([ -])', '\\\1', 'g')), '|') WHEN k % 2 = 1 THEN phrase END AS text_pattern,
    CASE WHEN risky THEN {RISK_ADDED} WHEN how = 1 THEN '/' || phrase || '|' || array_to_string(added, '|') || '{RIGHT[0]}'
      WHEN how = 2 THEN {_quoted(LEFT[1][: -len("text.includes('")])} || '(text.includes(''' || phrase || ''')||' || array_to_string(list_transform(added, lambda a: 'text.includes("' || a || '")'), '||') || ')'
      WHEN how = 3 THEN {_quoted(LEFT[2])} || phrase || ''',' || array_to_string(list_transform(added, lambda a: '"' || a || '"'), ',') || ']; el.innerText' ELSE script END AS expression,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS step FROM edited),
  patched AS (SELECT o_custkey AS pos, bool_or(texts OR risky OR how > 0) AS patched FROM steps JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  items AS (SELECT c_custkey AS pos, c_mktsegment AS file, c_name, 'n' || c_nationkey AS category, c_custkey % 5 = 0 AS moved, coalesce(patched, false) OR c_custkey % 5 = 0 OR c_custkey % 17 = 0
    OR c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS changed FROM customer LEFT JOIN patched ON pos = c_custkey)"""
STRICT = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS step FROM lineitem),
  o AS (SELECT o_custkey AS pos, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS na, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders),
  b AS (SELECT pos, k, n, row_number() OVER (PARTITION BY pos ORDER BY k) AS nb FROM o WHERE k % 61 <> 0),
  c AS (SELECT c_custkey AS pos, c_mktsegment AS file FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 53 <> 0 AND c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD')),
  z AS (SELECT file, c.pos, na AS "case", o.k AS x, b.k AS y, o.n AS nx, b.n AS ny FROM c JOIN o ON o.pos = c.pos JOIN b ON b.pos = c.pos AND nb = na),
  name AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders),
  s AS (SELECT file, pos, "case", u.step, u.l_partkey AS p, v.l_partkey AS q, u.l_suppkey AS sp, CASE WHEN v.l_partkey % 43 = 0 THEN v.l_suppkey + 1 ELSE v.l_suppkey END AS sq,
    list_extract(['click_text', 'wait', 'assert_text_contains'], CAST(u.l_partkey % 3 + 1 AS INT)) AS ap, list_extract(['click_text', 'wait', 'assert_text_contains'], CAST(v.l_partkey % 3 + 1 AS INT)) AS aq
    FROM z JOIN p u ON u.l_orderkey = x JOIN p v ON v.l_orderkey = y AND v.step = u.step WHERE nx = ny),
  t AS (SELECT *, 'p' || p % 9 AS tp, 'p' || q % 9 || CASE WHEN q % 3 = 0 THEN '|x' ELSE '' END AS tq FROM s),
  found AS (SELECT file, pos, NULL::BIGINT AS "case", NULL::BIGINT AS step, 'top_level_field_mismatch' AS kind, 'title' AS field FROM c WHERE pos % 37 = 0
    UNION ALL SELECT file, pos, NULL, NULL, 'tc_count_mismatch', 'test_cases' FROM c WHERE pos IN (SELECT pos FROM o WHERE k % 61 = 0)
    UNION ALL SELECT file, pos, "case", NULL, 'tc_id_mismatch', 'id' FROM z WHERE x <> y UNION ALL SELECT file, pos, "case", NULL, 'tc_field_mismatch', 'id' FROM z WHERE x <> y
    UNION ALL SELECT file, pos, "case", NULL, 'tc_field_mismatch', 'name' FROM z JOIN name f ON f.k = x JOIN name g ON g.k = y WHERE f.v IS DISTINCT FROM CASE WHEN y % 41 = 0 THEN NULL ELSE g.v END
    UNION ALL SELECT file, pos, "case", NULL, 'step_count_mismatch', 'steps' FROM z WHERE nx <> ny
    UNION ALL SELECT file, pos, "case", NULL, 'step_action_sequence_mismatch', 'steps' FROM t GROUP BY file, pos, "case" HAVING bool_or(ap <> aq)
    UNION ALL SELECT file, pos, "case", step, 'step_field_mismatch', 'action' FROM t WHERE ap <> aq UNION ALL SELECT file, pos, "case", step, 'step_field_mismatch', 'selector' FROM t WHERE sp <> sq
    UNION ALL SELECT file, pos, "case", step, 'step_field_mismatch', 'optional' FROM t WHERE q % 47 = 0
    UNION ALL SELECT file, pos, "case", step, CASE WHEN ap = 'wait' THEN 'step_field_mismatch' ELSE 'allowed_' || ap || '_text_pattern_diff' END, 'text_pattern' FROM t WHERE tp <> tq
    UNION ALL SELECT f, NULL, NULL, NULL, CASE WHEN f = 'NOWHERE' OR f NOT IN (SELECT c_mktsegment FROM customer) THEN 'missing_en_file' WHEN f = 'FURNITURE' THEN 'missing_zh_file' ELSE 'line_count_mismatch' END, 'file'
      FROM (SELECT unnest(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE', 'NOWHERE']) AS f) WHERE f IN ('FURNITURE', 'NOWHERE') OR f IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 53 = 0) OR f NOT IN (SELECT c_mktsegment FROM customer))"""
NAMED = GLOSSED.replace(f"SELECT unnest({_list(dict.fromkeys([*PHRASES, 'save', 'cancel', 'open', 'close']))}) AS phrase", "SELECT DISTINCT p_name || ' ' || " + _pick(PHRASES, "p_partkey") + " AS phrase FROM part")
ORACLES = {
    "glossary_alternatives": f"WITH {NAMED} SELECT p_partkey, array_to_string(added, ',') AS alternatives FROM part JOIN glossed ON phrase = p_name || ' ' || {_pick(PHRASES, 'p_partkey')}",
    "edition_steps": rf"""WITH {STEPS} SELECT pos, md5(CASE WHEN pos % 17 <> 0 THEN '客户 ' || c_name ELSE '' END) AS prompt_md5, category, 'zh' AS language, changed, CAST(o_orderkey AS VARCHAR) AS tc_id, CAST(step AS INT) AS step, action,
      CASE WHEN k % 2 = 0 THEN phrase END AS text, text_pattern, expression FROM items JOIN orders ON o_custkey = pos JOIN steps ON l_orderkey = o_orderkey""",
    "edition_step_counters": f"""WITH {STEPS}, n AS (
      SELECT 'text_assertion_steps_patched' AS name, count(*) AS n FROM steps WHERE texts AND action <> 'click_text' UNION ALL SELECT 'text_assertion_alternatives_added', sum(n_added)::BIGINT FROM steps WHERE texts AND action <> 'click_text'
      UNION ALL SELECT 'click_text_steps_patched', count(*) FROM steps WHERE texts AND action = 'click_text' UNION ALL SELECT 'click_text_alternatives_added', sum(n_added)::BIGINT FROM steps WHERE texts AND action = 'click_text'
      UNION ALL SELECT 'source_text_expressions_skipped', count(*) FROM steps WHERE skipped UNION ALL SELECT 'high_risk_text_expressions', count(*) FROM steps WHERE risky UNION ALL SELECT 'js_steps_patched', count(*) FROM steps WHERE risky OR how > 0
      UNION ALL SELECT 'js_regex_patches', count(*) FROM steps WHERE how = 1 UNION ALL SELECT 'js_array_alternatives_added', sum(n_added)::BIGINT FROM steps WHERE how = 3 UNION ALL SELECT 'js_includes_patches', sum(CASE WHEN risky THEN 4 WHEN how = 2 THEN 1 ELSE 0 END)::BIGINT FROM steps
      UNION ALL SELECT 'steps_seen', count(*) FROM steps UNION ALL SELECT 'test_cases_seen', count(*) FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'items_seen', count(*) FROM customer
      UNION ALL SELECT 'metadata_synced_category', count(*) FROM items WHERE moved) SELECT * FROM n WHERE n > 0 UNION ALL SELECT 'changed_rows_' || file, count(*) FILTER (changed) FROM items GROUP BY file""",
    "edition_risks": f"WITH {STEPS} SELECT pos, pos || '/' || o_orderkey || '/step[' || step || ']/' || action AS label FROM items JOIN orders ON o_custkey = pos JOIN steps ON l_orderkey = o_orderkey WHERE risky ORDER BY file, pos, o_orderkey, step LIMIT 30",
    "edition_strict": f"{STRICT} SELECT * FROM found WHERE NOT starts_with(kind, 'allowed_')",
    "edition_strict_counts": f"{STRICT} SELECT CASE WHEN NOT starts_with(kind, 'allowed_') THEN file END AS file, kind, count(*) AS n FROM found GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
