"""Queries over typed test cases and written results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cases as C
from ..sources.staging import folder
from ..sources.tables import RESULTS_SQL, results, table

KINDS = ("click", "press_key", "scroll", "assert_count", "assert_style", "drag", "fly", "wait_for")


def _cases(spark, sf_dir):
    """Orders as lists of cases without a schema: a case per line, whose steps lack fields here and there."""
    q, p = F.col("l_quantity").cast("long"), F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.when((F.col("l_orderkey") % 10 == 3) & (F.col("l_linenumber") == 2), 7).otherwise((p % 6) + F.when(p % 6 > 5, 2).otherwise(1)).cast("int"))
    maybe = lambda test, value: F.when(test, value)
    step = F.struct(
        kind.alias("action"), maybe(p % 3 == 0, F.lit("#a")).alias("selector"), maybe(p % 4 == 0, q).alias("repeat"), maybe(p % 5 == 0, F.lit(0.5)).alias("threshold"), maybe(p % 7 == 0, F.array(q, F.lit(1).cast("long"))).alias("from_pos"), maybe(p % 2 == 0, q % 9).alias("gte"),
        maybe(p % 6 == 0, F.struct(q.alias("x"))).alias("expected"), maybe(p % 8 == 0, F.array(F.lit("main"), F.lit("nav"))).alias("tags"),
    )
    case = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), F.struct(maybe(q % 4 > 0, F.col("l_linenumber").cast("string")).alias("id"), maybe(q % 5 == 0, F.lit("named")).alias("name"), maybe(q % 3 == 0, q / 2).alias("weight"), F.array(step).alias("steps")).alias("c"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(case)), lambda x: x["c"]).alias("cases"))
    return listed.select("l_orderkey", F.parse_json(F.to_json("cases")).alias("cases"))


def typed_cases(spark, sf_dir):
    """Every step with its defaults; an order with an unknown action has an error and no steps."""
    rows = _cases(spark, sf_dir).select("l_orderkey", C.parsed(F.col("cases")).alias("p"))
    flat = rows.select("l_orderkey", "p.error", F.explode_outer("p.cases").alias("c")).select("l_orderkey", "error", "c.id", "c.name", "c.weight", F.explode_outer("c.steps").alias("s"))
    return flat.select("l_orderkey", "error", "id", "name", "weight", "s.action", "s.selector", "s.repeat", "s.timeout", "s.threshold", F.array_join(F.col("s.from_pos").cast("array<string>"), ",").alias("from_pos"), "s.gte", F.to_json("s.expected").alias("expected"), "s.amount")


def compact_cases(spark, sf_dir):
    rows = _cases(spark, sf_dir).select("l_orderkey", C.parsed(F.col("cases"), C.COMPACT).alias("p")).where("p.error is null")
    return rows.select("l_orderkey", F.explode(C.compact(F.col("p.cases"))).alias("c")).select("l_orderkey", F.md5(F.to_json("c").cast("binary")).alias("case_md5"))


def _written(spark, sf_dir):
    k = F.col("line_idx")
    some = lambda n, name: F.transform(F.sequence(F.lit(0), k % n), lambda i: F.concat(F.lit(name), i.cast("string")))
    nothing = F.array().cast("array<string>")
    rows = results(spark, sf_dir).select(
        "line_idx", F.parse_json(F.to_json(F.struct("item_id", k.alias("_line_idx"), F.lit("old").alias("dataset"), F.col("model").alias("own")))).alias("source"), F.struct("total", "rendering").alias("score"), F.lit("en").alias("dataset"), F.col("eval_status").alias("status"),
        F.when(k % 5 > 0, F.concat(F.lit("out/"), "item_id")).alias("output_dir"), F.when(k % 3 == 0, "timeout").otherwise("").alias("skip_reason"), F.lit("render").alias("timeout_phase"), (k % 100 + 0.25).alias("elapsed_ms"), F.array(F.lit("extract"), F.lit("render")).alias("phases"),
        (k % 6 == 0).alias("fallback"), F.lit(None).cast("string").alias("fallback_reason"), F.when(k % 4 > 0, F.struct((k * 3).alias("html_size"), (k % 2 == 0).alias("html_recovered_partial"))).alias("extract"),
        F.when(k % 7 > 0, F.struct((k % 2 == 1).alias("rendered"), (k % 8).alias("keyframes_selected"), F.lit(None).cast("long").alias("total_frames_captured"), some(9, "p").alias("probe_errors"), nothing.alias("errors"))).alias("render"),
        some(3, "s").alias("screenshots"), F.struct("test_pass_rate", "tests_total", "tests_passed").alias("tests"), F.create_map(F.lit("render"), F.when(k % 2 == 0, some(8, "e")).otherwise(nothing), F.lit("agent"), nothing).alias("phase_errors"),
    )
    return rows.select("line_idx", C.written().alias("value"))


def written_results(spark, sf_dir):
    """Results as JSON, read back field by field."""
    at = lambda path: F.get_json_object("value", f"$.{path}")
    rows = _written(spark, sf_dir)
    size = lambda path: F.coalesce(F.json_array_length(at(path)), F.lit(0)).cast("long")
    return rows.select(
        "line_idx", at("item_id").alias("item_id"), at("dataset").alias("dataset"), at("own").alias("own"), at("_line_idx").alias("own_line"), at("report").alias("report"), at("skip_reason").alias("skip_reason"), at("timeout_elapsed_ms").cast("double").alias("elapsed"),
        at("fallback_reason").alias("fallback_reason"), at("score.total").cast("long").alias("total"), at("extract_summary.html_size").cast("long").alias("html_size"), at("render_summary.probe_errors_count").cast("long").alias("probe_errors"),
        size("render_summary.probe_errors").alias("kept"), at("render_summary.screenshot_count").cast("long").alias("screenshots"), at("test_runner_summary.tests_passed").cast("long").alias("passed"), size("phase_errors.render").alias("phase_errors"), at("phase_errors.agent").alias("agent_errors"),
    )


def scoreboard_files(spark, sf_dir):
    """Results' averages by model as TSV and CSV, read back, with a line of a Markdown table."""
    at = f"{folder(spark)}/board-{uuid.uuid4().hex}"
    board = results(spark, sf_dir).groupBy("model", "difficulty").agg(F.count("*").alias("n"), F.bround(F.avg("total"), 2).alias("avg_score"), F.when(F.col("difficulty") == "easy", "a|b, \"c\"").alias("note"))
    C.write_delimited(board, f"{at}/tsv", "\t")
    tsv = C.read_delimited(board, f"{at}/tsv", "\t")
    C.write_delimited(tsv, f"{at}/csv")
    return C.read_delimited(board, f"{at}/csv").select("model", "difficulty", "n", "avg_score", "note", C.markdown_line(F.col("model"), F.col("n"), F.col("note")).alias("line"))


KIND = "list_extract([" + ", ".join(f"'{k}'" for k in KINDS) + "], CAST(CASE WHEN l_orderkey % 10 = 3 AND l_linenumber = 2 THEN 7 ELSE l_partkey % 6 + 1 END AS INT))"
CASES = f"""WITH l AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p, {KIND} AS action, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem),
  s AS (SELECT l_orderkey, i, CASE WHEN q % 4 > 0 THEN CAST(l_linenumber AS VARCHAR) ELSE 'tc_' || lpad(CAST(i AS VARCHAR), 3, '0') END AS id, CASE WHEN q % 4 > 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '?' END AS told, CASE WHEN q % 5 = 0 THEN 'named' ELSE '' END AS name,
    CASE WHEN q % 3 = 0 THEN q / 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, action, CASE WHEN p % 3 = 0 THEN '#a' ELSE '' END AS selector, CASE WHEN p % 4 = 0 THEN q ELSE 1 END AS repeat, CASE WHEN p % 5 = 0 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS threshold,
    CASE WHEN p % 7 = 0 THEN q || ',1' END AS from_pos, CASE WHEN p % 2 = 0 THEN q % 9 END AS gte, CASE WHEN p % 6 = 0 THEN '{{"x":' || q || '}}' END AS expected, p % 8 = 0 AS tagged FROM l),
  e AS (SELECT l_orderkey, arg_min(told, i) AS place FROM s WHERE action = 'fly' GROUP BY 1)"""
ORACLES = {
    "typed_cases": f"""{CASES} SELECT l_orderkey, NULL::VARCHAR AS error, id, name, weight, action, selector, repeat, 5000::BIGINT AS timeout, threshold, from_pos, gte, expected, 300::BIGINT AS amount FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM e)
      UNION ALL SELECT l_orderkey, 'Unknown test action: ''fly'' in test case ' || place, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM e""",
    "compact_cases": f"""{CASES} SELECT l_orderkey, md5('{{"id":"' || id || '","name":"' || name || '","weight":' || weight || ',"steps":[{{"action":"' || action || '","selector":"' || selector || '","expression":"","key":"","text":"","text_pattern":"","tags":' || CASE WHEN tagged THEN '["main","nav"]' ELSE '[]' END || '}}]}}') AS case_md5
      FROM s WHERE l_orderkey NOT IN (SELECT l_orderkey FROM e)""",
    "written_results": f"""WITH {RESULTS_SQL} SELECT line_idx, item_id, 'en' AS dataset, model AS own, NULL::VARCHAR AS own_line, CASE WHEN line_idx % 5 > 0 THEN 'out/' || item_id || '/report.md' END AS report, CASE WHEN line_idx % 3 = 0 THEN 'timeout' END AS skip_reason,
      CASE WHEN line_idx % 3 = 0 THEN round_even(line_idx % 100 + 0.25::DOUBLE, 1) END AS elapsed, CASE WHEN line_idx % 6 = 0 THEN 'timeout' END AS fallback_reason, total, CASE WHEN line_idx % 4 > 0 THEN line_idx * 3 END AS html_size, CASE WHEN line_idx % 7 > 0 THEN line_idx % 9 + 1 END AS probe_errors,
      CAST(CASE WHEN line_idx % 7 > 0 THEN least(5, line_idx % 9 + 1) ELSE 0 END AS BIGINT) AS kept, CASE WHEN line_idx % 7 > 0 THEN line_idx % 3 + 1 END AS screenshots, tests_passed AS passed, CAST(CASE WHEN line_idx % 2 = 0 THEN least(5, line_idx % 8 + 1) ELSE 0 END AS BIGINT) AS phase_errors, NULL::VARCHAR AS agent_errors FROM results_raw""",
    "scoreboard_files": f"""WITH {RESULTS_SQL}, b AS (SELECT model, difficulty, count(*) AS n, round_even(avg(total), 2) AS avg_score, CASE WHEN difficulty = 'easy' THEN 'a|b, "c"' END AS note FROM results_raw GROUP BY 1, 2)
      SELECT *, '| ' || model || ' | ' || n || ' | ' || replace(coalesce(note, ''), '|', '\\|') || ' |' AS line FROM b""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
