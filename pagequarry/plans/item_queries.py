"""Queries over items beside results, cached responses, repairs and editions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.taxonomy import FAMILY_SQL, SOURCE_SQL
from ..operators import bilingual as B
from ..operators import items as I  # noqa: E741
from ..sources.tables import RESPONSES_SQL, RESULTS_SQL, responses, results, table
from .record_queries import WHOLE


def _items(spark, sf_dir):
    """Items from customers, with older names of categories."""
    segment = F.col("c_mktsegment")
    category = F.when(segment == "MACHINERY", "game").when(segment == "BUILDING", "ui").when(segment == "AUTOMOBILE", "svg_art").when(segment == "HOUSEHOLD", " own ").otherwise("")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("item_id"), F.col("c_name").alias("prompt"), F.col("c_mktsegment").alias("response"), category.alias("category"),
        F.concat(F.lit("sub"), (F.col("c_nationkey") % 3).cast("string")).alias("sub_type"), F.when(F.col("c_acctbal") > 0, "hard").alias("difficulty"), F.lit("en").alias("language"),
    )


def items_normalized(spark, sf_dir):
    return I.normalized(_items(spark, sf_dir)).select("item_id", "category", "source_category")


def items_as_records(spark, sf_dir):
    rows = I.as_records(_items(spark, sf_dir))
    said = lambda i: F.get("data.messages", i)["content"]
    return rows.select("line_number", said(0).alias("asked"), said(1).alias("answered"), F.size("data.messages").cast("long").alias("messages"), "category")


def results_with_items(spark, sf_dir):
    """Results, a part of which lacks metadata, filled from their items."""
    lack = F.col("eval_status") == "failed"
    rows = results(spark, sf_dir).select(
        "line_idx", "item_id", F.when(lack, F.lit(None)).otherwise(F.col("category")).alias("category"), F.when(F.col("total") < 50, "").otherwise(F.col("sub_type")).alias("sub_type"),
        F.when(lack, F.lit(None)).otherwise(F.col("difficulty")).alias("difficulty"), F.when(lack, F.lit(None)).otherwise(F.col("language")).alias("language"), F.lit(None).cast("string").alias("source_category"),
    )
    found = I.with_metadata(rows, I.normalized(_items(spark, sf_dir)))
    return found.groupBy("category", "source_category", "difficulty", "language", "sub_type").agg(F.count("*").alias("n"), F.sum("line_idx").alias("lines"))


def _cached(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    size = F.length("html")
    own = F.when(size % 4 == 0, F.col("html")).when(size % 4 == 1, "no page")
    items = pages.select(F.col("page_id").cast("string").alias("item_id"), F.when(size % 9 != 0, F.col("url")).alias("prompt"), own.alias("response"))
    lines = responses(spark, sf_dir).join(pages.select("page_id", "url", size.alias("size")), F.col("item_id") == F.col("page_id"))
    prompt = F.when(F.col("size") % 5 == 0, "another").when(F.col("size") % 7 != 0, F.col("url"))
    return items, lines.select(F.col("page_id").cast("string").alias("id"), prompt.alias("prompt"), "response", F.col("page_id").alias("line_idx"))


def checkpoint_merge(spark, sf_dir):
    merged, _ = I.merge_checkpoint(*_cached(spark, sf_dir))
    return merged.select("item_id", "state", F.md5(F.coalesce("response", F.lit("")).cast("binary")).alias("response_md5"))


def checkpoint_merge_counts(spark, sf_dir):
    return I.merge_checkpoint(*_cached(spark, sf_dir))[1]


def score_payloads(spark, sf_dir):
    """Scores as JSON without empty reasons and lists, read back."""
    names = ("rendering", "visual_design", "functionality")
    reasons = {"rendering": F.when(F.col("rendering") > 5, F.col("sub_type")).otherwise("")}
    lists = {"bugs": F.when(F.col("total") < 50, F.array("model", "difficulty")).otherwise(F.array().cast("array<string>"))}
    rows = results(spark, sf_dir).select("line_idx", I.score_payload(F.col("total"), {n: F.col(n) for n in names}, reasons, lists).alias("payload"))
    return rows.select("line_idx", "payload")


def result_fingerprints(spark, sf_dir):
    """Results by the fingerprint of how they were made."""
    made = {"skip": F.col("has_interaction"), "limits": {"tests": F.col("tests_total"), "rate": F.when(F.col("trial") > 0, F.col("trial") / 2)}}
    payload = {"processing": made, "evaluator_model": F.col("model"), "extras": {"difficulty": F.col("difficulty"), "category": F.col("category"), "none": {}}}
    return results(spark, sf_dir).select(I.fingerprint(payload).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))


def scorer_consistency(spark, sf_dir):
    """Results whose scores are all 0 although highlights are named (results of failed runs count with zero scores)."""
    zero = lambda n: F.when(F.col("total") % 10 == 0, 0).otherwise(F.col(n))
    highlights = F.when(F.col("language") == "en", F.array("sub_type")).otherwise(F.array().cast("array<string>"))
    rows = results(spark, sf_dir).select("eval_status", I.inconsistent([zero("rendering"), zero("visual_design"), zero("functionality")], highlights).alias("retry"))
    return rows.groupBy("eval_status").agg(F.count_if("retry").alias("retries"), F.count("*").alias("n"))


def dimension_changes(spark, sf_dir):
    """What changed from each item's first to its last result, by dimension."""
    names = ("rendering", "visual_design", "functionality", "interaction", "code_quality")
    score = F.struct(*names)
    ends = results(spark, sf_dir).groupBy("item_id").agg(F.min_by(score, "line_idx").alias("before"), F.max_by(score, "line_idx").alias("after"))
    return ends.select("item_id", I.dimension_deltas(F.col("before"), F.col("after"), names).alias("d")).select("item_id", "d.*")


def iteration_summaries(spark, sf_dir):
    delta = F.col("total") - F.lag("total").over(W.partitionBy("item_id").orderBy("line_idx"))
    rows = results(spark, sf_dir).withColumn("delta", delta).where("delta is not null")
    return rows.select(I.iteration_summary(F.col("delta"), F.col("eval_status") != "failed").alias("s")).groupBy("s.what_improved", "s.what_remains").agg(F.count("*").alias("n"))


def _traces(spark, sf_dir):
    ends = results(spark, sf_dir).groupBy("item_id").agg(F.min_by("total", "line_idx").alias("original_score"), F.max("total").alias("final_score"), F.max_by("model", "total").alias("m"), F.min("line_idx").alias("first"))
    return ends.select(F.col("item_id").alias("query"), "original_score", "final_score", F.concat(F.lit("page "), F.col("final_score").cast("string")).alias("best_html"), F.concat(F.lit("page "), F.col("original_score").cast("string")).alias("original_html"))


def preference_pairs(spark, sf_dir):
    return I.preference_pairs(_traces(spark, sf_dir), "best_html", "original_html")


def repair_list(spark, sf_dir):
    from ..operators import curation as C

    rows = C.tiers(results(spark, sf_dir)).select("line_idx", "item_id", "tier")
    return I.repair_list(rows, include_c=True)


def _synced(spark, sf_dir):
    """An edition brought in line with the main one, place by place; these items have no test cases."""
    k = F.col("item_id").cast("long")
    none = F.array().cast("array<struct<id string, steps array<struct<action string, text_pattern string>>>>")
    main = I.normalized(_items(spark, sf_dir)).select(F.lit("items").alias("file"), k.alias("pos"), "item_id", "prompt", F.lit("en").alias("language"), "category", "difficulty", "sub_type", none.alias("test_cases"))
    other = main.withColumns({"language": F.lit("zh"), "prompt": F.concat(F.lit("zh "), "prompt"), "category": F.when(k % 4 == 0, "old").otherwise(F.col("category")), "sub_type": F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("sub_type"))})
    return B.synced(main, other)


def edition_sync(spark, sf_dir):
    return _synced(spark, sf_dir)[0].select("item_id", "prompt", "language", "category", "difficulty", "sub_type", "changed")


def edition_sync_counts(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


def _viewer(spark, sf_dir):
    whole = lambda c: F.floor(c).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), (F.col("o_orderkey") * 7919 % 100003).alias("place"), (F.col("o_custkey") % 9 != 0).alias("has_html"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("query"), (whole("o_totalprice") % 101).alias("score"))
    line = table(spark, sf_dir, "lineitem").withColumn("uid", F.col("l_orderkey").cast("string"))
    reports = line.where("l_returnflag <> 'N'").groupBy("uid", F.when(F.col("l_returnflag") == "R", "test").otherwise("repair").alias("style")).agg(F.max(F.when(F.col("l_linestatus") == "O", whole("l_quantity"))).alias("score"))
    traces = lambda test, value: line.where(test).groupBy("uid").agg(F.max(value).alias("improvement"))
    return I.viewer_records(orders, reports, traces("l_linenumber in (2, 3)", whole("l_quantity") - 30), traces("l_linenumber = 4", whole(F.col("l_discount") * 100)), traces("l_linenumber = 7", whole("l_quantity")))


def viewer_records(spark, sf_dir):
    return _viewer(spark, sf_dir)


def viewer_page(spark, sf_dir):
    """The second page of repaired records of a dataset with a score of 20 to 90, best first."""
    return I.page(_viewer(spark, sf_dir), "score_desc", 1, 40, 20, 90, repaired=True, dataset="F")[0].select("uid", "score", "repair_delta")


def viewer_total(spark, sf_dir):
    return I.page(_viewer(spark, sf_dir), "dataset_asc", 0, 40, 20, 90, refined=True)[1]


def viewer_search(spark, sf_dir):
    return I.searched(_viewer(spark, sf_dir), "URGENT").groupBy("query", "dataset").agg(F.count("*").alias("n"))


def settle_windows(spark, sf_dir):
    """How long pages settle after steps whose timeout comes from an event's value."""
    action = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll").when(F.col("event_type") == "signup", "Hover").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", I.settle_window(action, F.floor(F.col("value") * 10)).alias("settle_ms"))


def selected_items(spark, sf_dir):
    """The items that good results select; a selection of unknown items is an error."""
    chosen = results(spark, sf_dir).where("total >= 90").select("item_id")
    return I.selected(_items(spark, sf_dir), chosen, ["item_id"]).groupBy("category").agg(F.count("*").alias("n"))


def only_items(spark, sf_dir):
    return I.only(_items(spark, sf_dir), "5, 17,, 100, nobody", 3, "item_id").select("item_id", "prompt")


def phase_gates(spark, sf_dir):
    """Which phases the records of orders would go through."""
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 45).alias("n"))
    orders = table(spark, sf_dir, "orders").join(cases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rendered = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    gates = I.phase_gates(F.coalesce(F.col("n") > 0, F.lit(False)), F.col("o_totalprice") > 1000, rendered, F.col("o_orderpriority") != "5-LOW")
    return orders.select(gates.alias("g")).groupBy("g.tests", "g.render", "g.agent").agg(F.count("*").alias("n"))


def results_stamped(spark, sf_dir):
    rows = I.stamped(results(spark, sf_dir), {"dataset": "en", "runner": "r1"})
    return rows.groupBy("dataset", "runner", "eval_status").agg(F.count("*").alias("n"))


def run_coverage(spark, sf_dir):
    return I.coverage(results(spark, sf_dir), table(spark, sf_dir, "customer").count())


def items_by_file(spark, sf_dir):
    """Parts written back as lines of a file per brand, and read again in their order."""
    from ..sources import jsonl
    from ..sources.staging import folder
    from .text_queries import jsonl_name

    path = f"{folder(spark)}/items-{jsonl_name()}"
    line = F.to_json(F.struct(F.col("p_partkey").alias("n")))
    I.write_by_file(table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "#", "").alias("file"), F.col("p_partkey").alias("position"), line.alias("value")), path)
    rows = jsonl.lines(spark, f"{path}/*", "n long").withColumn("brand", F.regexp_extract("file", "file=([^/]+)/", 1))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("brand").orderBy("n")) - 1)
    return ranked.groupBy("brand").agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.bool_and(F.col("rank") == F.col("line_idx")).alias("ordered"))


def difficulty_table(spark, sf_dir):
    """Averages by difficulty, easiest first."""
    rows = results(spark, sf_dir).groupBy("difficulty").agg(F.count("*").alias("n"), F.bround(F.avg("total"), 1).alias("avg_score"))
    # One row per difficulty.
    return rows.withColumn("place", F.row_number().over(W.orderBy(I.difficulty_order(F.col("difficulty")))).cast("long"))


ITEMS_SQL = """items AS (SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_custkey AS k, c_name AS prompt, c_mktsegment AS response, CASE c_mktsegment WHEN 'MACHINERY' THEN 'game' WHEN 'BUILDING' THEN 'ui' WHEN 'AUTOMOBILE' THEN 'svg_art' WHEN 'HOUSEHOLD' THEN ' own ' ELSE '' END AS category0,
    'sub' || (c_nationkey % 3) AS sub_type, CASE WHEN c_acctbal > 0 THEN 'hard' END AS difficulty, 'en' AS language FROM customer),
  normal AS (SELECT * EXCLUDE (category0), CASE WHEN trim(category0) = '' THEN category0 ELSE """ + FAMILY_SQL.format(c="category0") + """ END AS category, nullif(""" + SOURCE_SQL.format(c="category0") + """, '') AS source_category FROM items)"""
RAW = "coalesce(r.category, n.category, 'unknown')"
VIEWER = """v AS (SELECT CAST(o_orderkey AS VARCHAR) AS uid, o_orderstatus AS dataset, o_orderpriority AS query, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, o_orderkey AS k, o_orderkey * 7919 % 100003 AS place, o_custkey % 9 <> 0 AS has_html FROM orders),
  rep AS (SELECT l_orderkey AS k, l_returnflag = 'R' AS test, max(CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) END) AS s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
  fix AS (SELECT l_orderkey AS k, max(CAST(floor(l_quantity) AS BIGINT) - 30) AS i FROM lineitem WHERE l_linenumber IN (2, 3) GROUP BY 1), ref AS (SELECT l_orderkey AS k, max(CAST(floor(l_discount * 100) AS BIGINT)) AS i FROM lineitem WHERE l_linenumber = 4 GROUP BY 1),
  imp AS (SELECT l_orderkey AS k, max(CAST(floor(l_quantity) AS BIGINT)) AS i FROM lineitem WHERE l_linenumber = 7 GROUP BY 1),
  viewer AS (SELECT uid, place, dataset, query, score, has_html, t.k IS NOT NULL OR (a.k IS NOT NULL AND fix.k IS NOT NULL) OR imp.k IS NOT NULL AS has_repair,
    CASE WHEN t.k IS NOT NULL THEN coalesce(t.s - score, 0) WHEN a.k IS NOT NULL AND fix.k IS NOT NULL THEN CASE WHEN fix.i > 0 THEN fix.i ELSE coalesce(a.s - score, 0) END WHEN imp.k IS NOT NULL THEN imp.i ELSE 0 END AS repair_delta,
    ref.k IS NOT NULL AS has_refine, coalesce(ref.i, 0) AS refine_delta, imp.k IS NOT NULL AS has_improve
    FROM v LEFT JOIN (SELECT * FROM rep WHERE test) t ON v.k = t.k LEFT JOIN (SELECT * FROM rep WHERE NOT test) a ON v.k = a.k LEFT JOIN fix ON v.k = fix.k LEFT JOIN ref ON v.k = ref.k LEFT JOIN imp ON v.k = imp.k)"""
CACHED = f"""{RESPONSES_SQL}, it AS (SELECT CAST(page_id AS VARCHAR) AS item_id, page_id, CASE WHEN length(html) % 9 <> 0 THEN url END AS prompt, CASE length(html) % 4 WHEN 0 THEN html WHEN 1 THEN 'no page' END AS response, length(html) % 4 = 0 AS own FROM pages),
  ck AS (SELECT page_id, CASE WHEN length(html) % 5 = 0 THEN 'another' WHEN length(html) % 7 <> 0 THEN url END AS prompt, response, {WHOLE} AS valid FROM responses JOIN pages ON item_id = page_id),
  st AS (SELECT it.item_id, it.response, ck.response AS cached, CASE WHEN ck.valid AND NOT coalesce(regexp_matches(it.response, '(?is)<html[^>]*>.*?</html>'), false) THEN CASE WHEN it.prompt IS NULL OR coalesce(it.prompt = ck.prompt, false) THEN 'merged' ELSE 'prompt_mismatch' END END AS state
    FROM it JOIN ck ON it.page_id = ck.page_id)"""
REMAINS = f"'{I.REMAINS}'"
ORACLES = {
    "items_normalized": f"WITH {ITEMS_SQL} SELECT item_id, category, source_category FROM normal",
    "items_as_records": f"WITH {ITEMS_SQL} SELECT item_id AS line_number, prompt AS asked, response AS answered, CAST(2 AS BIGINT) AS messages, category0 AS category FROM items",
    "results_with_items": f"""WITH {RESULTS_SQL}, {ITEMS_SQL}, r AS (SELECT line_idx, item_id, CASE WHEN eval_status <> 'failed' THEN category END AS category, CASE WHEN total >= 50 THEN sub_type ELSE '' END AS sub_type, CASE WHEN eval_status <> 'failed' THEN difficulty END AS difficulty, CASE WHEN eval_status <> 'failed' THEN language END AS language FROM results_raw),
      j AS (SELECT line_idx, {RAW} AS raw, coalesce(n.source_category, '') AS given, coalesce(r.difficulty, n.difficulty, 'unknown') AS difficulty, coalesce(r.language, n.language, '') AS language, coalesce(nullif(r.sub_type, ''), n.sub_type, '') AS sub_type FROM r LEFT JOIN normal n ON r.item_id = n.item_id)
      SELECT {FAMILY_SQL.format(c="raw")} AS category, CASE WHEN given <> '' THEN given ELSE {SOURCE_SQL.format(c="raw")} END AS source_category, difficulty, language, sub_type, count(*) AS n, CAST(sum(line_idx) AS BIGINT) AS lines FROM j GROUP BY ALL""",
    "checkpoint_merge": f"WITH {CACHED} SELECT item_id, state, md5(coalesce(CASE WHEN state = 'merged' THEN cached ELSE response END, '')) AS response_md5 FROM st",
    "checkpoint_merge_counts": f"WITH {CACHED} SELECT count(*) FILTER (state = 'merged') AS merged, count(*) FILTER (state = 'prompt_mismatch') AS prompt_mismatch, (SELECT count(*) FROM ck WHERE NOT valid) AS invalid FROM st",
    "score_payloads": f"""WITH {RESULTS_SQL} SELECT line_idx, '{{"total":' || total || ',"rendering":' || rendering || ',"visual_design":' || visual_design || ',"functionality":' || functionality || CASE WHEN rendering > 5 THEN ',"rendering_reason":"' || sub_type || '"' ELSE '' END
      || CASE WHEN total < 50 THEN ',"bugs":["' || model || '","' || difficulty || '"]' ELSE '' END || '}}' AS payload FROM results_raw""",
    "result_fingerprints": f"""WITH {RESULTS_SQL} SELECT 'sha256:' || substr(sha256('{{"evaluator_model": "' || model || '", "extras": {{"category": "' || category || '", "difficulty": "' || difficulty || '", "none": {{}}}}, "processing": {{"limits": {{"rate": '
      || CASE trial WHEN 0 THEN 'null' WHEN 1 THEN '0.5' ELSE '1.0' END || ', "tests": ' || tests_total || '}}, "skip": ' || CASE WHEN has_interaction THEN 'true' ELSE 'false' END || '}}}}'), 1, 16) AS fingerprint, count(*) AS n FROM results_raw GROUP BY 1""",
    "scorer_consistency": f"WITH {RESULTS_SQL} SELECT eval_status, count(*) FILTER (language = 'en' AND (total % 10 = 0 OR (rendering = 0 AND visual_design = 0 AND functionality = 0))) AS retries, count(*) AS n FROM results_raw GROUP BY 1",
    "dimension_changes": f"WITH {RESULTS_SQL} SELECT item_id, " + ", ".join(f"arg_max({d}, line_idx) - arg_min({d}, line_idx) AS {d}" for d in ("rendering", "visual_design", "functionality", "interaction", "code_quality")) + " FROM results_raw GROUP BY item_id",
    "iteration_summaries": f"""WITH {RESULTS_SQL}, d AS (SELECT total - lag(total) OVER (PARTITION BY item_id ORDER BY line_idx) AS delta, eval_status FROM results_raw)
      SELECT CASE WHEN delta > 5 THEN 'Score rose by ' || delta || ' points' WHEN delta > 0 THEN 'Minor improvement (+' || delta || ')' ELSE 'No improvement' END AS what_improved, CASE WHEN delta < 5 AND eval_status <> 'failed' THEN {REMAINS} END AS what_remains, count(*) AS n FROM d WHERE delta IS NOT NULL GROUP BY 1, 2""",
    "preference_pairs": f"WITH {RESULTS_SQL}, t AS (SELECT item_id, arg_min(total, line_idx) AS a, max(total) AS b FROM results_raw GROUP BY 1) SELECT item_id AS query, 'page ' || b AS chosen, 'page ' || a AS rejected FROM t WHERE b >= 80 AND b > a",
    "repair_list": f"""WITH {RESULTS_SQL} SELECT line_idx, item_id, CASE WHEN total >= 40 THEN 'B' ELSE 'C' END AS tier FROM results_raw WHERE eval_status = 'completed' AND total < 80""",
    "edition_sync": f"WITH {ITEMS_SQL} SELECT item_id, 'zh ' || prompt AS prompt, 'zh' AS language, category, difficulty, sub_type, (k % 4 = 0 AND category <> 'old') OR (k % 6 = 0 AND sub_type IS NOT NULL) AS changed FROM normal",
    "edition_sync_counts": f"""WITH {ITEMS_SQL}, n AS (SELECT count(*) FILTER (k % 4 = 0 AND category <> 'old') AS c, count(*) FILTER (k % 6 = 0 AND sub_type IS NOT NULL) AS s, count(*) AS items, count(*) FILTER ((k % 4 = 0 AND category <> 'old') OR (k % 6 = 0 AND sub_type IS NOT NULL)) AS rows FROM normal)
      SELECT 'metadata_synced_category' AS name, c AS n FROM n UNION ALL SELECT 'metadata_synced_sub_type', s FROM n UNION ALL SELECT 'items_seen', items FROM n UNION ALL SELECT 'changed_rows_items', rows FROM n""",
    "viewer_records": f"WITH {VIEWER} SELECT * FROM viewer",
    "viewer_page": f"WITH {VIEWER} SELECT uid, score, repair_delta FROM viewer WHERE has_html AND dataset = 'F' AND has_repair AND score BETWEEN 20 AND 90 ORDER BY score DESC, place LIMIT 40 OFFSET 40",
    "viewer_total": f"WITH {VIEWER} SELECT count(*) AS total FROM viewer WHERE has_html AND has_refine AND score BETWEEN 20 AND 90",
    "viewer_search": f"WITH {VIEWER} SELECT query, dataset, count(*) AS n FROM viewer WHERE contains(uid, 'URGENT') OR contains(lower(query), 'urgent') GROUP BY 1, 2",
    "selected_items": f"WITH {RESULTS_SQL}, {ITEMS_SQL} SELECT category0 AS category, count(*) AS n FROM items WHERE item_id IN (SELECT item_id FROM results_raw WHERE total >= 90) GROUP BY 1",
    "only_items": f"WITH {ITEMS_SQL} SELECT item_id, prompt FROM items WHERE item_id IN ('5', '17', '100') ORDER BY item_id LIMIT 3",
    "phase_gates": """WITH c AS (SELECT l_orderkey AS k, count(*) FILTER (l_quantity > 45) AS n FROM lineitem GROUP BY 1), o AS (SELECT coalesce(n > 0, false) AS cases, o_totalprice > 1000 AS page, o_orderstatus AS s, o_orderpriority <> '5-LOW' AS agent FROM orders LEFT JOIN c ON o_orderkey = k)
      SELECT cases AND page AS tests, page AS render, agent AND page AND s <> 'O' AS agent, count(*) AS n FROM o GROUP BY 1, 2, 3""",
    "results_stamped": f"WITH {RESULTS_SQL} SELECT 'en' AS dataset, 'r1' AS runner, eval_status, count(*) AS n FROM results_raw GROUP BY 3",
    "run_coverage": f"""WITH {RESULTS_SQL}, p AS (SELECT round_even(count(DISTINCT item_id) * 100.0::DOUBLE / (SELECT count(*) FROM customer), 3) AS pct FROM results_raw GROUP BY model)
      SELECT min(pct) AS least, max(pct) AS most, array_to_string(list_transform(list_sort(list(DISTINCT pct)), lambda x: CAST(x AS VARCHAR)), ',') AS pcts FROM p""",
    "items_by_file": "SELECT replace(p_brand, '#', '') AS brand, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS total, true AS ordered FROM part GROUP BY 1",
    "difficulty_table": f"WITH {RESULTS_SQL} SELECT difficulty, count(*) AS n, round_even(avg(total), 1) AS avg_score, CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS place FROM results_raw GROUP BY difficulty",
    "settle_windows": """WITH e AS (SELECT event_id, event_type AS a, CAST(floor(value * 10) AS BIGINT) AS t FROM events)
      SELECT event_id, CASE a WHEN 'click' THEN least(240, greatest(120, t // 10)) WHEN 'view' THEN least(160, greatest(70, t // 16)) WHEN 'signup' THEN least(80, greatest(40, t // 30)) ELSE least(120, greatest(50, t // 20)) END AS settle_ms FROM e""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
