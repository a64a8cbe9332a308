"""Queries over diagnoses and repair traces."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import repair as R
from ..sources.tables import table

NAMES = tuple(R.STRATEGIES)
KINDS = {"click": "bug_fix", "view": "feature_complete", "purchase": "holistic_rewrite", "signup": "fix_game"}


def _content():
    """A number from an order's contents; both engines compute it alike."""
    return F.col("o_custkey") * 31 + F.floor("o_totalprice").cast("long") + F.col("o_orderkey")


def diagnoses(spark, sf_dir):
    """Diagnoses from the contents of orders: scores, probe results and what was tried before."""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), _content().alias("k"))
    return rows.select(
        "record_id", k, (k * 11 % 101).alias("score"), (k % 21).alias("rendering"), (3 * k % 21).alias("visual_design"), (5 * k % 26).alias("functionality"), (7 * k % 26).alias("interaction"), (k % 11).alias("code_quality"),
        F.element_at(F.array(F.lit(""), *map(F.lit, NAMES)), (k % 13 + 1).cast("int")).alias("prev"), (k % 10 == 0).alias("keyboard_broken"), (k % 3).alias("playability_tries"), (k % 4 == 0).alias("is_game"), (k % 8 == 0).alias("canvas"),
        (k % 5).alias("raf_calls"), F.when(k % 9 == 0, 1).otherwise(0).alias("overlays"), (k % 3).alias("issues"), (k % 7 == 0).alias("game_issue"), (k % 4).alias("holistic_run"), (k % 6).alias("console_errors"), (k % 12 != 0).alias("render_ok"), (k % 5 != 0).alias("interactive"),
        (k % 3).alias("agent_steps"), (k % 17 > 6).alias("agent_ran"), (k % 5 == 1).alias("dynamic"), (k % 7 == 2).alias("keyboard_probed"), (k % 13 == 5).alias("keys_known"), F.when(k % 11 == 3, 1).otherwise(0).alias("observer_items"),
    ).withColumn("quality", R.evidence_quality())


def traces(spark, sf_dir):
    """Repair iterations from events: a record per user and hundred events, in order."""
    k, value = F.col("event_type"), F.col("value")
    name = F.when(k == "click", "bug_fix").when(k == "view", "feature_complete").when(k == "purchase", "holistic_rewrite").when(k == "signup", "fix_game").otherwise("fix_interaction")
    record = F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 1000).cast("string"))
    return table(spark, sf_dir, "events").select(
        record.alias("record_id"), F.col("event_id").alias("iteration"), name.alias("strategy"), (F.floor(value * 7).cast("long") % 101).alias("score"),
        (F.floor(value * 3).cast("long") % 26).alias("interaction"), (k == "error").alias("keyboard_broken"),
    )


def repair_strategy(spark, sf_dir):
    black = F.when(F.col("k") % 6 == 0, F.array(F.lit("bug_fix"), F.lit("visual_enrichment"))).otherwise(F.array().cast("array<string>"))
    return diagnoses(spark, sf_dir).select("record_id", "k", "quality", R.strategy().alias("strategy"), R.broken_layer().alias("layer")).withColumn("allowed", R.allowed(F.col("strategy"), black)).drop("k")


def repair_running(spark, sf_dir):
    return R.running(traces(spark, sf_dir).drop("interaction", "keyboard_broken"))


def repair_trace_stats(spark, sf_dir):
    return R.trace_stats(traces(spark, sf_dir))


def repair_strategy_stats(spark, sf_dir):
    return R.strategy_stats(traces(spark, sf_dir))


def repair_replay(spark, sf_dir):
    return R.replay(traces(spark, sf_dir))


def repair_overrides(spark, sf_dir):
    k = F.col("k")
    chosen, on = F.element_at(F.array(*map(F.lit, NAMES)), (k % 12 + 1).cast("int")), F.array(*map(F.lit, NAMES))
    rows = diagnoses(spark, sf_dir).withColumns({"rewrites": k % 4, "size": k * 97 % 60000, "chosen": chosen, "enabled": F.filter(on, lambda n: (k + F.length(n)) % 5 != 0)})
    some = R.overridden(F.col("chosen"), F.col("size"), F.col("enabled"))
    return rows.select("record_id", R.overridden(F.col("chosen"), F.col("size")).alias("strategy"), some.alias("enabled_only"), R.candidates().cast("long").alias("candidates"))


def repair_issues(spark, sf_dir):
    """Issues and preserved features from recorded evidence, derived from the contents of orders."""
    k = F.col("k")
    some = lambda n, *values: F.slice(F.array(*map(F.lit, values)), F.lit(1), (k % n).cast("int"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), _content().alias("k"), "o_orderpriority", "o_orderstatus")
    rows = orders.select(
        "record_id", some(5, "e1", "e2", "e3", "e4").alias("console_messages"), (k % 2 == 0).alias("keyboard_game"), (k % 3 == 0).alias("keyboard_probed"), some(3, "w", "a").alias("keys_responded"), (k % 7 == 0).alias("keyboard_visual_change"),
        F.when(k % 5 == 0, some(4, "x", "y", "z")).alias("discovered_keys"), (k % 4 == 0).alias("dynamic"), (k % 8 == 0).alias("button_responsive"), (k % 12 == 0).alias("animation_detected"), (k % 3).alias("frame_change_rate"), (k % 3).alias("unbound_buttons"), (k % 6).alias("total_buttons"),
        F.slice(F.array("o_orderpriority", "o_orderstatus", F.lit("menu")), F.lit(1), (k % 11 % 4).cast("int")).alias("overlays_seen"), (k % 13 < 4).alias("canvas_game"), (F.col("o_orderstatus") == "F").alias("completion_seen"),
        some(7, "o1", "o2", "o3", "o4", "o5", "o6").alias("observer_broken"), some(6, "o1", "t1", "t2", "t3", "t4").alias("audit_broken"), (k % 9 == 0).alias("agent_ran"), some(5, "t1", "g1", "g2", "g3").alias("agent_bugs"),
        some(3, "works", "draws").alias("observer_working"), some(4, "draws", "logo", "frame").alias("visual_elements"), some(2, "nice").alias("highlights"),
    )
    return rows.select("record_id", F.array_join(R.reliable_issues(), ";").alias("issues"), F.array_join(R.preserved(), ";").alias("preserved"), R.keyboard_broken().alias("broken"), R.keyboard_verified().alias("verified"))


CONTENT = "o_custkey * 31 + CAST(floor(o_totalprice) AS BIGINT) + o_orderkey"
PREV = "list_extract(['', " + ", ".join(f"'{n}'" for n in NAMES) + "], CAST(k % 13 + 1 AS INT))"
OTHER = lambda name, instead: f"CASE WHEN prev <> '{name}' THEN '{name}' ELSE '{instead}' END"
DEF = {d: f"(({m} - {d})::DOUBLE / {m})" for d, m in R.MAXIMA.items()}
WANT = {d: f"{d} <= CASE WHEN score >= 90 THEN {R.LIMITS[d][1]} ELSE {R.LIMITS[d][0]} END AND {DEF[d]} > {R.LEAST_DEFICIT[d]}::DOUBLE" + (" AND interactive" if d == "interaction" else "") for d in R.MAXIMA}
DIAGNOSES = f"""WITH o AS (SELECT o_orderkey AS rid, {CONTENT} AS k FROM orders), g0 AS (SELECT rid, k, k * 11 % 101 AS score, k % 21 AS rendering, 3 * k % 21 AS visual_design, 5 * k % 26 AS functionality, 7 * k % 26 AS interaction, k % 11 AS code_quality, {PREV} AS prev, k % 5 <> 0 AS interactive,
  CASE WHEN k % 3 > 0 AND k % 17 > 6 THEN 'high' WHEN k % 5 = 1 OR k % 6 > 0 OR k % 13 = 5 OR k % 7 = 2 OR k % 11 = 3 THEN 'medium' ELSE 'low' END AS quality FROM o),
ranked AS (SELECT rid, list_sort(list_filter([{", ".join(f"CASE WHEN {WANT[d]} THEN {{'deficit': {DEF[d]}, 'dimension': '{d}', 'strategy': '{R.REFINERS[d]}'}} END" for d in R.MAXIMA)}], lambda x: x IS NOT NULL), 'DESC') AS c FROM g0),
g AS (SELECT g0.*, functionality::DOUBLE / 25 AS fr, visual_design::DOUBLE / 20 AS vr, interaction::DOUBLE / 25 AS ir, CASE WHEN len(c) = 0 THEN CASE WHEN score >= 90 AND prev = 'visual_enrichment' THEN 'polish_visual' ELSE 'visual_enrichment' END
  WHEN c[1].strategy = prev AND len(c) > 1 THEN c[2].strategy ELSE c[1].strategy END AS target FROM g0 JOIN ranked ON g0.rid = ranked.rid),
st AS (SELECT rid, k, quality, CASE WHEN k % 9 = 0 THEN 'overlay' WHEN k % 8 = 0 AND k % 5 = 0 THEN 'game_loop' WHEN k % 10 = 0 THEN 'input' WHEN k % 8 = 0 AND rendering < 14 THEN 'canvas' ELSE 'gameplay' END AS layer,
  CASE WHEN k % 10 = 0 THEN CASE WHEN k % 3 < 2 AND prev <> 'fix_playability' THEN 'fix_playability' ELSE 'feature_complete' END
  WHEN k % 4 = 0 AND score BETWEEN 40 AND 79 THEN CASE WHEN (k % 8 = 0 AND k % 5 = 0) OR k % 9 = 0 OR k % 7 = 0 THEN 'fix_game' ELSE {OTHER("fix_game", "feature_complete")} END
  WHEN interaction < 15 AND score >= 60 AND quality <> 'low' THEN {OTHER("fix_interaction", "feature_complete")} WHEN score >= 80 THEN target
  WHEN k % 4 >= 2 AND score >= 40 THEN CASE WHEN fr < 0.72::DOUBLE THEN 'feature_complete' WHEN vr < 0.75::DOUBLE AND score >= 70 THEN 'visual_enrichment' ELSE 'feature_complete' END
  WHEN prev = 'fix_playability' AND score >= 40 THEN 'feature_complete'
  WHEN score >= 60 THEN CASE WHEN k % 3 > 0 THEN {OTHER("bug_fix", "feature_complete")} WHEN fr < 0.72::DOUBLE THEN {OTHER("feature_complete", "bug_fix")} WHEN ir < 0.60::DOUBLE THEN {OTHER("fix_interaction", "feature_complete")}
    WHEN vr < 0.75::DOUBLE THEN CASE WHEN score >= 70 THEN {OTHER("visual_enrichment", "feature_complete")} ELSE {OTHER("feature_complete", "holistic_rewrite")} END ELSE {OTHER("feature_complete", "bug_fix")} END
  WHEN quality = 'low' THEN 'holistic_rewrite' WHEN quality = 'medium' THEN CASE WHEN k % 6 > 0 THEN 'bug_fix' ELSE 'holistic_rewrite' END WHEN k % 12 = 0 OR score < 50 THEN 'holistic_rewrite'
  WHEN k % 3 > 0 AND fr >= 0.5::DOUBLE THEN {OTHER("bug_fix", "feature_complete")} ELSE {OTHER("feature_complete", "bug_fix")} END AS strategy FROM g)"""
TRACES = """WITH t AS (SELECT user_id || '-' || (event_id // 1000) AS record_id, event_id AS iteration, CASE event_type WHEN 'click' THEN 'bug_fix' WHEN 'view' THEN 'feature_complete' WHEN 'purchase' THEN 'holistic_rewrite' WHEN 'signup' THEN 'fix_game' ELSE 'fix_interaction' END AS strategy,
  CAST(floor(value * 7) AS BIGINT) % 101 AS score, CAST(floor(value * 3) AS BIGINT) % 26 AS interaction, event_type = 'error' AS keyboard_broken FROM events),
r0 AS (SELECT *, score - lag(score) OVER w AS delta, max(score) OVER (PARTITION BY record_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS best, CASE WHEN lag(strategy) OVER w = strategy THEN 0 ELSE 1 END AS turn FROM t WINDOW w AS (PARTITION BY record_id ORDER BY iteration)),
r1 AS (SELECT *, sum(turn) OVER (PARTITION BY record_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS run FROM r0),
r AS (SELECT record_id, iteration, strategy, score, delta, best, row_number() OVER (PARTITION BY record_id, run ORDER BY iteration) AS run_length FROM r1)"""
ORACLES = {
    "repair_strategy": f"""{DIAGNOSES} SELECT rid AS record_id, quality, strategy, layer, CASE WHEN k % 6 = 0 AND strategy IN ('bug_fix', 'visual_enrichment') THEN 'feature_complete' ELSE strategy END AS allowed FROM st""",
    "repair_running": f"{TRACES} SELECT * FROM r",
    "repair_trace_stats": f"{TRACES}, p AS (SELECT record_id, arg_min(score, iteration) AS original_score, max(score) AS best_score, count(*) AS iterations FROM t GROUP BY 1) SELECT *, best_score - original_score AS improvement, best_score >= 80 AND best_score - original_score >= 10 AS sft_eligible FROM p",
    "repair_strategy_stats": f"{TRACES} SELECT strategy, count(*) AS uses, round_even(avg(delta), 1) + 0.0 AS avg_delta, round_even(avg(CAST(delta > 0 AS INT)), 3) AS success_rate, count(*) FILTER (delta < -8) AS blacklisted FROM r WHERE delta IS NOT NULL GROUP BY strategy",
}
PATCHING = "(" + ", ".join(f"'{n}'" for n, mode in R.STRATEGIES.items() if mode == "patch") + ")"
ENABLED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
ORACLES["repair_overrides"] = f"""WITH c AS (SELECT o_orderkey AS rid, {CONTENT} AS k FROM orders),
  o AS (SELECT *, k * 11 % 101 AS score, k * 97 % 60000 AS size, list_extract({ENABLED}, CAST(k % 12 + 1 AS INT)) AS c, list_filter({ENABLED}, lambda n: (k + length(n)) % 5 <> 0) AS on FROM c),
  u AS (SELECT *, c = 'holistic_rewrite' AND k % 4 >= 2 AND score < 80 AND size <= 35000 AS tired, CASE WHEN list_contains("on", c) THEN c ELSE 'holistic_rewrite' END AS e FROM o),
  w AS (SELECT *, e = 'holistic_rewrite' AND k % 4 >= 2 AND score < 80 AND size <= 35000 AS etired FROM u),
  v AS (SELECT *, CASE WHEN tired THEN 'feature_complete' ELSE c END AS d, CASE WHEN etired AND list_contains("on", 'feature_complete') THEN 'feature_complete' WHEN etired AND list_contains("on", 'bug_fix') THEN 'bug_fix' ELSE e END AS f FROM w)
  SELECT rid AS record_id, CASE WHEN size > 35000 AND d IN {PATCHING} THEN CASE WHEN score >= 80 THEN 'visual_enrichment' ELSE 'holistic_rewrite' END ELSE d END AS strategy,
  CASE WHEN size > 35000 AND f IN {PATCHING} AND score >= 80 AND list_contains("on", 'visual_enrichment') THEN 'visual_enrichment' WHEN size > 35000 AND f IN {PATCHING} AND list_contains("on", 'holistic_rewrite') THEN 'holistic_rewrite' ELSE f END AS enabled_only,
  CAST(CASE WHEN score < 70 THEN 3 WHEN score < 90 THEN 2 ELSE 1 END AS BIGINT) AS candidates FROM v"""
RECORD_SQL = "user_id || '-' || (event_id // 1000)"


def replay_sql(record: str) -> str:
    """The early-stop rule over events of each ``record`` (an SQL expression) in order."""
    traces_sql = TRACES.replace("WITH t AS", "WITH RECURSIVE t AS").replace(RECORD_SQL, record)
    return f"""{traces_sql}, n AS (SELECT record_id, iteration, score, interaction, keyboard_broken, row_number() OVER (PARTITION BY record_id ORDER BY iteration) AS nth FROM t),
  f(record_id, nth, step_no, best, inter, broken, since, low, reason) AS (
    SELECT record_id, nth, iteration, score, interaction, keyboard_broken, 0, 0, CAST(NULL AS VARCHAR) FROM n WHERE nth = 1
    UNION ALL SELECT record_id, nth, step_no, best, inter, broken, CASE WHEN plateau THEN 0 ELSE since END, CASE WHEN forced THEN 0 WHEN score >= 97 THEN low ELSE cnt END,
      CASE WHEN forced THEN NULL WHEN score >= 97 THEN 'near_perfect' WHEN cnt >= CASE WHEN score >= 80 THEN 2 ELSE 3 END THEN 'converged' END FROM (
      SELECT *, CASE WHEN delta < CASE WHEN score >= 90 THEN 0.5 WHEN score >= 85 THEN 1.0 ELSE 2.0 END THEN low + 1 ELSE 0 END AS cnt FROM (
        SELECT *, CASE WHEN plateau THEN 0 ELSE low0 END AS low FROM (
          SELECT *, NOT forced AND since >= 2 AS plateau FROM (
            SELECT *, broken AND inter < 20 AS forced FROM (
              SELECT f.record_id, n.nth, n.iteration AS step_no, n.score, n.score - f.best AS delta, greatest(f.best, n.score) AS best, CASE WHEN n.score > f.best THEN n.interaction ELSE f.inter END AS inter,
                CASE WHEN n.score > f.best THEN n.keyboard_broken ELSE f.broken END AS broken, CASE WHEN n.score > f.best THEN 0 ELSE f.since + 1 END AS since, f.low AS low0
              FROM f JOIN n ON n.record_id = f.record_id AND n.nth = f.nth + 1 WHERE f.reason IS NULL)))))
  )
  SELECT record_id, coalesce(arg_max(reason, nth), 'exhausted') AS stop_reason, arg_max(step_no, nth) AS stopped_at, arg_max(best, nth) AS best_score FROM f GROUP BY record_id"""


ORACLES["repair_replay"] = replay_sql(RECORD_SQL)
TAKE = lambda n, *values: "list_slice([" + ", ".join(f"'{v}'" for v in values) + f"], 1, CAST(k % {n} AS INT))"
NEW = lambda more, seen: f"list_filter({more}, lambda x: NOT list_contains({seen}, x))"
ORACLES["repair_issues"] = f"""WITH o AS (SELECT o_orderkey AS rid, {CONTENT} AS k, o_orderpriority AS pr, o_orderstatus AS os FROM orders), e AS (SELECT *, CASE WHEN k % 5 = 0 THEN {TAKE(4, "x", "y", "z")} END AS keys, k % 2 = 0 AS game FROM o),
  f AS (SELECT *, game AND ((k % 3 = 0 AND k % 3 = 0 AND k % 7 <> 0) OR (keys IS NOT NULL AND len(keys) = 0)) AS broken, game AND ((k % 3 = 0 AND (k % 3 > 0 OR k % 7 = 0)) OR (keys IS NOT NULL AND len(keys) > 0)) AS verified FROM e),
  m AS (SELECT *, list_transform(list_slice({TAKE(5, "e1", "e2", "e3", "e4")}, 1, 3), lambda x: 'console error: ' || x) || CASE WHEN broken THEN ['keyboard input has no effect'] ELSE [] END || CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN ['buttons have no visible effect'] ELSE [] END
    || CASE WHEN k % 4 = 0 AND k % 12 <> 0 AND k % 3 = 0 THEN ['nothing is animated'] ELSE [] END || list_transform(list_slice(list_slice([pr, os, 'menu'], 1, CAST(k % 11 % 4 AS INT)), 1, 2), lambda x: 'overlay: ' || x) || CASE WHEN k % 3 > 0 AND k % 6 > 0 THEN [(k % 3) || ' of ' || (k % 6) || ' buttons have no handler'] ELSE [] END
    || CASE WHEN (k % 13 < 4 OR game) AND os <> 'F' AND k % 4 = 0 AND (k % 12 = 0 OR k % 8 = 0) THEN ['the game has no end'] ELSE [] END || list_slice({TAKE(7, "o1", "o2", "o3", "o4", "o5", "o6")}, 1, 5) AS seen FROM f),
  a AS (SELECT *, seen || list_slice({NEW(TAKE(6, "o1", "t1", "t2", "t3", "t4"), "seen")}, 1, CAST(greatest(0, 10 - len(seen)) AS INT)) AS more FROM m),
  w AS (SELECT *, {TAKE(3, "works", "draws")} AS working, {NEW(TAKE(4, "draws", "logo", "frame"), TAKE(3, "works", "draws"))} AS visual FROM a),
  p AS (SELECT *, working || list_transform(visual, lambda v: '[visual] ' || v) AS good FROM w)
  SELECT rid AS record_id, array_to_string(CASE WHEN k % 9 = 0 THEN more || {NEW("list_slice(" + TAKE(5, "t1", "g1", "g2", "g3") + ", 1, 3)", "more")} ELSE more END, ';') AS issues,
  array_to_string(CASE WHEN len(good) = 0 THEN {TAKE(2, "nice")} ELSE good END || CASE WHEN verified AND len(coalesce(keys, [])) > 0 THEN ['keys work: ' || array_to_string(keys, ', ')] ELSE [] END, ';') AS preserved, broken, verified FROM p"""
QUERIES = {name: globals()[name] for name in ORACLES}
