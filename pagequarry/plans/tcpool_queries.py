"""Queries over test outcomes: pass statistics, the selected pool, rescoring and the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import tcpool as T
from ..sources.tables import OUTCOMES_SQL, RESULTS_SQL, results, table, test_outcomes
from .analysis_queries import KEYS, _latest  # noqa: F401

TARGET, COUNT = "m2", 2000


def _selected(spark, sf_dir):
    return T.select(T.pass_stats(test_outcomes(spark, sf_dir), TARGET), target_count=COUNT)


def tcpool_stats(spark, sf_dir):
    r = lambda c: F.bround(c, 6).alias(c)
    s = T.pass_stats(test_outcomes(spark, sf_dir), TARGET)
    return s.select(*T.KEY, "observations", "passed", "sft_observations", "sft_passed", "target_observations", "target_passed", "groups", "name", "weight", r("pass_rate"), r("sft_pass_rate"), r("non_sft_pass_rate"), r("target_pass_rate"), r("discrimination"))


def tcpool_selection(spark, sf_dir):
    return _selected(spark, sf_dir).select(*T.KEY, "keep_reason", "drop_reason")


def tcpool_manifest(spark, sf_dir):
    return T.manifest(_selected(spark, sf_dir))


def tcpool_reasons(spark, sf_dir):
    return T.reason_counts(_selected(spark, sf_dir))


def tcpool_filtered_rates(spark, sf_dir):
    return T.filtered_rates(test_outcomes(spark, sf_dir), _selected(spark, sf_dir).where("keep_reason is not null"))


def tcpool_matrix(spark, sf_dir):
    return T.pass_matrix(test_outcomes(spark, sf_dir), ["m1", "m2", "m3", "m4"])


def tcpool_group_spread(spark, sf_dir):
    return T.group_spread(test_outcomes(spark, sf_dir))


def tcpool_weighted_rate(spark, sf_dir):
    """The weighted pass rate of each item and model, 0 without weight."""
    w, p = F.sum("weight"), F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0))
    return test_outcomes(spark, sf_dir).groupBy("item_id", "model").agg(F.bround(F.coalesce(F.try_divide(p, w), F.lit(0.0)), 4).alias("rate"), F.count("*").alias("tests"))


def _rescored(spark, sf_dir):
    rates = T.filtered_rates(test_outcomes(spark, sf_dir), _selected(spark, sf_dir).where("keep_reason is not null")).select("model", "item_id", "filtered_rate")
    latest = _latest(spark, sf_dir).withColumn("rendered", (F.col("eval_status") != "failed") | (F.col("total") > 0))
    return T.rescore(latest.join(rates, ["model", "item_id"], "left"))


def rescore_buckets(spark, sf_dir):
    """New totals by the rescore's own names of task families."""
    return T.rescore_buckets(_rescored(spark, sf_dir).withColumn("family", taxonomy.rescore_family(F.col("category"))), ["family"])


def tcpool_hardest(spark, sf_dir):
    return T.hardest(_selected(spark, sf_dir))


def tcpool_summary(spark, sf_dir):
    return T.pool_summary(_selected(spark, sf_dir))


def tcpool_item_matrix(spark, sf_dir):
    """All tests of the items, those included that no model ran, and the last outcome of four models."""
    numbers = F.explode(F.split(F.lit("1,2,3,4,5,6,7,8,9"), ",")).alias("test_id")
    cases = table(spark, sf_dir, "part").select((F.col("p_partkey") % 400).cast("string").alias("item_id")).distinct().select("item_id", numbers)
    return T.item_matrix(cases, test_outcomes(spark, sf_dir), ["m1", "m2", "m3", "m4"])


def rescore_records(spark, sf_dir):
    return _rescored(spark, sf_dir).select("line_idx", "model", "item_id", "total", "new_rendering", "new_visual_design", "new_functionality", "new_interaction", "new_code_quality", "new_total", "score_delta")


def rescore_scoreboard(spark, sf_dir):
    return T.scoreboard(_rescored(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def steps_short_circuit(spark, sf_dir):
    """Steps of a case up to its first failure: the case passes if all did; its error is the first failed step."""
    outcomes = test_outcomes(spark, sf_dir)
    cases = outcomes.groupBy("item_id", "model").agg(F.min(F.when(~F.col("passed"), F.col("pos"))).alias("stop"), F.count("*").alias("steps"), F.min_by("test_id", F.when(~F.col("passed"), F.col("pos"))).alias("error"))
    ran = outcomes.join(cases, ["item_id", "model"]).where("stop is null or pos <= stop")
    return ran.groupBy("item_id", "model").agg(F.count("*").alias("ran"), F.max("steps").alias("steps"), F.max(F.col("stop")).isNull().alias("case_passed"), F.max("error").alias("error"))


R = lambda n, d: f"coalesce(({n})::DOUBLE / nullif({d}, 0), 0.0)"
STATS = f"""WITH {OUTCOMES_SQL}, counts AS (SELECT item_id, test_id, count(*) AS observations, count(*) FILTER (passed) AS passed, count(*) FILTER (grp = 'sft') AS sft_observations, count(*) FILTER (grp = 'sft' AND passed) AS sft_passed,
  count(*) FILTER (grp <> 'sft') AS non_sft_observations, count(*) FILTER (grp <> 'sft' AND passed) AS non_sft_passed, count(*) FILTER (model = '{TARGET}') AS target_observations, count(*) FILTER (model = '{TARGET}' AND passed) AS target_passed,
  array_to_string(list_sort(list(DISTINCT grp)), ',') AS groups, coalesce(arg_min(name, pos) FILTER (name <> ''), '') AS name, arg_max(weight, pos) AS weight, min(pos) AS first_pos FROM tc_results GROUP BY item_id, test_id),
stats AS (SELECT *, {R("passed", "observations")} AS p, {R("sft_passed", "sft_observations")} AS s, {R("non_sft_passed", "non_sft_observations")} AS n, {R("target_passed", "target_observations")} AS t FROM counts)"""
SELECTED = f"""{STATS}, reasons AS (SELECT *, p * (1.0::DOUBLE - p) AS disc, observations >= 8 AS enough,
    CASE WHEN observations < 8 OR sft_observations < 8 OR non_sft_observations < 8 THEN '' WHEN s >= 0.40::DOUBLE AND s - n >= 0.25::DOUBLE THEN 'sft_group_contrast' WHEN sft_passed >= 2 AND n <= 0.10::DOUBLE AND p <= 0.12::DOUBLE THEN 'sft_sparse_hard_contrast'
      WHEN target_passed >= 1 AND sft_passed >= 2 AND n <= 0.25::DOUBLE AND p <= 0.20::DOUBLE THEN 'target_sft_supported_contrast' ELSE '' END AS contrast FROM stats),
marked AS (SELECT *, enough AND p > 0.05::DOUBLE AND p < 0.95::DOUBLE AS normal, n - s >= 0.25::DOUBLE AND t < 0.5::DOUBLE AS unfav FROM reasons),
base AS (SELECT *, CASE WHEN contrast <> '' THEN contrast WHEN normal AND NOT unfav THEN 'normal_discriminative' END AS r0 FROM marked),
rescue AS (SELECT *, CASE WHEN r0 IS NULL AND count(r0) OVER (PARTITION BY item_id) = 0 AND row_number() OVER (PARTITION BY item_id ORDER BY enough DESC, disc DESC, observations DESC, first_pos) = 1 THEN 'rescue_item_nonempty' ELSE r0 END AS r1 FROM base),
sides AS (SELECT *, CASE WHEN r1 IS NULL AND enough AND p <= 0.05::DOUBLE THEN 'hard' WHEN r1 IS NULL AND enough AND p >= 0.95::DOUBLE THEN 'easy' END AS side FROM rescue),
c AS (SELECT greatest(0, {COUNT} - count(r1)) AS need, count(*) FILTER (side = 'hard') AS h, count(*) FILTER (side = 'easy') AS e FROM sides),
q1 AS (SELECT *, least(h, CAST(round_even(need * 0.75, 0) AS BIGINT)) AS hq FROM c), q2 AS (SELECT *, least(e, need - hq) AS eq FROM q1), q3 AS (SELECT *, hq + least(h - hq, need - hq - eq) AS hq2 FROM q2),
q AS (SELECT hq2 AS hq, eq + least(e - eq, need - hq2 - eq) AS eq FROM q3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY t DESC, s - n DESC, CASE side WHEN 'hard' THEN sft_passed::DOUBLE ELSE -abs(s - n) END DESC, CASE side WHEN 'hard' THEN -n ELSE observations::DOUBLE END DESC, length(name) DESC, item_id DESC, test_id DESC) AS place FROM sides),
selected AS (SELECT *, coalesce(r1, CASE WHEN side = 'hard' AND place <= (SELECT hq FROM q) THEN 'hard_anchor_counted' WHEN side = 'easy' AND place <= (SELECT eq FROM q) THEN 'easy_anchor_counted' END) AS keep_reason FROM ranked),
final AS (SELECT *, CASE WHEN keep_reason IS NOT NULL THEN NULL WHEN contrast = '' AND normal AND unfav THEN 'sft_unfavorable_removed' WHEN NOT enough THEN 'low_observation' WHEN p <= 0.05::DOUBLE THEN 'near_all_fail' WHEN p >= 0.95::DOUBLE THEN 'near_all_pass' ELSE 'not_selected_for_6000_budget' END AS drop_reason FROM selected)"""
RATES = f"""{SELECTED}, m AS (SELECT tc.*, k.item_id IS NOT NULL AS kept FROM tc_results tc LEFT JOIN (SELECT item_id, test_id FROM final WHERE keep_reason IS NOT NULL) k ON tc.item_id = k.item_id AND tc.test_id = k.test_id),
rates AS (SELECT model, item_id, round_even(sum(weight) FILTER (kept AND passed) / sum(weight) FILTER (kept), 4) AS fr0, sum(weight) FILTER (kept) AS w, count(*) FILTER (kept) AS kept_total, count(*) FILTER (kept AND passed) AS kept_passed, count(*) FILTER (NOT kept) AS dropped_total FROM m GROUP BY 1, 2),
filtered AS (SELECT model, item_id, CASE WHEN w > 0 THEN coalesce(fr0, 0.0) END AS filtered_rate, kept_total, kept_passed, dropped_total FROM rates)"""
SC = lambda v, o, n: f"CAST(greatest(0, least({n}, round_even(greatest(0.0::DOUBLE, coalesce({v}, 0.0)::DOUBLE) / {o} * {n}, 0))) AS BIGINT)"
RESCORED = f"""{RATES}, {RESULTS_SQL}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY line_idx DESC) AS rn FROM results_raw) WHERE rn = 1),
joined AS (SELECT latest.*, coalesce(filtered_rate, test_pass_rate, 0.0) AS r FROM latest LEFT JOIN filtered ON latest.model = filtered.model AND latest.item_id = filtered.item_id),
parts AS (SELECT *, CASE WHEN eval_status <> 'failed' OR total > 0 THEN {SC("least(5.0, rendering)", 5, 10)} ELSE 0 END AS new_rendering, CASE WHEN has_interaction THEN {SC("visual_design", 20, 20)} ELSE {SC("visual_design", 30, 20)} END AS new_visual_design,
  CASE WHEN has_interaction THEN {SC("r", 1, 55)} ELSE {SC("r", 1, 65)} END AS new_functionality, CASE WHEN has_interaction THEN {SC("interaction", 20, 10)} ELSE 0 END AS new_interaction, {SC("code_quality", 10, 5)} AS new_code_quality FROM joined),
rescored AS (SELECT *, greatest(0, least(100, new_rendering + new_visual_design + new_functionality + new_interaction + new_code_quality)) AS new_total FROM parts)"""

RESCORE_FAMILY_SQL = "CASE WHEN category = '' THEN 'unknown' ELSE coalesce(map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in taxonomy.RESCORE_ALIASES.items()) + "}, category), category) END"

ORACLES = {
    "tcpool_stats": f"{STATS} SELECT item_id, test_id, observations, passed, sft_observations, sft_passed, target_observations, target_passed, groups, name, weight, round_even(p, 6) AS pass_rate, round_even(s, 6) AS sft_pass_rate, round_even(n, 6) AS non_sft_pass_rate, round_even(t, 6) AS target_pass_rate, round_even(p * (1.0::DOUBLE - p), 6) AS discrimination FROM stats",
    "tcpool_selection": f"{SELECTED} SELECT item_id, test_id, keep_reason, drop_reason FROM final",
    "tcpool_manifest": f"{SELECTED} SELECT item_id, test_id, name, weight, observations, keep_reason, round_even(p, 4) AS pass_rate, round_even(s, 4) AS sft_pass_rate, round_even(n, 4) AS non_sft_pass_rate, round_even(t, 4) AS target_pass_rate FROM final WHERE keep_reason IS NOT NULL",
    "tcpool_reasons": f"{SELECTED} SELECT CASE WHEN keep_reason IS NOT NULL THEN 'keep' ELSE 'drop' END AS action, coalesce(keep_reason, drop_reason) AS reason, count(*) AS tests, count(DISTINCT item_id) AS items FROM final GROUP BY 1, 2",
    "tcpool_filtered_rates": f"{RATES} SELECT * FROM filtered",
    "tcpool_matrix": f"WITH {OUTCOMES_SQL} SELECT item_id, test_id, " + ", ".join(f"round_even(avg(passed::INT) FILTER (model = 'm{i}'), 3) AS m{i}" for i in (1, 2, 3, 4)) + " FROM tc_results WHERE model IN ('m1', 'm2', 'm3', 'm4') GROUP BY 1, 2",
    "tcpool_group_spread": f"WITH {OUTCOMES_SQL}, m AS (SELECT grp, model, avg(passed::INT) AS r FROM tc_results GROUP BY 1, 2) SELECT grp AS \"group\", count(*) AS models, round_even(avg(r), 4) AS mean_rate, round_even(min(r), 4) AS min_rate, round_even(max(r), 4) AS max_rate, round_even(stddev_samp(r), 4) AS std_rate FROM m GROUP BY 1",
    "tcpool_weighted_rate": f"WITH {OUTCOMES_SQL} SELECT item_id, model, round_even(coalesce(sum(CASE WHEN passed THEN weight ELSE 0.0 END) / nullif(sum(weight), 0), 0.0), 4) AS rate, count(*) AS tests FROM tc_results GROUP BY 1, 2",
    "rescore_records": f"{RESCORED} SELECT line_idx, model, item_id, total, new_rendering, new_visual_design, new_functionality, new_interaction, new_code_quality, new_total, new_total - total AS score_delta FROM rescored",
    "rescore_scoreboard": f"{RESCORED}, b AS (SELECT model, count(*) AS n, round_even(avg(new_total), 1) AS avg_score, round_even(avg(total), 1) AS original_avg_score, round_even(stddev_samp(new_total), 2) AS std_dev FROM rescored GROUP BY model) SELECT *, row_number() OVER (ORDER BY avg_score DESC, model) AS rank, round_even(avg_score - original_avg_score, 1) AS delta_avg_score FROM b",
    "tcpool_hardest": f"""{SELECTED}, k AS (SELECT 'hardest_kept' AS kind, item_id, test_id, observations, round_even(p, 3) AS pass_rate, keep_reason AS reason, round_even(p, 3) AS o, first_pos FROM final WHERE keep_reason IS NOT NULL
        UNION ALL SELECT 'near_all_pass_dropped', item_id, test_id, observations, round_even(p, 3), drop_reason, -round_even(p, 3), first_pos FROM final WHERE drop_reason = 'near_all_pass'),
      n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, observations DESC, first_pos) AS place FROM k) SELECT kind, item_id, test_id, observations, pass_rate, reason, place FROM n WHERE place <= 30""",
    "tcpool_summary": f"""{SELECTED}, i AS (SELECT item_id, count(keep_reason) AS kept, count(*) - count(keep_reason) AS dropped, count(*) FILTER (keep_reason = 'rescue_item_nonempty') AS rescued FROM final GROUP BY item_id)
      SELECT CAST(sum(kept + dropped) AS BIGINT) AS total_tc, CAST(sum(kept) AS BIGINT) AS kept_tc, CAST(sum(dropped) AS BIGINT) AS dropped_tc, CAST(sum(rescued) AS BIGINT) AS rescued_tc, count(*) AS items,
      count(*) FILTER (dropped > 0) AS items_with_drop, count(*) FILTER (rescued > 0) AS items_with_rescue FROM i""",
    "tcpool_item_matrix": f"""WITH {OUTCOMES_SQL}, c AS (SELECT item_id, CAST(t AS VARCHAR) AS test_id FROM (SELECT DISTINCT CAST(p_partkey % 400 AS VARCHAR) AS item_id FROM part), range(1, 10) r(t)),
      w AS (SELECT item_id, test_id, """ + ", ".join(f"arg_max(passed, pos) FILTER (model = 'm{i}') AS m{i}_pass" for i in (1, 2, 3, 4)) + """ FROM tc_results GROUP BY 1, 2)
      SELECT c.item_id, c.test_id, m1_pass, m2_pass, m3_pass, m4_pass FROM c LEFT JOIN w ON c.item_id = w.item_id AND c.test_id = w.test_id""",
    "rescore_buckets": f"""{RESCORED}, f AS (SELECT *, {RESCORE_FAMILY_SQL} AS family, eval_status IN ('completed', 'completed_with_fallback') AS ok FROM rescored)
      SELECT family, count(*) AS total, round_even(avg(new_total), 1) AS avg_score, min(new_total) AS min_score, max(new_total) AS max_score, round_even(quantile_cont(new_total, 0.5), 1) AS median_score, round_even(quantile_cont(new_total, 0.25), 1) AS p25_score,
      round_even(quantile_cont(new_total, 0.75), 1) AS p75_score, round_even(count(*) FILTER (new_total >= 80) / count(*), 3) AS tier_a_pct, round_even(count(*) FILTER (new_total BETWEEN 40 AND 79) / count(*), 3) AS tier_b_pct, round_even(count(*) FILTER (new_total < 40) / count(*), 3) AS tier_c_pct,
      count(*) FILTER (ok) AS completed_total, count(*) FILTER (NOT ok) AS failed_total, round_even(stddev_samp(new_total), 2) AS std_dev, round_even(avg(new_total) FILTER (ok), 1) AS avg_score_completed FROM f GROUP BY family""",
    "steps_short_circuit": f"""WITH {OUTCOMES_SQL}, c AS (SELECT item_id, model, min(pos) FILTER (NOT passed) AS stop, count(*) AS steps, arg_min(test_id, pos) FILTER (NOT passed) AS error FROM tc_results GROUP BY 1, 2)
      SELECT t.item_id, t.model, count(*) AS ran, max(steps) AS steps, max(stop) IS NULL AS case_passed, max(error) AS error FROM tc_results t JOIN c ON t.item_id = c.item_id AND t.model = c.model WHERE stop IS NULL OR pos <= stop GROUP BY 1, 2""",
}
QUERIES = {name: globals()[name] for name in ORACLES}
