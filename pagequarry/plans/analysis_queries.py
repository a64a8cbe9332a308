"""Queries over evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.taxonomy import FAMILY_SQL, SOURCE_SQL
from ..operators import analysis as A
from ..sources.tables import RESULTS_SQL, positions, results, table

KEYS = ["trial", "item_id"]


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(results(spark, sf_dir), KEYS)


def results_latest_wins(spark, sf_dir):
    return _latest(spark, sf_dir).select("line_idx", "trial", "item_id", "eval_status", "total", "category")


def results_first_wins(spark, sf_dir):
    return A.first(results(spark, sf_dir), ["item_id"]).select("line_idx", "item_id", "eval_status", "total")


def analysis_bucket_by_family(spark, sf_dir):
    return A.bucket(A.with_families(_latest(spark, sf_dir)), ["family"])


def analysis_breakdown(spark, sf_dir):
    return A.breakdown(_latest(spark, sf_dir))


def analysis_failed_tests(spark, sf_dir):
    return A.failed_tests(_latest(spark, sf_dir))


def analysis_trials(spark, sf_dir):
    return A.trials(_latest(spark, sf_dir)).withColumns({"p1": F.bround("p1", 4), "p3": F.bround("p3", 4)})


def analysis_trial_summary(spark, sf_dir):
    return A.trial_summary(A.trials(_latest(spark, sf_dir)))


def analysis_snapshot(spark, sf_dir):
    return A.snapshot(results(spark, sf_dir))


def analysis_compare_models(spark, sf_dir):
    return A.compare_models(_latest(spark, sf_dir), "m1", "m2")


def analysis_run_summary(spark, sf_dir):
    return A.run_summary(results(spark, sf_dir))


def analysis_live_counters(spark, sf_dir):
    return A.live_counters(results(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id")))


def analysis_top_subtypes(spark, sf_dir):
    """The ten sub-types with the best averages."""
    return A.bucket(_latest(spark, sf_dir), ["sub_type"]).select("sub_type", "total", "avg_score").orderBy(F.desc("avg_score"), "sub_type").limit(10)


def resume_pending(spark, sf_dir):
    """Records without a successful result: what a resumed run still has to do."""
    done = results(spark, sf_dir).where(F.col("eval_status").isin(*A.COMPLETED)).select("item_id").distinct()
    todo = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), "c_mktsegment")
    return todo.join(done, "item_id", "left_anti")


def shard_slices(spark, sf_dir):
    """Contiguous shards of the records in file order, ceil(n / 8) each, with their sizes and contents."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per = -(-orders.count() // 8)
    shard = F.floor(F.col("row_idx") / per).cast("long").alias("shard_id")
    return positions(orders).groupBy(shard).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.sum("o_custkey").alias("customers"))


def category_filter(spark, sf_dir):
    """Records of two requested categories, one family and one legacy name."""
    from ..functions import taxonomy

    rows = results(spark, sf_dir)
    return rows.where(taxonomy.matches(F.col("category"), F.lit(None).cast("string"), "apps_tools, landing")).groupBy("category", "language", "difficulty").agg(F.count("*").alias("n"))


def record_pages(spark, sf_dir):
    """A viewer's page: filtered by score and status, sorted by score, with offset and limit."""
    rows = _latest(spark, sf_dir).where("total between 20 and 60 and eval_status = 'completed'")
    return rows.select("line_idx", "item_id", "trial", "total").orderBy("total", "line_idx").offset(20).limit(25)


def dataset_facets(spark, sf_dir):
    return A.with_families(results(spark, sf_dir)).groupBy("family", "difficulty").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


def jsonl_round_trip(spark, sf_dir):
    """Result records as JSON lines and back: scores nested, status and metadata beside them."""
    score = F.struct("total", *A.DIMENSIONS, "test_pass_rate")
    lines = results(spark, sf_dir).select(F.to_json(F.struct(F.col("item_id").alias("line_number"), "trial", "eval_status", score.alias("score"))).alias("value"))
    parsed = lines.select(F.from_json("value", "line_number string, trial long, eval_status string, score struct<total:long, rendering:long, test_pass_rate:double>").alias("r"))
    return parsed.groupBy("r.eval_status", "r.trial").agg(F.count("*").alias("n"), F.sum("r.score.total").alias("total"), F.sum("r.score.rendering").alias("rendering"), F.count("r.score.test_pass_rate").alias("rated"))


FAMILY, SOURCE = FAMILY_SQL.format(c="category"), SOURCE_SQL.format(c="category")
LATEST = f"""WITH {RESULTS_SQL}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY line_idx DESC) AS rn FROM results_raw) WHERE rn = 1),
fam AS (SELECT *, {FAMILY} AS family, {SOURCE} AS source_category FROM latest)"""
OK = "eval_status IN ('completed', 'completed_with_fallback')"
STATS = f"""count(*) AS total, round_even(avg(t), 1) AS avg_score, min(t) AS min_score, max(t) AS max_score, round_even(quantile_cont(t, 0.5), 1) AS median_score,
  CAST(list_extract(list_sort(list(t)), CAST(least(count(*) - 1, floor(0.25 * count(*))) AS INT) + 1) AS DOUBLE) AS p25_score,
  CAST(list_extract(list_sort(list(t)), CAST(least(count(*) - 1, floor(0.75 * count(*))) AS INT) + 1) AS DOUBLE) AS p75_score,
  round_even(count(*) FILTER (ok) / count(*), 3) AS completion_rate, round_even(count(*) FILTER (t >= 80) / count(*), 3) AS tier_a_pct,
  round_even(count(*) FILTER (t >= 40 AND t < 80) / count(*), 3) AS tier_b_pct, round_even(count(*) FILTER (t < 40) / count(*), 3) AS tier_c_pct,
  count(*) FILTER (ok) AS completed_total, coalesce(round_even(avg(t) FILTER (ok), 1), 0.0) AS avg_score_completed, coalesce(round_even(quantile_cont(t, 0.5) FILTER (ok), 1), 0.0) AS median_score_completed,
  round_even(stddev_samp(t), 2) AS std_dev, round_even(CAST(sum(CAST(test_pass_rate AS DECIMAL(18, 6))) AS DOUBLE) / count(test_pass_rate), 3) AS avg_test_pass_rate, round_even(avg(rendering), 1) AS avg_rendering, round_even(avg(visual_design), 1) AS avg_visual_design,
  round_even(avg(functionality), 1) AS avg_functionality, round_even(avg(interaction), 1) AS avg_interaction, round_even(avg(code_quality), 1) AS avg_code_quality"""
FLAT = f"SELECT *, total AS t, {OK} AS ok FROM fam"
TRIALS = f"""trials AS (SELECT item_id, count(*) AS n, count(*) FILTER ({OK} AND CASE WHEN test_pass_rate IS NOT NULL THEN test_pass_rate >= 0.8 ELSE total >= 40 END) AS c,
  list_extract(list_sort(list(total)), CAST(floor(count(*) / 2) AS INT) + 1) AS median_score, arg_min(family, line_idx) AS category, arg_min(difficulty, line_idx) AS difficulty FROM fam GROUP BY item_id),
rates AS (SELECT *, CASE WHEN c = 0 THEN 0.0 WHEN c >= n THEN 1.0 ELSE 1.0 - (n - c)::DOUBLE / n END AS p1,
  CASE WHEN n < 3 THEN CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END WHEN c = 0 THEN 0.0 WHEN c >= n THEN 1.0 ELSE 1.0 - ((n - c)::DOUBLE / n) * ((n - c - 1)::DOUBLE / (n - 1)) * ((n - c - 2)::DOUBLE / (n - 2)) END AS p3 FROM trials)"""

ORACLES = {
    "results_latest_wins": f"{LATEST} SELECT line_idx, trial, item_id, eval_status, total, category FROM latest",
    "results_first_wins": f"WITH {RESULTS_SQL} SELECT min(line_idx) AS line_idx, item_id, arg_min(eval_status, line_idx) AS eval_status, arg_min(total, line_idx) AS total FROM results_raw GROUP BY item_id",
    "analysis_bucket_by_family": f"{LATEST}, flat AS ({FLAT}) SELECT family, {STATS} FROM flat GROUP BY family",
    "analysis_breakdown": f"""{LATEST}, flat AS ({FLAT}), long AS (SELECT 'overall' AS dimension, '' AS key, * FROM flat UNION ALL SELECT 'category', family, * FROM flat UNION ALL SELECT 'source_category', source_category, * FROM flat WHERE source_category <> ''
      UNION ALL SELECT 'difficulty', difficulty, * FROM flat UNION ALL SELECT 'subtype', sub_type, * FROM flat WHERE sub_type <> '' UNION ALL SELECT 'language', language, * FROM flat WHERE language <> '') SELECT dimension, key, {STATS} FROM long GROUP BY dimension, key""",
    "analysis_failed_tests": f"""{LATEST} SELECT family || '/' || item_id AS test_id, count(*) AS frequency, arg_min('passed ' || tests_passed || '/' || tests_total, line_idx) AS common_error, min(line_idx) AS first_line
      FROM fam WHERE test_pass_rate < 1.0 GROUP BY 1 ORDER BY frequency DESC, first_line LIMIT 20""",
    "analysis_trials": f"{LATEST}, {TRIALS} SELECT item_id, n, c, round_even(p1, 4) AS p1, round_even(p3, 4) AS p3, median_score, category, difficulty FROM rates",
    "analysis_trial_summary": f"""{LATEST}, {TRIALS} SELECT 'overall' AS dimension, '' AS key, round_even(avg(round_even(p1, 4)), 4) AS pass_at_1, round_even(avg(round_even(p3, 4)), 4) AS pass_at_3, count(*) AS num_items FROM rates
      UNION ALL SELECT 'category', category, round_even(avg(p1), 4), NULL, count(*) FROM rates GROUP BY category UNION ALL SELECT 'difficulty', difficulty, round_even(avg(p1), 4), NULL, count(*) FROM rates GROUP BY difficulty""",
    "analysis_snapshot": f"""WITH {RESULTS_SQL}, now AS (SELECT item_id, arg_max(eval_status, line_idx) AS eval_status, arg_max(total, line_idx) AS total FROM results_raw GROUP BY item_id)
      SELECT count(*) AS items, count(*) FILTER ({OK}) AS completed, count(*) FILTER (eval_status = 'failed') AS failed, count(*) AS terminal, round_even(avg(total), 2) AS avg_all, round_even(avg(total) FILTER ({OK}), 2) AS avg_completed FROM now""",
    "analysis_compare_models": f"""{LATEST}, long AS (SELECT 'category' AS dimension, family AS key, model, total FROM fam UNION ALL SELECT 'difficulty', difficulty, model, total FROM fam),
      sides AS (SELECT dimension, key, round_even(avg(total) FILTER (model = 'm1'), 1) AS base_avg, round_even(avg(total) FILTER (model = 'm2'), 1) AS other_avg FROM long WHERE model IN ('m1', 'm2') GROUP BY 1, 2)
      SELECT *, round_even(other_avg - base_avg, 1) AS delta FROM sides""",
    "analysis_run_summary": f"WITH {RESULTS_SQL} SELECT count(*) AS total, count(*) FILTER ({OK}) AS completed, count(*) FILTER (NOT {OK}) AS failed, round_even(avg(total) FILTER ({OK}), 1) AS avg, min(total) FILTER ({OK}) AS least, max(total) FILTER ({OK}) AS most FROM results_raw",
    "analysis_live_counters": f"""WITH {RESULTS_SQL}, now AS (SELECT item_id, arg_max(eval_status, line_idx) AS eval_status FROM results_raw GROUP BY item_id)
      SELECT CASE WHEN {OK} THEN 'completed' WHEN eval_status IS NOT NULL THEN 'failed' ELSE 'pending' END AS state, count(*) AS items FROM customer LEFT JOIN now ON CAST(c_custkey AS VARCHAR) = item_id GROUP BY 1""",
    "analysis_top_subtypes": f"{LATEST} SELECT sub_type, count(*) AS total, round_even(avg(latest.total), 1) AS avg_score FROM latest GROUP BY sub_type ORDER BY avg_score DESC, sub_type LIMIT 10",
    "resume_pending": f"WITH {RESULTS_SQL} SELECT CAST(c_custkey AS VARCHAR) AS item_id, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT item_id FROM results_raw WHERE {OK})",
    "shard_slices": "WITH s AS (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) AS per FROM orders), r AS (SELECT *, row_number() OVER () - 1 AS i FROM orders) SELECT i // per AS shard_id, count(*) AS n, min(o_orderkey) AS low, CAST(sum(o_custkey) AS BIGINT) AS customers FROM r, s GROUP BY 1",
    "category_filter": f"WITH {RESULTS_SQL} SELECT category, language, difficulty, count(*) AS n FROM results_raw WHERE {FAMILY} = 'apps_tools' OR {SOURCE} = 'landing' GROUP BY ALL",
    "record_pages": f"{LATEST} SELECT line_idx, item_id, trial, total FROM latest WHERE total BETWEEN 20 AND 60 AND eval_status = 'completed' ORDER BY total, line_idx LIMIT 25 OFFSET 20",
    "dataset_facets": f"WITH {RESULTS_SQL} SELECT {FAMILY} AS family, difficulty, count(*) AS n, count(DISTINCT item_id) AS items FROM results_raw GROUP BY 1, 2",
    "jsonl_round_trip": f"WITH {RESULTS_SQL} SELECT eval_status, trial, count(*) AS n, CAST(sum(total) AS BIGINT) AS total, CAST(sum(rendering) AS BIGINT) AS rendering, count(test_pass_rate) AS rated FROM results_raw GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLES}
