"""Selection of discriminative test cases from pass statistics, and rescoring with the selected ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import cut
from . import analysis

KEY = ["item_id", "test_id"]
MIN_OBSERVATIONS, LOW, HIGH = 8, 0.05, 0.95
TARGET_COUNT, HARD_RATIO = 6000, 0.75
#: Kept tests (two short strings each) that are broadcast at most.
BROADCAST_TESTS = 250_000


def rate(passed: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(passed.cast("double"), n), F.lit(0.0))


def pass_stats(outcomes: DataFrame, target: str) -> DataFrame:
    """Per (item, test): observations and passes, overall, in the sft group, outside it and of the target model; rates; first name, last weight.

    Outcomes are first aggregated by name, group and target too, in numbers only: sets and names in an aggregate make Spark sort its rows, which
    would be all outcomes.
    """
    by = outcomes.groupBy(*KEY, "group", "name", (F.col("model") == target).alias("own")).agg(
        F.count("*").alias("n"), F.count_if("passed").alias("ok"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.max_by("weight", "pos").alias("weight")
    )
    sft, own, count = F.col("group") == "sft", F.col("own"), lambda c, of: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0))
    stats = by.groupBy(*KEY).agg(
        F.sum("n").alias("observations"), F.sum("ok").alias("passed"), count("n", sft).alias("sft_observations"), count("ok", sft).alias("sft_passed"),
        count("n", ~sft).alias("non_sft_observations"), count("ok", ~sft).alias("non_sft_passed"), count("n", own).alias("target_observations"), count("ok", own).alias("target_passed"),
        F.array_join(F.array_sort(F.collect_set("group")), ",").alias("groups"),  # groups are two
        F.coalesce(F.min_by("name", F.when(F.col("name") != "", F.col("least"))), F.lit("")).alias("name"), F.max_by("weight", "most").alias("weight"), F.min("least").alias("first_pos"),
    )
    p = rate(F.col("passed"), F.col("observations"))
    return stats.withColumns(
        {
            "pass_rate": p, "sft_pass_rate": rate(F.col("sft_passed"), F.col("sft_observations")), "non_sft_pass_rate": rate(F.col("non_sft_passed"), F.col("non_sft_observations")),
            "target_pass_rate": rate(F.col("target_passed"), F.col("target_observations")), "discrimination": p * (F.lit(1.0) - p),
        }
    )


def contrast_reason() -> Column:
    """Why a test that separates the groups is kept although it isn't in the normal band; empty if it isn't."""
    s, n, p = F.col("sft_pass_rate"), F.col("non_sft_pass_rate"), F.col("pass_rate")
    enough = (F.col("observations") >= 8) & (F.col("sft_observations") >= 8) & (F.col("non_sft_observations") >= 8)
    return (
        F.when(~enough, "").when((s >= 0.40) & (s - n >= 0.25), "sft_group_contrast").when((F.col("sft_passed") >= 2) & (n <= 0.10) & (p <= 0.12), "sft_sparse_hard_contrast")
        .when((F.col("target_passed") >= 1) & (F.col("sft_passed") >= 2) & (n <= 0.25) & (p <= 0.20), "target_sft_supported_contrast").otherwise("")
    )


def select(stats: DataFrame, min_observations: int = MIN_OBSERVATIONS, low: float = LOW, high: float = HIGH, target_count: int = TARGET_COUNT, hard_ratio: float = HARD_RATIO) -> DataFrame:
    """``stats`` with keep_reason or drop_reason.

    Kept: discriminative tests, contrast tests, one test for each item that would be empty, and anchors up to
    ``target_count`` by quotas of hard and easy ones, whose shortages fill each other.
    """
    p, enough = F.col("pass_rate"), F.col("observations") >= min_observations
    contrast = contrast_reason()
    unfavourable = (F.col("non_sft_pass_rate") - F.col("sft_pass_rate") >= 0.25) & (F.col("target_pass_rate") < 0.5)
    normal = enough & (p > low) & (p < high)
    marked = stats.withColumn("reason", F.when(contrast != "", contrast).when(normal & ~unfavourable, "normal_discriminative")).withColumn("unfavourable", (contrast == "") & normal & unfavourable)
    best = W.partitionBy("item_id").orderBy(enough.desc(), F.desc("discrimination"), F.desc("observations"), "first_pos")
    whole = W.partitionBy("item_id")
    rescued = marked.withColumn("empty", F.count("reason").over(whole) == 0).withColumn("nth", F.row_number().over(best))
    rescued = rescued.withColumn("reason", F.when(F.col("empty") & (F.col("nth") == 1), "rescue_item_nonempty").otherwise(F.col("reason"))).drop("empty", "nth")
    hard, easy = F.col("reason").isNull() & enough & (p <= low), F.col("reason").isNull() & enough & (p >= high)
    # One row per test, read three times: written once instead of aggregating all outcomes three times.
    sides = cut(rescued.withColumn("side", F.when(hard, "hard").when(easy, "easy")), "test-cases")
    counts = sides.agg(F.count("reason").alias("kept"), F.count_if(F.col("side") == "hard").alias("hards"), F.count_if(F.col("side") == "easy").alias("easies")).first()
    hards, easies = _quotas(max(0, target_count - counts.kept), counts.hards, counts.easies, hard_ratio)
    gap = F.col("sft_pass_rate") - F.col("non_sft_pass_rate")
    ends = {
        "hard": (hards, [F.desc("target_pass_rate"), gap.desc(), F.desc("sft_passed"), F.asc("non_sft_pass_rate"), F.length("name").desc()]),
        "easy": (easies, [F.desc("target_pass_rate"), gap.desc(), F.abs(gap).asc(), F.desc("observations"), F.length("name").desc()]),
    }
    chosen = [
        sides.where(F.col("side") == side).orderBy(*order, F.desc("item_id"), F.desc("test_id")).limit(n).select(*KEY, F.lit(f"{side}_anchor_counted").alias("anchor"))
        for side, (n, order) in ends.items()
    ]
    anchored = sides.join(reduce(DataFrame.unionByName, chosen), KEY, "left").withColumn("keep_reason", F.coalesce("reason", "anchor"))
    drop = F.when(F.col("unfavourable"), "sft_unfavorable_removed").when(~enough, "low_observation").when(p <= low, "near_all_fail").when(p >= high, "near_all_pass").otherwise("not_selected_for_6000_budget")
    return anchored.withColumn("drop_reason", F.when(F.col("keep_reason").isNull(), drop)).drop("reason", "unfavourable", "side", "anchor")


def _quotas(need: int, hards: int, easies: int, ratio: float) -> tuple[int, int]:
    hard = min(hards, round(need * ratio))
    easy = min(easies, need - hard)
    hard += min(hards - hard, need - hard - easy)
    easy += min(easies - easy, need - hard - easy)
    return hard, easy


def manifest(selected: DataFrame) -> DataFrame:
    """Kept tests with reason and rates (4 digits)."""
    r = lambda c: F.bround(c, 4).alias(c)
    return selected.where("keep_reason is not null").select(*KEY, "name", "weight", "observations", "keep_reason", r("pass_rate"), r("sft_pass_rate"), r("non_sft_pass_rate"), r("target_pass_rate"))


def reason_counts(selected: DataFrame) -> DataFrame:
    kept = F.col("keep_reason").isNotNull()
    return selected.groupBy(F.when(kept, "keep").otherwise("drop").alias("action"), F.coalesce("keep_reason", "drop_reason").alias("reason")).agg(F.count("*").alias("tests"), F.countDistinct("item_id").alias("items"))


def filtered_rates(outcomes: DataFrame, kept: DataFrame) -> DataFrame:
    """Per (model, item): the weighted pass rate over kept tests (4 digits), and how many were kept, passed and dropped.

    The kept keys are equal for all models.  They are counted and broadcast, so that no outcome moves to meet them; more than
    ``BROADCAST_TESTS`` join by key, and a key's many outcomes spread by AQE.
    """
    keys = cut(kept.select(*KEY, F.lit(True).alias("kept")), "kept-tests")
    keys = F.broadcast(keys) if keys.limit(BROADCAST_TESTS + 1).count() <= BROADCAST_TESTS else keys
    marked = outcomes.join(keys, KEY, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    k = F.col("kept")
    agg = marked.groupBy("model", "item_id").agg(
        F.sum(F.when(k, F.col("weight"))).alias("w"), F.sum(F.when(k & F.col("passed"), F.col("weight")).otherwise(0.0)).alias("pw"), F.count_if(k).alias("kept_total"), F.count_if(k & F.col("passed")).alias("kept_passed"), F.count_if(~k).alias("dropped_total")
    )
    return agg.select("model", "item_id", F.bround(F.try_divide("pw", "w"), 4).alias("filtered_rate"), "kept_total", "kept_passed", "dropped_total")


def hardest(selected: DataFrame, top: int = 30) -> DataFrame:
    """The ``top`` hardest kept tests and the ``top`` easiest of those dropped because nearly all pass: kind, place and rates (3 digits);
    ties by observations, then by first appearance."""
    p = F.bround("pass_rate", 3)
    both = {"hardest_kept": (F.col("keep_reason").isNotNull(), p), "near_all_pass_dropped": (F.col("drop_reason") == "near_all_pass", -p)}
    out = []
    for kind, (test, order) in both.items():
        rows = selected.where(test).select(F.lit(kind).alias("kind"), *KEY, "observations", p.alias("pass_rate"), F.coalesce("keep_reason", "drop_reason").alias("reason"), order.alias("o"), "first_pos")
        best = rows.orderBy("o", F.desc("observations"), "first_pos").limit(top)
        place = F.row_number().over(W.orderBy("o", F.desc("observations"), "first_pos")).cast("long")
        out.append(best.withColumn("place", place).drop("o", "first_pos"))
    return out[0].unionByName(out[1])


def pool_summary(selected: DataFrame) -> DataFrame:
    """One row: tests kept, dropped and rescued, items with a dropped test and with a rescued one."""
    kept, rescued = F.col("keep_reason").isNotNull(), F.coalesce(F.col("keep_reason") == "rescue_item_nonempty", F.lit(False))
    items = selected.groupBy("item_id").agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), F.count_if(rescued).alias("rescued"))
    return items.agg(
        F.sum(F.col("kept") + F.col("dropped")).alias("total_tc"), F.sum("kept").alias("kept_tc"), F.sum("dropped").alias("dropped_tc"), F.sum("rescued").alias("rescued_tc"),
        F.count("*").alias("items"), F.count_if(F.col("dropped") > 0).alias("items_with_drop"), F.count_if(F.col("rescued") > 0).alias("items_with_rescue"),
    )


def item_matrix(cases: DataFrame, outcomes: DataFrame, models: list[str]) -> DataFrame:
    """``cases`` (item_id, test_id, ...) with a column per model: whether its last outcome of the test passed; null where it never ran."""
    chosen = outcomes.where(F.col("model").isin(*models))
    wide = chosen.groupBy(*KEY).agg(*(F.max_by("passed", F.when(F.col("model") == m, F.col("pos"))).alias(f"{m}_pass") for m in models))
    return cases.join(wide, KEY, "left")


def pass_matrix(outcomes: DataFrame, models: list[str]) -> DataFrame:
    """One row per (item, test), one column per model: passes over observations (3 digits), null where a model has none."""
    chosen = outcomes.where(F.col("model").isin(*models))
    return chosen.groupBy(*KEY).pivot("model", models).agg(F.bround(F.avg(F.col("passed").cast("int")), 3))


def scale(value: Column, old: int, new: int) -> Column:
    """clamp(round(value / old * new)), 0 where either maximum is 0."""
    if not old or not new:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(new), F.bround(F.greatest(F.lit(0.0), F.coalesce(value.cast("double"), F.lit(0.0))) / old * new))).cast("long")


def rescore(rows: DataFrame) -> DataFrame:
    """New totals from old components: scaled budgets, functionality linear in ``filtered_rate`` (the old rate where null);
    no rendering points for pages that weren't rendered."""
    r = F.coalesce("filtered_rate", "test_pass_rate", F.lit(0.0))
    it = F.col("has_interaction")
    rendering = F.when(F.col("rendered"), scale(F.least(F.lit(5.0), F.col("rendering").cast("double")), 5, 10)).otherwise(F.lit(0).cast("long"))
    visual = F.when(it, scale(F.col("visual_design"), 20, 20)).otherwise(scale(F.col("visual_design"), 30, 20))
    functionality = F.when(it, scale(r, 1, 55)).otherwise(scale(r, 1, 65))
    interaction = F.when(it, scale(F.col("interaction"), 20, 10)).otherwise(F.lit(0).cast("long"))
    code = scale(F.col("code_quality"), 10, 5)
    new = rows.withColumns({"new_rendering": rendering, "new_visual_design": visual, "new_functionality": functionality, "new_interaction": interaction, "new_code_quality": code})
    total = reduce(lambda a, b: a + b, (F.col(f"new_{d}") for d in ("rendering", "visual_design", "functionality", "interaction", "code_quality")))
    scored = new.withColumn("new_total", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long"))
    return scored.withColumn("score_delta", F.col("new_total") - F.col("total"))


def rescore_buckets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of new totals per group; quartiles by linear interpolation between the scores at (n - 1) p, from a histogram."""
    done = F.col("eval_status").isin(*analysis.COMPLETED)
    by_score = rows.groupBy(*keys, F.col("new_total").alias("total")).agg(F.count("*").alias("n"), F.count_if(done).alias("done"))
    t, n, size = F.col("total"), F.col("n"), F.col("size")
    grouped = by_score.groupBy(*keys).agg(
        F.sum("n").alias("size"), F.sum("done").alias("completed_total"), F.sum(t * n).alias("s"), F.sum(t * t * n).alias("ss"), F.sum(t * F.col("done")).alias("sd"), F.min("total").alias("min_score"), F.max("total").alias("max_score"),
        F.sum(F.when(t >= 80, n).otherwise(0)).alias("a"), F.sum(F.when((t >= 40) & (t < 80), n).otherwise(0)).alias("b"), F.sum(F.when(t < 40, n).otherwise(0)).alias("c"), F.array_sort(F.collect_list(F.struct("total", "n"))).alias("all"),
    )

    def linear(p: float) -> Column:
        k = (size - 1) * F.lit(p)
        low, high = F.floor(k), F.ceil(k)
        x, y = analysis._at("all", low).cast("double"), analysis._at("all", high).cast("double")
        return F.bround(F.when(low == high, x).otherwise(x * (high - k) + y * (k - low)), 1)

    share = analysis.share
    variance = (F.col("ss") - F.col("s") * F.col("s") / size) / (size - 1)
    return grouped.select(
        *keys, size.alias("total"), share(F.col("s"), size, 1).alias("avg_score"), "min_score", "max_score", linear(0.5).alias("median_score"), linear(0.25).alias("p25_score"), linear(0.75).alias("p75_score"),
        share(F.col("a"), size, 3).alias("tier_a_pct"), share(F.col("b"), size, 3).alias("tier_b_pct"), share(F.col("c"), size, 3).alias("tier_c_pct"), "completed_total", (size - F.col("completed_total")).alias("failed_total"),
        F.when(size >= 2, F.bround(F.sqrt(F.greatest(variance, F.lit(0.0))), 2)).alias("std_dev"), F.when(F.col("completed_total") > 0, share(F.col("sd"), F.col("completed_total"), 1)).alias("avg_score_completed"),
    )


def scoreboard(rows: DataFrame) -> DataFrame:
    """Models by their new average, ranked; ties by name.  There is one row per model."""
    by = rows.groupBy("model").agg(F.count("*").alias("n"), F.bround(F.avg("new_total"), 1).alias("avg_score"), F.bround(F.avg("total"), 1).alias("original_avg_score"), F.bround(F.stddev_samp("new_total"), 2).alias("std_dev"))
    ranked = by.withColumn("rank", F.row_number().over(W.orderBy(F.desc("avg_score"), "model")))
    return ranked.withColumn("delta_avg_score", F.bround(F.col("avg_score") - F.col("original_avg_score"), 1))


def group_spread(outcomes: DataFrame) -> DataFrame:
    """Mean, least and greatest model pass rate of each group, and their spread."""
    models = outcomes.groupBy("group", "model").agg(F.avg(F.col("passed").cast("int")).alias("r"))
    r = lambda c, name: F.bround(c, 4).alias(name)
    return models.groupBy("group").agg(F.count("*").alias("models"), r(F.avg("r"), "mean_rate"), r(F.min("r"), "min_rate"), r(F.max("r"), "max_rate"), r(F.stddev_samp("r"), "std_rate"))
