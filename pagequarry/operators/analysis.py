"""Analysis of evaluation results: latest-wins scans, score buckets, pass@k, comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import taxonomy

COMPLETED = ("completed", "completed_with_fallback")
TIER_A, TIER_B = 80, 40
DIMENSIONS = ("rendering", "visual_design", "functionality", "interaction", "code_quality")


def latest(rows: DataFrame, keys: list[str], order: str = "line_idx") -> DataFrame:
    """The last row of each key by ``order``; the shuffle carries each task's own last rows only."""
    own = F.max_by(F.struct(*rows.columns), F.col(order)).alias("__row")
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(own).select("__row.*")


def first(rows: DataFrame, keys: list[str], order: str = "line_idx") -> DataFrame:
    own = F.min_by(F.struct(*rows.columns), F.col(order)).alias("__row")
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(own).select("__row.*")


def share(n: Column, of: Column, digits: int) -> Column:
    return F.bround(F.try_divide(n.cast("double"), of), digits)


def nearest_rank(scores: Column, pct: int) -> Column:
    """The element at floor(pct / 100 * n), clamped, of a sorted array; not ``percentile_disc``."""
    n = F.array_size(scores)
    return F.get(scores, F.least(n - 1, F.floor(F.lit(pct / 100) * n)).cast("int")).cast("double")


def bucket(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of statistics per group.

    Median and quartiles of the integer scores come from a histogram of the scores: group and score are aggregated
    first, with map-side sums, so that no group's rows are ever gathered in one task.  Rates are summed as decimals: their sum
    doesn't depend on the order of the rows.
    """
    done = F.col("eval_status").isin(*COMPLETED)
    dims = [x for d in DIMENSIONS for x in (F.sum(d).alias(f"s_{d}"), F.count(d).alias(f"n_{d}"))]
    by_score = rows.groupBy(*keys, "total").agg(
        F.count("*").alias("n"), F.count_if(done).alias("done"), F.sum(F.col("test_pass_rate").cast("decimal(18,6)")).alias("tpr"), F.count("test_pass_rate").alias("tprs"), *dims
    )
    t, n = F.col("total"), F.col("n")
    grouped = by_score.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("done").alias("done"), F.sum(t * n).alias("s"), F.sum(t * t * n).alias("ss"), F.min("total").alias("min_score"), F.max("total").alias("max_score"),
        F.sum(F.when(t >= TIER_A, n).otherwise(0)).alias("a"), F.sum(F.when((t >= TIER_B) & (t < TIER_A), n).otherwise(0)).alias("b"), F.sum(F.when(t < TIER_B, n).otherwise(0)).alias("c"),
        F.sum(t * F.col("done")).alias("sd"), F.sum("tpr").alias("tpr"), F.sum("tprs").alias("tprs"),
        F.array_sort(F.collect_list(F.struct("total", "n"))).alias("all"), F.array_sort(F.collect_list(F.when(F.col("done") > 0, F.struct("total", F.col("done").alias("n"))))).alias("good"),
        *(F.sum(c).alias(c) for d in DIMENSIONS for c in (f"s_{d}", f"n_{d}")),
    )
    size = F.col("n")
    variance = (F.col("ss") - F.col("s") * F.col("s") / size) / (size - 1)
    mid = lambda a, m: F.bround((_at(a, F.floor((m - 1) / 2)) + _at(a, F.floor(m / 2))) / 2, 1)
    return grouped.select(
        *keys, size.alias("total"), share(F.col("s"), size, 1).alias("avg_score"), "min_score", "max_score", mid("all", size).alias("median_score"),
        _at("all", F.least(size - 1, F.floor(F.lit(0.25) * size))).cast("double").alias("p25_score"), _at("all", F.least(size - 1, F.floor(F.lit(0.75) * size))).cast("double").alias("p75_score"),
        share(F.col("done"), size, 3).alias("completion_rate"), share(F.col("a"), size, 3).alias("tier_a_pct"), share(F.col("b"), size, 3).alias("tier_b_pct"), share(F.col("c"), size, 3).alias("tier_c_pct"),
        F.col("done").alias("completed_total"), F.coalesce(share(F.col("sd"), F.nullif(F.col("done"), F.lit(0)), 1), F.lit(0.0)).alias("avg_score_completed"),
        F.when(F.col("done") > 0, mid("good", F.col("done"))).otherwise(0.0).alias("median_score_completed"),
        F.when(size >= 2, F.bround(F.sqrt(F.greatest(variance, F.lit(0.0))), 2)).alias("std_dev"), share(F.col("tpr").cast("double"), F.nullif(F.col("tprs"), F.lit(0)), 3).alias("avg_test_pass_rate"),
        *(share(F.col(f"s_{d}"), F.nullif(F.col(f"n_{d}"), F.lit(0)), 1).alias(f"avg_{d}") for d in DIMENSIONS),
    )


def _at(pairs: str, index: Column) -> Column:
    """The score at a 0-based place, from sorted (score, n) pairs: the first whose running count exceeds the place."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
    step = lambda s, p: F.struct((s["seen"] + p["n"]).alias("seen"), F.coalesce(s["value"], F.when(s["seen"] + p["n"] > index, p["total"])).alias("value"))
    return F.aggregate(F.filter(pairs, lambda p: p.isNotNull()), start, step, lambda s: s["value"])


def with_families(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"family": taxonomy.family(F.col("category")), "source_category": taxonomy.source_category(F.col("category"))})


GROUPINGS = {"category": "family", "source_category": "source_category", "difficulty": "difficulty", "subtype": "sub_type", "language": "language"}


def breakdown(rows: DataFrame) -> DataFrame:
    """Buckets over all rows and by five groupings in one pass: dimension, key and statistics; empty keys only count where they have a name."""
    pairs = [F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("key"))]
    pairs += [F.struct(F.lit(name).alias("dimension"), F.coalesce(F.col(c), F.lit("")).alias("key")) for name, c in GROUPINGS.items()]
    kept = F.filter(F.array(*pairs), lambda p: (p["key"] != "") | p["dimension"].isin("overall", "category", "difficulty"))
    long = with_families(rows).select(F.explode(kept).alias("p"), "total", "eval_status", "test_pass_rate", *DIMENSIONS).select("p.*", "total", "eval_status", "test_pass_rate", *DIMENSIONS)
    return bucket(long, ["dimension", "key"])


def failed_tests(rows: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` most frequent failures: category/item, how often, and the first message; ties by first line."""
    failed = with_families(rows).where("test_pass_rate < 1.0").withColumn("test_id", F.concat_ws("/", "family", "item_id"))
    message = F.format_string("passed %d/%d", "tests_passed", "tests_total")
    counted = failed.groupBy("test_id").agg(F.count("*").alias("frequency"), F.min_by(message, "line_idx").alias("common_error"), F.min("line_idx").alias("first_line"))
    return counted.orderBy(F.desc("frequency"), "first_line").limit(top)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate 1 - C(n - c, k) / C(n, k); with fewer than k trials whether any passed."""
    miss = reduce(lambda a, b: a * b, ((n - c - i).cast("double") / (n - i) for i in range(k)))
    return F.when(n < k, F.when(c > 0, 1.0).otherwise(0.0)).when(c == 0, 0.0).when(c >= n, 1.0).otherwise(1.0 - miss)


def is_pass(threshold: float = 0.8, floor: int = 40) -> Column:
    ok = F.when(F.col("test_pass_rate").isNotNull(), F.col("test_pass_rate") >= threshold).otherwise(F.col("total") >= floor)
    return F.col("eval_status").isin(*COMPLETED) & ok


def trials(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per item: n, c, pass@1, pass@3, the upper median score, and the first trial's family and difficulty."""
    passed = with_families(rows).withColumn("ok", is_pass(threshold))
    scores = F.array_sort(F.collect_list("total"))  # an item's trials are few by nature
    grouped = passed.groupBy("item_id").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("c"), F.get(scores, F.floor(F.count("*") / 2).cast("int")).alias("median_score"), F.min_by(F.struct("family", "difficulty"), "line_idx").alias("m")
    )
    n, c = F.col("n"), F.col("c")
    return grouped.select("item_id", "n", "c", pass_at_k(n, c, 1).alias("p1"), pass_at_k(n, c, 3).alias("p3"), "median_score", F.col("m.family").alias("category"), F.col("m.difficulty").alias("difficulty"))


def trial_summary(items: DataFrame) -> DataFrame:
    """Macro means: overall over rounded rates, by category and difficulty over unrounded pass@1."""
    overall = items.agg(F.bround(F.avg(F.bround("p1", 4)), 4).alias("pass_at_1"), F.bround(F.avg(F.bround("p3", 4)), 4).alias("pass_at_3"), F.count("*").alias("num_items"))
    parts = [overall.select(F.lit("overall").alias("dimension"), F.lit("").alias("key"), "pass_at_1", "pass_at_3", "num_items")]
    for d in ("category", "difficulty"):
        parts.append(items.groupBy(F.col(d).alias("key")).agg(F.bround(F.avg("p1"), 4).alias("pass_at_1"), F.count("*").alias("num_items")).select(F.lit(d).alias("dimension"), "key", "pass_at_1", F.lit(None).cast("double").alias("pass_at_3"), "num_items"))
    return reduce(DataFrame.unionByName, parts)


def snapshot(rows: DataFrame) -> DataFrame:
    """Latest status per item: how many completed, failed and terminal items, and averages over both."""
    now = latest(rows, ["item_id"])
    done, failed = F.col("eval_status").isin(*COMPLETED), F.col("eval_status") == "failed"
    return now.agg(F.count("*").alias("items"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"), F.count_if(done | failed).alias("terminal"), F.bround(F.avg("total"), 2).alias("avg_all"), F.bround(F.avg(F.when(done, F.col("total"))), 2).alias("avg_completed"))


def compare_models(rows: DataFrame, base: str, other: str) -> DataFrame:
    """Averages of two models side by side per family and difficulty, with the difference; a missing side stays null."""
    chosen = with_families(rows).where(F.col("model").isin(base, other))
    long = chosen.select("model", "total", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(c).alias("key")) for d, c in (("category", "family"), ("difficulty", "difficulty"))))).alias("p"))
    side = lambda m: F.bround(F.avg(F.when(F.col("model") == m, F.col("total"))), 1)
    out = long.groupBy("p.dimension", "p.key").agg(side(base).alias("base_avg"), side(other).alias("other_avg"))
    return out.withColumn("delta", F.bround(F.col("other_avg") - F.col("base_avg"), 1))


def run_summary(rows: DataFrame) -> DataFrame:
    done = F.col("eval_status").isin(*COMPLETED)
    return rows.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), F.bround(F.avg(F.when(done, F.col("total"))), 1).alias("avg"), F.min(F.when(done, F.col("total"))).alias("least"), F.max(F.when(done, F.col("total"))).alias("most"))


def live_counters(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Items of ``known`` (item_id) by state: completed, failed, pending."""
    now = latest(rows, ["item_id"]).select("item_id", "eval_status")
    state = F.when(F.col("eval_status").isin(*COMPLETED), "completed").when(F.col("eval_status").isNotNull(), "failed").otherwise("pending")
    return known.join(now, "item_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("items"))
