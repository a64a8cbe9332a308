"""Benchmark items beside results, responses and repairs: metadata, cached responses, payloads, training pairs, editions in sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.html import extract

#: Fields of an item that results carry.
META = ("category", "sub_type", "difficulty", "language")


def normalized(items: DataFrame) -> DataFrame:
    """Items with the family as their category (unless it is unknown) and the older category as source_category, if there is one."""
    given = F.col("source_category") if "source_category" in items.columns else F.lit(None).cast("string")
    source, family = taxonomy.source_category(F.col("category"), given), taxonomy.family(F.col("category"))
    category = F.when(family != "unknown", family).otherwise(F.col("category"))
    return items.withColumns({"source_category": F.coalesce(given, F.nullif(source, F.lit(""))), "category": category})


def as_records(items: DataFrame) -> DataFrame:
    """(line_number, data, metadata) of items: data holds the two messages of a dialogue."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    messages = F.array(message("user", F.col("prompt")), message("assistant", F.col("response")))
    return items.select(F.col("item_id").alias("line_number"), F.struct(messages.alias("messages")).alias("data"), *META)


def with_metadata(results: DataFrame, items: DataFrame) -> DataFrame:
    """Results with the metadata of their items where they have none; family and source category; ``unknown`` or empty where neither does.

    A result's empty sub-type counts as none.  Results without an item stay.
    """
    own = items.select(F.col("item_id").alias("__item"), *(F.col(c).alias(f"__{c}") for c in (*META, "source_category")))
    joined = results.join(own, F.col("item_id") == F.col("__item"), "left")
    raw = F.coalesce("category", "__category", F.lit("unknown"))
    filled = {
        "category": taxonomy.family(raw), "source_category": taxonomy.source_category(raw, F.coalesce("source_category", "__source_category", F.lit(""))),
        "difficulty": F.coalesce("difficulty", "__difficulty", F.lit("unknown")), "language": F.coalesce("language", "__language", F.lit("")),
        "sub_type": F.coalesce(F.nullif(F.col("sub_type"), F.lit("")), F.col("__sub_type"), F.lit("")),
    }
    return joined.withColumns(filled).drop("__item", *(f"__{c}" for c in (*META, "source_category")))


def prompt_compatible(item: Column, record: Column) -> Column:
    """Whether a cached response still fits an item: its prompt is equal, or the item has none."""
    return item.isNull() | F.coalesce(item == record, F.lit(False))


def is_valid(response: Column) -> Column:
    return (F.coalesce(response, F.lit("")) != "") & extract(response, False).isNotNull()


def merge_checkpoint(items: DataFrame, checkpoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, prompt, response) with the last valid response (id, prompt, response, line_idx) of a checkpoint where they have no
    valid one of their own and the prompt is still the same; and one row of counts: merged, invalid, prompt_mismatch."""
    named = checkpoint.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("response", F.lit("")) != "")).withColumn("valid", is_valid(F.col("response")))
    last = named.where("valid").groupBy("id").agg(F.max_by(F.struct("prompt", "response"), "line_idx").alias("c"))
    joined = items.join(last, items["item_id"] == last["id"], "left")
    wanted = F.col("c").isNotNull() & ~is_valid(items["response"])
    fits = prompt_compatible(items["prompt"], F.col("c.prompt"))
    state = F.when(wanted & fits, "merged").when(wanted, "prompt_mismatch")
    response = F.when(state == "merged", F.col("c.response")).otherwise(items["response"])
    merged = joined.select("item_id", items["prompt"], response.alias("response"), state.alias("state"))
    counts = merged.agg(F.count_if(F.col("state") == "merged").alias("merged"), F.count_if(F.col("state") == "prompt_mismatch").alias("prompt_mismatch"))
    # Both sides are one row.
    return merged, counts.crossJoin(F.broadcast(named.agg(F.count_if(~F.col("valid")).alias("invalid"))))


def score_payload(total: Column, dimensions: dict[str, Column], reasons: dict[str, Column], lists: dict[str, Column]) -> Column:
    """A score as JSON: total and dimensions, reasons that aren't empty, lists that aren't empty; nulls are left out."""
    own = [total.alias("total"), *(c.alias(n) for n, c in dimensions.items())]
    own += [F.nullif(c, F.lit("")).alias(f"{n}_reason") for n, c in reasons.items()]
    own += [F.when(F.size(c) > 0, c).alias(n) for n, c in lists.items()]
    return F.to_json(F.struct(*own), {"ignoreNullFields": "true"})


def json_text(value: dict | Column) -> Column:
    """A value as JSON with sorted keys and a blank behind commas and colons; dicts nest, nulls stay."""
    if isinstance(value, dict):
        parts = [F.concat(F.lit(f'"{k}": '), json_text(v)) for k, v in sorted(value.items())]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    # A struct of one field, without what stands around the field's value.
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def fingerprint(payload: dict) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of a nested payload of columns as JSON in the order of its names."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(json_text(payload), 256), 1, 16))


def inconsistent(dimensions: list[Column], highlights: Column) -> Column:
    """Whether a scorer contradicts itself: every score is 0 although it names highlights."""
    zero = F.lit(True)
    for d in dimensions:
        zero = zero & (F.coalesce(d, F.lit(0)) == 0)
    return zero & (F.size(highlights) > 0)


def dimension_deltas(before: Column, after: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*((after[n] - before[n]).alias(n) for n in names))


#: Points over which a gain is told with its size, and what is said of smaller ones.
GAIN, REMAINS = 5, "Most issues persist — this iteration made minimal progress; try a different approach"


def iteration_summary(delta: Column, success: Column) -> Column:
    """What improved after an iteration of a repair, and what remains (null where it gained or failed)."""
    rose, minor = F.format_string("Score rose by %d points", delta), F.format_string("Minor improvement (+%d)", delta)
    improved = F.when(delta > GAIN, rose).when(delta > 0, minor).otherwise("No improvement")
    return F.struct(improved.alias("what_improved"), F.when((delta < GAIN) & success, REMAINS).alias("what_remains"))


def preference_pairs(traces: DataFrame, best: str, original: str, gate: int = 80, gain: int = 1) -> DataFrame:
    """(query, chosen, rejected) of repairs that ended at ``gate`` at least and gained; a page that stayed the same is no pair."""
    kept = traces.where((F.col("final_score") >= gate) & (F.col("final_score") - F.col("original_score") >= gain) & (F.col(best) != F.col(original)))
    return kept.select("query", F.col(best).alias("chosen"), F.col(original).alias("rejected"))


def repair_list(tiered: DataFrame, limit: int = 0, include_c: bool = False) -> DataFrame:
    """Records to repair: those of tier B by line, then, if wanted, those of tier C; of the whole list the first ``limit``, if there is one."""
    rows = tiered.where(F.col("tier").isin("B", *(["C"] if include_c else [])))
    return rows.orderBy("tier", "line_idx").limit(limit) if limit else rows


def viewer_records(results: DataFrame, reports: DataFrame, repairs: DataFrame, refines: DataFrame, improves: DataFrame) -> DataFrame:
    """Records for a viewer: uid, place (in the results' order), dataset, query, score, has_html, has_repair, repair_delta, has_refine, refine_delta, has_improve.

    A test's report (uid, style ``test``, score) tells the repair's delta first; then a repair trace (uid, improvement) with a report of
    style ``repair``: its improvement if that is positive, else the report's score; then an improve trace.  Each side has one row per uid
    (and style).  Unknown scores and missing repairs have a delta of 0.
    """
    side = lambda df, name: df.select(F.col("uid").alias(f"__{name}"), F.col("improvement").alias(name))
    told = lambda style: reports.where(F.col("style") == style).select(F.col("uid").alias(f"__{style}"), F.col("score").alias(f"{style}_score"))
    joined = results
    for name, right in (("test", told("test")), ("again", told("repair").withColumnRenamed("__repair", "__again")), ("repair", side(repairs, "repair")), ("refine", side(refines, "refine")), ("improve", side(improves, "improve"))):
        joined = joined.join(right, joined["uid"] == right[f"__{name}"], "left")
    there = lambda name: F.col(f"__{name}").isNotNull()
    traced = there("repair") & there("again")
    gained = lambda score: F.coalesce(F.col(score) - F.col("score"), F.lit(0))
    delta = (
        F.when(there("test"), gained("test_score")).when(traced & (F.col("repair") > 0), F.col("repair")).when(traced, gained("repair_score"))
        .when(there("improve"), F.col("improve")).otherwise(0)
    )
    return joined.select(
        "uid", "place", "dataset", "query", "score", "has_html", (there("test") | traced | there("improve")).alias("has_repair"), delta.cast("long").alias("repair_delta"), there("refine").alias("has_refine"),
        F.coalesce("refine", F.lit(0)).cast("long").alias("refine_delta"), there("improve").alias("has_improve"),
    )


def searched(records: DataFrame, text: str) -> DataFrame:
    """Records whose id holds ``text`` or whose query does, whatever its case."""
    return records.where(F.contains("uid", F.lit(text)) | F.contains(F.lower("query"), F.lit(text.lower())))


def page(
    records: DataFrame, order: str = "score_asc", number: int = 0, limit: int = 80, low: int = 0, high: int = 100, repaired: bool = False, refined: bool = False, dataset: str = "all", with_html: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A page of the records with a score from ``low`` to ``high`` (of one dataset, with a page, repaired or refined, if asked), in one of four
    orders, of equal ones by their place in the results, and by uid where places are equal too, so that a record is on one page whatever the
    partitions; and one row with how many there are in all."""
    kept = records.where(F.col("score").between(low, high))
    for use, test in ((with_html, F.col("has_html")), (dataset != "all", F.col("dataset") == dataset), (repaired, F.col("has_repair")), (refined, F.col("has_refine"))):
        kept = kept.where(test) if use else kept
    columns = {"score_asc": ["score"], "score_desc": [F.desc("score")], "uid_asc": ["uid"], "dataset_asc": ["dataset", "score"]}
    return kept.orderBy(*columns.get(order, ["score"]), "place", "uid").offset(number * limit).limit(limit), kept.agg(F.count("*").alias("total"))


#: How long (ms) a page settles after an action: actions, the part of their timeout, the least and the most; last: all others.
SETTLE = (
    (("hover", "focus", "contextmenu"), 30, 40, 80), (("type", "press_key", "scroll", "eval_js"), 16, 70, 160),
    (("click", "click_text", "select_option", "check", "drag"), 10, 120, 240), ((), 20, 50, 120),
)


def settle_window(action: Column, timeout: Column) -> Column:
    """A share of a step's timeout, held within its action's limits."""
    held = lambda part, low, high: F.least(F.lit(high), F.greatest(F.lit(low), F.floor(timeout / part))).cast("long")
    name = F.lower(F.coalesce(action, F.lit("")))
    return F.coalesce(*(F.when(name.isin(*names), held(*rest)) for names, *rest in SETTLE[:-1]), held(*SETTLE[-1][1:]))


def selected(items: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` that ``selection`` (distinct keys) names; ValueError with an example if it names one that isn't there."""
    wanted = selection.select(*keys).distinct()
    lost = wanted.join(items.select(*keys), keys, "left_anti").first()
    if lost is not None:
        raise ValueError(f"the selection names an item that isn't there: {lost.asDict()}")
    return items.join(wanted, keys, "left_semi")


def only(items: DataFrame, ids: str | None, limit: int | None, order: str) -> DataFrame:
    """Items whose id is in a comma-separated list (all if there is none), at most ``limit`` of them in order."""
    wanted = [i.strip() for i in (ids or "").split(",") if i.strip()]
    kept = items.where(F.col("item_id").isin(*wanted)) if wanted else items
    return kept.orderBy(order).limit(limit) if limit else kept


def phase_gates(has_cases: Column, has_page: Column, rendered: Column, agent_on: Column) -> Column:
    """Which phases of an evaluation run: tests need test cases and a page, rendering a page, the agent a page that isn't known to be blank."""
    known = F.coalesce(rendered, F.lit(True))
    return F.struct((has_cases & has_page).alias("tests"), has_page.alias("render"), (agent_on & has_page & known).alias("agent"))


def stamped(rows: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """Rows with constant columns of a run."""
    return rows.withColumns({k: F.lit(v) for k, v in metadata.items()})


def coverage(rows: DataFrame, items: int) -> DataFrame:
    """One row over runs (model, item_id): the least and largest share of items in percent that a run covers, and all values (3 digits) in order."""
    per = rows.groupBy("model").agg(F.countDistinct("item_id").alias("n")).select(F.bround(F.col("n") * 100.0 / items, 3).alias("pct"))
    # One row per run.
    return per.agg(F.min("pct").alias("least"), F.max("pct").alias("most"), F.array_join(F.transform(F.array_sort(F.collect_set("pct")), lambda x: x.cast("string")), ",").alias("pcts"))


def write_by_file(rows: DataFrame, path: str, file: str = "file", order: str = "position", value: str = "value") -> None:
    """Writes lines back to a folder per source file, each in its own order; a file's lines are one task's, as they were one file."""
    rows.repartition(file).sortWithinPartitions(file, order).select(file, value).write.partitionBy(file).text(path)


def difficulty_order(difficulty: Column) -> Column:
    return F.when(difficulty == "easy", 0).when(difficulty == "medium", 1).when(difficulty == "hard", 2).otherwise(3)
