"""Repair decisions from diagnoses, and analysis of recorded repair traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Largest scores of the dimensions in diagnoses, and the limits below which a good page is refined.
MAXIMA = {"visual_design": 20, "interaction": 25, "functionality": 25, "code_quality": 10}
LIMITS = {"visual_design": (17, 16), "interaction": (21, 20), "functionality": (22, 21), "code_quality": (8, 7)}
REFINERS = {"visual_design": "polish_visual", "interaction": "enhance_interaction", "functionality": "refine_functionality", "code_quality": "code_cleanup"}
LEAST_DEFICIT = {"visual_design": -1.0, "interaction": 0.10, "functionality": 0.10, "code_quality": 0.30}
#: What is tried instead of a blacklisted strategy, in order.
ALTERNATIVES = ("visual_enrichment", "feature_complete", "bug_fix", "holistic_rewrite", "fix_game", "fix_interaction")
#: Strategies and whether they patch or rewrite a page.
STRATEGIES = {
    "bug_fix": "patch", "code_cleanup": "patch", "enhance_interaction": "patch", "feature_complete": "patch", "fix_game": "patch", "fix_interaction": "patch", "fix_playability": "patch", "holistic_rewrite": "rewrite",
    "polish_visual": "patch", "refine_functionality": "patch", "visual_enhance": "patch", "visual_enrichment": "rewrite",
}


def evidence_quality() -> Column:
    """high, medium or low, over agent_ran, agent_steps, dynamic, console_errors, keys_known, keyboard_probed and what an observer saw
    (observer_items: its broken and working things)."""
    c = F.col
    medium = c("dynamic") | (c("console_errors") > 0) | c("keys_known") | c("keyboard_probed") | (c("observer_items") > 0)
    return F.when(c("agent_ran") & (c("agent_steps") > 0), "high").when(medium, "medium").otherwise("low")


def targeted() -> Column:
    """The strategy for the weakest dimension of a good page; the next weakest if that one was used last."""
    high = F.col("score") >= 90
    parts = []
    for d, most in MAXIMA.items():
        usual, strict = LIMITS[d]
        deficit = (F.lit(most) - F.col(d)) / most
        wanted = (F.col(d) <= F.when(high, strict).otherwise(usual)) & (deficit > LEAST_DEFICIT[d])
        if d == "interaction":
            wanted = wanted & F.col("interactive")
        parts.append(F.when(wanted, F.struct(deficit.alias("deficit"), F.lit(d).alias("dimension"), F.lit(REFINERS[d]).alias("strategy"))))
    ranked = F.sort_array(F.filter(F.array(*parts), lambda p: p.isNotNull()), asc=False)
    first, second = F.get(ranked, 0)["strategy"], F.get(ranked, 1)["strategy"]
    rest = F.when(high & (F.col("prev") == "visual_enrichment"), "polish_visual").otherwise("visual_enrichment")
    return F.when(F.size(ranked) == 0, rest).when((first == F.col("prev")) & (F.size(ranked) > 1), second).otherwise(first)


def strategy() -> Column:
    """The next strategy: one ladder over a diagnosis' columns.

    score and dimensions, prev (the last strategy or empty), quality, keyboard_broken, playability_tries, is_game, canvas, raf_calls, overlays, issues,
    game_issue, holistic_run, console_errors, render_ok, interactive.
    """
    c = F.col
    other = lambda name, instead: F.when(c("prev") != name, name).otherwise(instead)
    function, visual, inter = c("functionality") / 25, c("visual_design") / 20, c("interaction") / 25
    game = F.when((c("canvas") & (c("raf_calls") == 0)) | (c("overlays") > 0) | c("game_issue"), "fix_game").otherwise(other("fix_game", "feature_complete"))
    enrich = F.when(c("score") >= 70, "visual_enrichment").otherwise("feature_complete")
    stagnant = F.when(function < 0.72, "feature_complete").when(visual < 0.75, enrich).otherwise("feature_complete")
    middle = (
        F.when(c("issues") > 0, other("bug_fix", "feature_complete")).when(function < 0.72, other("feature_complete", "bug_fix")).when(inter < 0.60, other("fix_interaction", "feature_complete"))
        .when(visual < 0.75, F.when(c("score") >= 70, other("visual_enrichment", "feature_complete")).otherwise(other("feature_complete", "holistic_rewrite"))).otherwise(other("feature_complete", "bug_fix"))
    )
    proven = F.when((c("issues") > 0) & (function >= 0.5), other("bug_fix", "feature_complete")).otherwise(other("feature_complete", "bug_fix"))
    low = (
        F.when(c("quality") == "low", "holistic_rewrite").when(c("quality") == "medium", F.when(c("console_errors") > 0, "bug_fix").otherwise("holistic_rewrite"))
        .when(~c("render_ok") | (c("score") < 50), "holistic_rewrite").otherwise(proven)
    )
    return (
        F.when(c("keyboard_broken"), F.when((c("playability_tries") < 2) & (c("prev") != "fix_playability"), "fix_playability").otherwise("feature_complete"))
        .when(c("is_game") & c("score").between(40, 79), game)
        .when((c("interaction") < 15) & (c("score") >= 60) & (c("quality") != "low"), other("fix_interaction", "feature_complete"))
        .when(c("score") >= 80, targeted())
        .when((c("holistic_run") >= 2) & (c("score") >= 40), stagnant)
        .when((c("prev") == "fix_playability") & (c("score") >= 40), "feature_complete")
        .when(c("score") >= 60, middle).otherwise(low)
    )


def allowed(chosen: Column, blacklist: Column) -> Column:
    """``chosen``, or the first alternative that isn't blacklisted."""
    others = F.filter(F.array(*map(F.lit, ALTERNATIVES)), lambda a: (a != chosen) & ~F.array_contains(blacklist, a))
    return F.when(~F.array_contains(blacklist, chosen), chosen).otherwise(F.coalesce(F.get(others, 0), F.lit("holistic_rewrite")))


def broken_layer() -> Column:
    """Which part of a game is broken."""
    return F.when(F.col("overlays") > 0, "overlay").when(F.col("canvas") & (F.col("raf_calls") == 0), "game_loop").when(F.col("keyboard_broken"), "input").when(F.col("canvas") & (F.col("rendering") < 14), "canvas").otherwise("gameplay")


#: Pages over so many characters aren't patched; rewrites of a smaller page after which another strategy is tried.
LARGE_PAGE, MOST_REWRITES = 35000, 2


def overridden(chosen: Column, size: Column, enabled: Column | None = None) -> Column:
    """The engine's last word on a strategy: what isn't enabled becomes a rewrite, repeated rewrites of smaller pages vary, large pages
    are never patched; each only by strategies that are enabled (null: all are)."""
    c = F.col
    on = lambda name: F.lit(True) if enabled is None else F.array_contains(enabled, name)
    usable = chosen if enabled is None else F.when(F.array_contains(enabled, chosen), chosen).otherwise("holistic_rewrite")
    tired = (usable == "holistic_rewrite") & (c("rewrites") >= MOST_REWRITES) & (c("score") < 80) & (size <= LARGE_PAGE)
    varied = F.when(tired & on("feature_complete"), "feature_complete").when(tired & on("bug_fix"), "bug_fix").otherwise(usable)
    patching = (size > LARGE_PAGE) & varied.isin(*(n for n, mode in STRATEGIES.items() if mode == "patch"))
    enriched = F.when(patching & (c("score") >= 80) & on("visual_enrichment"), "visual_enrichment")
    return enriched.when(patching & on("holistic_rewrite"), "holistic_rewrite").otherwise(varied)


def candidates(most: int = 3) -> Column:
    """How many candidates are made at a score."""
    return F.when(F.col("score") < 70, most).when(F.col("score") < 90, 2).otherwise(1)


def keyboard_broken() -> Column:
    """Keys were tried on a page that wants them, and none did anything."""
    c = F.col
    return c("keyboard_game") & ((c("keyboard_probed") & (F.size("keys_responded") == 0) & ~c("keyboard_visual_change")) | (c("discovered_keys").isNotNull() & (F.size("discovered_keys") == 0)))


def keyboard_verified() -> Column:
    c = F.col
    return c("keyboard_game") & ((c("keyboard_probed") & ((F.size("keys_responded") > 0) | c("keyboard_visual_change"))) | (c("discovered_keys").isNotNull() & (F.size("discovered_keys") > 0)))


def reliable_issues(limit: int = 10) -> Column:
    """Issues that measurements back, surest first: console errors (3), dead keys, dead buttons, missing animation, overlays (2), unbound
    buttons, a running game without an end, what an observer saw broken (5), what an audit found broken (while fewer than ``limit``), an
    agent's bugs (3).  Repeats are left out."""
    c = F.col
    nothing = F.array().cast("array<string>")
    one = lambda test, text: F.when(test, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(nothing)
    dynamic = c("dynamic")
    unbound = F.format_string("%d of %d buttons have no handler", "unbound_buttons", "total_buttons")
    endless = (c("canvas_game") | c("keyboard_game")) & ~c("completion_seen") & dynamic & (c("animation_detected") | c("button_responsive"))
    measured = F.concat(
        F.transform(F.slice("console_messages", 1, 3), lambda e: F.concat(F.lit("console error: "), e)),
        one(keyboard_broken(), "keyboard input has no effect"),
        one(dynamic & ~c("button_responsive"), "buttons have no visible effect"),
        one(dynamic & ~c("animation_detected") & (c("frame_change_rate") == 0), "nothing is animated"),
        F.transform(F.slice("overlays_seen", 1, 2), lambda o: F.concat(F.lit("overlay: "), o)),
        one((c("unbound_buttons") > 0) & (c("total_buttons") > 0), unbound),
        one(endless, "the game has no end"),
    )
    seen = F.array_union(measured, F.slice("observer_broken", 1, 5))
    audited = F.array_except("audit_broken", seen)
    room = F.greatest(F.lit(0), F.lit(limit) - F.size(seen))
    more = F.concat(seen, F.slice(audited, F.lit(1), room))
    return F.when(c("agent_ran"), F.array_union(more, F.slice("agent_bugs", 1, 3))).otherwise(more)


def preserved() -> Column:
    """What a repair must not break: what an observer saw working, decorations, else highlights; and keys that work."""
    working = F.array_union("observer_working", F.transform(F.array_except("visual_elements", "observer_working"), lambda v: F.concat(F.lit("[visual] "), v)))
    base = F.when(F.size(working) == 0, F.col("highlights")).otherwise(working)
    keys = F.coalesce("discovered_keys", F.array().cast("array<string>"))
    return F.when(keyboard_verified() & (F.size(keys) > 0), F.concat(base, F.array(F.concat(F.lit("keys work: "), F.array_join(keys, ", "))))).otherwise(base)


def running(traces: DataFrame) -> DataFrame:
    """Traces (record_id, iteration, strategy, score) with the best score so far, the delta to the last, and the length of the run of equal strategies."""
    order = W.partitionBy("record_id").orderBy("iteration")
    before = F.lag("score").over(order)
    rows = traces.withColumns({"delta": F.col("score") - before, "best": F.max("score").over(order.rowsBetween(W.unboundedPreceding, 0)), "turn": F.coalesce((F.lag("strategy").over(order) != F.col("strategy")).cast("int"), F.lit(1))})
    rows = rows.withColumn("run", F.sum("turn").over(order))
    return rows.withColumn("run_length", F.row_number().over(W.partitionBy("record_id", "run").orderBy("iteration")).cast("long")).drop("turn", "run")


#: Fixed values of early stops: the score that is near perfection; the least gain that counts below 85, from 85 and from 90 on; how many
#: smaller gains in a row stop a repair below 80 and from 80 on; iterations without a new best that make a plateau; the interaction
#: score below which dead keys keep a repair going.
PERFECT, GAINS, PATIENCE, PLATEAU, PLAYABLE = 97, ((90, 0.5), (85, 1.0), (0, 2.0)), ((80, 2), (0, 3)), 2, 20


def stop_rule(state: dict, row: dict) -> dict:
    """One iteration of a repair (score, interaction, keyboard_broken), which starts from the best page so far.

    ``state`` is empty before the record's original evaluation; after it, it holds best, its interaction and keys, since, low and reason.
    """
    if not state:
        return {"best": row["score"], "interaction": row["interaction"], "broken": row["keyboard_broken"], "since": 0, "low": 0, "reason": None}
    new, score, delta = dict(state), row["score"], row["score"] - state["best"]
    if delta > 0:
        new |= {"best": score, "interaction": row["interaction"], "broken": row["keyboard_broken"], "since": 0}
    else:
        new["since"] += 1
    if new["broken"] and new["interaction"] < PLAYABLE:
        return new | {"low": 0}
    if new["since"] >= PLATEAU:
        new |= {"since": 0, "low": 0}
    if score >= PERFECT:
        return new | {"reason": "near_perfect"}
    new["low"] = new["low"] + 1 if delta < next(g for least, g in GAINS if score >= least) else 0
    if new["low"] >= next(p for least, p in PATIENCE if score >= least):
        new["reason"] = "converged"
    return new


def replay(traces: DataFrame) -> DataFrame:
    """Where each record (record_id, iteration, score, interaction, keyboard_broken) would have stopped: ``stop_rule`` as a fold over its
    iterations in order (a record has few); the first row is the original evaluation."""
    ordered = F.array_sort(F.collect_list(F.struct("iteration", "score", "interaction", "keyboard_broken")))
    grouped = traces.groupBy("record_id").agg(ordered.alias("steps"))
    first = F.get("steps", 0)
    start = F.struct(
        F.lit(None).cast("string").alias("reason"), first["iteration"].cast("long").alias("at"), first["score"].cast("long").alias("best"),
        first["interaction"].cast("long").alias("interaction"), first["keyboard_broken"].alias("broken"), F.lit(0).alias("since"), F.lit(0).alias("low"),
    )
    by_score = lambda score, table: F.coalesce(*(F.when(score >= least, F.lit(v)) for least, v in table))

    def step(s: Column, x: Column) -> Column:
        score, better = x["score"], x["score"] > s["best"]
        best = lambda name, new: F.when(better, new).otherwise(s[name])
        interaction, broken = best("interaction", x["interaction"]), best("broken", x["keyboard_broken"])
        forced = broken & (interaction < PLAYABLE)
        since = F.when(better, 0).otherwise(s["since"] + 1)
        plateau = ~forced & (since >= PLATEAU)
        low = F.when(plateau, 0).otherwise(s["low"])
        count = F.when(score - s["best"] < by_score(score, GAINS), low + 1).otherwise(0)
        reason = F.when(forced, None).when(score >= PERFECT, "near_perfect").when(count >= by_score(score, PATIENCE), "converged")
        going = s["reason"].isNull()
        keep = lambda new, name, kind: F.when(going, new).otherwise(s[name]).cast(kind).alias(name)
        return F.struct(
            keep(reason, "reason", "string"), keep(x["iteration"], "at", "long"), keep(best("best", score), "best", "long"), keep(interaction, "interaction", "long"),
            keep(broken, "broken", "boolean"), keep(F.when(plateau, 0).otherwise(since), "since", "int"), keep(F.when(forced, 0).when(score >= PERFECT, low).otherwise(count), "low", "int"),
        )

    folded = grouped.select("record_id", F.aggregate(F.slice("steps", F.lit(2), F.size("steps")), start, step).alias("s"))
    return folded.select("record_id", F.coalesce("s.reason", F.lit("exhausted")).alias("stop_reason"), F.col("s.at").alias("stopped_at"), F.col("s.best").alias("best_score"))


def trace_stats(traces: DataFrame, gate: int = 80, gain: int = 10) -> DataFrame:
    """Per record: first and best score, gain, number of iterations, and whether it is good enough to train on."""
    per = traces.groupBy("record_id").agg(F.min_by("score", "iteration").alias("original_score"), F.max("score").alias("best_score"), F.count("*").alias("iterations"))
    return per.withColumn("improvement", F.col("best_score") - F.col("original_score")).withColumn("sft_eligible", (F.col("best_score") >= gate) & (F.col("improvement") >= gain))


def strategy_stats(traces: DataFrame) -> DataFrame:
    """Per strategy: uses, mean delta (1 digit), share of gains (3 digits) and of falls by more than eight points."""
    rows = running(traces).where("delta is not null")
    return rows.groupBy("strategy").agg(F.count("*").alias("uses"), F.bround(F.avg("delta"), 1).alias("avg_delta"), F.bround(F.avg((F.col("delta") > 0).cast("int")), 3).alias("success_rate"), F.count_if(F.col("delta") < -8).alias("blacklisted"))
