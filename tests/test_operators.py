"""Operators against values worked out by hand and against brute force."""

from __future__ import annotations

import re
import zlib
from math import comb

import numpy as np
import pytest
from pagequarry.functions import html as H
from pagequarry.functions import taxonomy
from pagequarry.operators import analysis, curation, quality, records, repair, tcpool
from pyspark.sql import Row
from pyspark.sql import functions as F


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_pass_at_k(spark):
    rows = spark.createDataFrame([(n, c) for n in range(1, 8) for c in range(n + 1)], "n long, c long")
    for k in (1, 3):
        for r in rows.select("n", "c", analysis.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            want = float(r.c > 0) if r.n < k else 1 - comb(r.n - r.c, k) / comb(r.n, k)
            assert r.p == pytest.approx(want)


def test_bucket_of_four(spark):
    rows = [("a", s, "completed" if s > 1 else "failed", 0.5, 1, 2, 3, 4, 5) for s in (1, 2, 3, 4)]
    table = spark.createDataFrame(rows, "k string, total long, eval_status string, test_pass_rate double, " + ", ".join(f"{d} long" for d in analysis.DIMENSIONS))
    r = analysis.bucket(table, ["k"]).first()
    assert (r.total, r.avg_score, r.median_score, r.p25_score, r.p75_score, r.std_dev) == (4, 2.5, 2.5, 2.0, 4.0, 1.29)
    assert (r.completed_total, r.avg_score_completed, r.completion_rate, r.tier_c_pct, r.avg_interaction) == (3, 3.0, 0.75, 1.0, 4.0)


def test_latest_row_of_each_key(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "b", 1)], "line_idx long, item_id string, v long")
    assert {tuple(r) for r in analysis.latest(rows, ["item_id"]).collect()} == {(2, "a", 3), (3, "b", 1)}
    assert {tuple(r) for r in analysis.first(rows, ["item_id"]).collect()} == {(1, "a", 5), (3, "b", 1)}


def test_families(spark):
    values = [(" landing ",), ("",), (None,), ("own",), ("svg_art",)]
    got = [tuple(r) for r in spark.createDataFrame(values, "c string").select(taxonomy.family(F.col("c")), taxonomy.source_category(F.col("c")), taxonomy.rescore_family(F.col("c"))).collect()]
    assert got == [("content_marketing", "landing", " landing "), ("unknown", "", "unknown"), ("unknown", "", "unknown"), ("own", "", "own"), ("visual_art_animation", "svg_art", "visual_art_animation")]


PAGE = "<!DOCTYPE html><html><body>x</body></html>"


@pytest.mark.parametrize(
    ("answer", "strict", "recovered", "state"),
    [
        (f"text\n```html\n{PAGE}\n```\nend", PAGE, PAGE, "ok"),
        ("```html\n<html><body>cut", None, "<html><body>cut\n</body>\n</html>", "truncated_or_unextractable_html"),
        (f"before {PAGE} after", PAGE, PAGE, "ok"),
        ("<html><p>a</p></html>", "<html><p>a</p></html>", "<html><p>a</p></html>", "ok"),
        ("x <!DOCTYPE html><html><body>tail", None, "<!DOCTYPE html><html><body>tail\n</body>\n</html>", "truncated_or_unextractable_html"),
        ("see <svg><g/></svg>", H.SVG_OPEN + "<svg><g/></svg>" + H.SVG_CLOSE, H.SVG_OPEN + "<svg><g/></svg>" + H.SVG_CLOSE, "ok"),
        ("see <svg><g/>", None, None, "truncated_or_unextractable_svg"),
        ("no page", None, None, "no_extractable_html"),
        ("  ", None, None, "empty"),
        (f"```html\n{PAGE}\n```\n```html\n{PAGE[:-14]}longer</body></html>\n```", PAGE[:-14] + "longer</body></html>", PAGE[:-14] + "longer</body></html>", "ok"),
    ],
)
def test_extraction(spark, answer, strict, recovered, state):
    text = F.lit(answer)
    got = one(spark, a=H.extract(text, False), b=H.extract(text, True), c=H.response_state(text))
    assert tuple(got) == (strict, recovered, state)


def test_long_answers_do_not_overflow(spark):
    text = F.concat(F.lit("```html\n<html><body>"), F.repeat(F.lit("<p>long line of text</p>\n"), 40_000))
    assert one(spark, n=F.length(H.extract(text, True))).n > 900_000


def test_injection_goes_before_the_last_body_end(spark):
    got = one(spark, a=H.inject(F.lit("a</body>b</BODY>c"), "X"), b=H.inject(F.lit("none"), "X"))
    assert tuple(got) == ("a</body>bX</BODY>c", "noneX")


@pytest.mark.parametrize(
    ("text", "bad"),
    [("f(x)", False), ("(x", True), ("x='it", True), ("x=/[/(]/.test(y)", False), ("a/b)", True), ("`${x}`", False), ("x='\\''", False), ("x=/a", True), ("[(])", True), ("", False), (None, False), ("y ? /)/ : {}", False)],
)
def test_unbalanced(text, bad):
    assert quality._is_unbalanced(text) is bad


def test_json_objects(spark):
    rows = spark.createDataFrame([(1, 'say {bad {"a": {"b": "}"}} end'), (2, "none {"), (3, None)], "id long, text string")
    assert {r.id: r.object for r in quality.json_objects(rows).collect()} == {1: '{"a": {"b": "}"}}', 2: None, 3: None}


def test_minhash_signature_by_definition(spark):
    texts = ["A  small\ttext for hashing", "", "abc", "é" * 30]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in curation.signatures(table).collect():
        low = re.sub(r"\s+", " ", texts[r.id].lower())
        shingles = {zlib.crc32(low[j : j + 5].encode()) for j in range(max(1, len(low) - 4))}
        want = [min((s * (i + 1) * 2654435761 + i * 1013904223) & 0xFFFFFFFF for s in shingles) for i in range(128)]
        assert r.signature == want


def test_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"], 120)) for _ in range(6)]
    texts = [b if rng.random() < 0.3 else b[: 600 + int(rng.integers(0, 60))] + str(int(rng.integers(0, 4))) for b in base for _ in range(25)]
    table = spark.createDataFrame([(i, t, int(i * 7 % 50)) for i, t in enumerate(texts)], "id long, text string, score long")
    got = {r.id: r for r in curation.deduplicate(table).collect()}
    sig = {r.id: np.array(r.signature) for r in curation.signatures(table).collect()}
    near = lambda a, b: any((a[k : k + 4] == b[k : k + 4]).all() for k in range(0, 128, 4)) and (a == b).mean() >= 0.8
    label = {i: i for i in sig}
    while True:
        new = {i: min(label[j] for j in sig if near(sig[i], sig[j])) for i in sig}
        if new == label:
            break
        label = new
    assert {i: r.cluster for i, r in got.items()} == label
    for c in set(label.values()):
        members = [i for i in label if label[i] == c]
        assert [i for i in members if got[i].kept] == [max(members, key=lambda i: (i * 7 % 50, -i))]


RUNS = {
    "up": [50, 60, 70, 98, 99], "flat": [60, 60, 61, 60, 60, 60, 60], "good": [90, 91, 91, 91], "falls": [80, 60, 70, 75, 79, 84, 84], "on": [10, 20, 30], "one": [42], "slow": [84, 85, 86, 87], "late": [85, 85, 86, 86],
}


def fold(scores, broken=False, interaction=25):
    """The stopping rules written out as a loop; the first score is that of the original page."""
    best, since, low = scores[0], 0, 0
    for i, s in enumerate(scores[1:], 1):
        delta = s - best
        best, since = (s, 0) if delta > 0 else (best, since + 1)
        if broken and interaction < 20:
            low = 0
            continue
        if since >= 2:
            since = low = 0
        if s >= 97:
            return "near_perfect", i, best
        low = low + 1 if delta < (0.5 if s >= 90 else 1.0 if s >= 85 else 2.0) else 0
        if low >= (3 if s < 80 else 2):
            return "converged", i, best
    return "exhausted", len(scores) - 1, best


@pytest.mark.parametrize(("broken", "interaction"), [(False, 5), (True, 5), (True, 25)])
def test_replay_stops(spark, broken, interaction):
    rows = [Row(record_id=k, iteration=i, score=s, interaction=interaction, keyboard_broken=broken) for k, v in RUNS.items() for i, s in enumerate(v)]
    got = {r.record_id: (r.stop_reason, r.stopped_at, r.best_score) for r in repair.replay(spark.createDataFrame(rows)).collect()}
    assert got == {n: fold(v, broken, interaction) for n, v in RUNS.items()}
    if not broken:
        assert got["up"] == ("near_perfect", 3, 98) and got["on"] == ("exhausted", 2, 30)
    for name, scores in RUNS.items():
        state, at = {}, 0
        for i, s in enumerate(scores):
            if not state or state["reason"] is None:
                state, at = repair.stop_rule(state, {"score": s, "interaction": interaction, "keyboard_broken": broken}), i
        assert (state["reason"] or "exhausted", at, state["best"]) == got[name], "the rule of the streaming state is the same"


def test_enabled_strategies(spark):
    rows = [("holistic_rewrite", 100, 3, 60, ["bug_fix", "holistic_rewrite"]), ("holistic_rewrite", 100, 3, 60, ["holistic_rewrite"]), ("bug_fix", 40000, 0, 85, ["bug_fix"]), ("bug_fix", 40000, 0, 85, ["bug_fix", "holistic_rewrite"]), ("fix_game", 10, 0, 50, ["bug_fix"])]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, chosen string, size long, rewrites long, score long, enabled array<string>")
    got = [r.s for r in table.select("i", repair.overridden(F.col("chosen"), F.col("size"), F.col("enabled")).alias("s")).orderBy("i").collect()]
    assert got == ["bug_fix", "holistic_rewrite", "bug_fix", "holistic_rewrite", "holistic_rewrite"]


def test_evidence_quality(spark):
    columns = "agent_ran boolean, agent_steps long, dynamic boolean, console_errors long, keys_known boolean, keyboard_probed boolean, observer_items long"
    rows = [(True, 2, False, 0, False, False, 0), (False, 2, False, 0, False, False, 0), (True, 0, False, 0, True, False, 0), (False, 0, False, 0, False, False, 1)]
    assert [r.q for r in spark.createDataFrame(rows, columns).select(repair.evidence_quality().alias("q")).collect()] == ["high", "low", "medium", "medium"]


def test_error_classes_and_waits(spark):
    texts = ["Output Blocked by provider", "violates our Safety Policy", "429 slow down", "x" * 600 + " timeout", "", "content management policy"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(records.error_class(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ["content_filter", "content_filter", "rate_limit", "other", "none", "other"]
    waits = spark.createDataFrame([("12.5",), ("soon",), (None,)], "h string").select(records.retry_after(F.col("h")).alias("w")).collect()
    assert [r.w for r in waits] == [12.5, None, None]


def test_buttons(spark):
    words = ["Start game", "Go", "OK, go back", "Cancel", "Save", "开始", "菜单", "New Game"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(records.button_priority(F.col("w")).alias("p")).collect()
    assert [r.p for r in rows] == [100, 50, 50, 10, 50, 100, 10, 50]


def test_frames_for_repairs(spark):
    from pagequarry.operators import evidence

    labels = ["gameplay_1", "x", "hover_a", "pre_stable_b", "after_click_1", "after_click_2", "stable", "y", "keyboard_up"]
    table = spark.createDataFrame([(1, i, x, i / 10) for i, x in enumerate(labels)] + [(2, 0, "x", 0.5), (2, 1, "y", 0.1)], "record_id long, seq long, label string, diff_from_prev double")
    got = evidence.repair_frames(table).orderBy("record_id", "seq").collect()
    assert [(r.record_id, r.label) for r in got] == [(1, "pre_stable_b"), (1, "after_click_1"), (1, "after_click_2"), (1, "stable"), (1, "keyboard_up"), (2, "x"), (2, "y")]
    few = table.where("label in ('x', 'y', 'hover_a')").withColumn("record_id", F.lit(3)).unionByName(spark.createDataFrame([(3, 20 + i, "z", 0.9 - i / 10) for i in range(4)], table.schema))
    assert [r.seq for r in evidence.repair_frames(few).orderBy("seq").collect()] == [2, 20, 21, 22, 7] or {r.seq for r in evidence.repair_frames(few).collect()} == {2, 20, 21, 22, 7}


def test_moving_images(spark):
    from pagequarry.operators import evidence

    table = spark.createDataFrame([(1, i, "observation", str(i // 2)) for i in range(12)] + [(2, i, "observation", "same") for i in range(5)] + [(1, 50, "deep", "z")], "record_id long, seq long, layer string, digest string")
    assert {(r.record_id, r.changes, r.fps_quality) for r in evidence.fps_quality(table).collect()} == {(1, 4, "acceptable"), (2, 0, "frozen")}


def test_unrendered_pages_have_no_rendering_points(spark):
    rows = [(r, 5, 10, 10, 5, True, 0.5, None, 40) for r in (True, False)]
    table = spark.createDataFrame(rows, "rendered boolean, rendering long, visual_design long, interaction long, code_quality long, has_interaction boolean, test_pass_rate double, filtered_rate double, total long")
    assert [r.new_rendering for r in tcpool.rescore(table).collect()] == [10, 0]


def test_generic_visual_cases_of_many_steps(spark):
    step = lambda a: Row(pos=0, action=a, selector="b", expression="", gte=0, eq=None)
    long = [step("screenshot"), *[step("click")] * 6, step("assert_screenshot_changed")]
    items = [Row(item_id="1", prompt="p", test_cases=[Row(id="a", name="The  Visible reaction", weight=1.0, steps=long), Row(id="b", name="moves on", weight=1.0, steps=long[:1] + long[1:-1][::-1] + long[-1:])])]
    table = spark.createDataFrame(items, quality.ITEMS)
    got = {(r.tc_id, r.risk) for r in quality.audit(table).collect()}
    assert ("a", "visual_change_only_tc") in got and ("b", "visual_change_only_tc") not in got and ("b", "exact_duplicate_steps") in got
    many = spark.createDataFrame([Row(item_id="9", prompt="p", test_cases=[Row(id=str(i), name=f"n{i}", weight=1.0, steps=[step("wait")]) for i in range(46)])], quality.ITEMS)
    assert {r.risk for r in quality.audit(many).where("tc_id is null").collect()} == {"high_tc_density"}
    bare = spark.createDataFrame([Row(item_id=None, prompt=None, test_cases=None), Row(item_id="2", prompt="p", test_cases=[Row(id=None, name=None, weight=1.0, steps=[])])], quality.ITEMS)
    rules = sorted(r.rule for r in quality.all_violations(bare).collect())
    assert rules == ["missing case id", "missing case name", "missing id", "missing prompt", "no steps", "test cases aren't a list"]


def test_structural_difference(spark):
    from pagequarry.functions import image

    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, image.WIDTH * image.HEIGHT, np.uint8)
    other = rng.integers(0, 256, grey.size, np.uint8)
    flat = bytes([7]) * grey.size
    assert image.ssim_difference(grey.tobytes(), grey.tobytes()) == pytest.approx(0, abs=1e-12)
    assert image.ssim_difference(grey.tobytes(), other.tobytes()) > 0.9
    assert image.ssim_difference(None, flat) is None
    rows = spark.createDataFrame([(flat, grey.tobytes())], "a binary, b binary").select(image.is_blank("a").alias("a"), image.is_blank("b").alias("b"), image.frame_difference("a", "b").alias("d")).first()
    assert rows.a and not rows.b and rows.d == pytest.approx(image.ssim_difference(flat, grey.tobytes()))


def test_frames_are_paired_by_label_then_position(spark):
    from pagequarry.operators import evidence

    rows = [(1, "before", 1, "stable"), (1, "before", 2, "hover_a"), (1, "before", 3, "odd"), (1, "after", 1, "hover_b"), (1, "after", 2, "stable"), (1, "after", 3, "other"), (1, "after", 4, "more"), (2, "before", 1, "stable")]
    got = evidence.paired_frames(spark.createDataFrame(rows, "record_id long, side string, seq long, label string")).orderBy("pair").collect()
    assert [(r.record_id, r.before_label, r.after_label) for r in got] == [(1, "stable", "stable"), (1, "hover_a", "hover_b"), (1, "odd", "other")]
    again = [(1, "before", i, "odd") for i in (5, 6, 7)] + [(1, "after", i, "more") for i in (1, 8, 9, 10)]
    got = evidence.paired_frames(spark.createDataFrame(again, "record_id long, side string, seq long, label string")).orderBy("pair").collect()
    assert [(r.before_seq, r.after_seq) for r in got] == [(5, 1), (6, 8), (7, 9)], "all frames of an unused label are paired by position"


def test_pages_of_records_with_equal_places_hold_each_once(spark):
    from pagequarry.operators import items

    rows = [(f"u{i:03d}", i % 3, "F", 50, True, True, True) for i in reversed(range(90))]
    kinds = "uid string, place long, dataset string, score long, has_html boolean, has_repair boolean, has_refine boolean"
    want = sorted((place, uid) for uid, place, *_ in rows)
    for parts in (1, 7):
        records = spark.createDataFrame(rows, kinds).repartition(parts)
        got = [(r.place, r.uid) for n in range(9) for r in items.page(records, "score_desc", n, 10)[0].collect()]
        assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("  <!DOCTYPE html>x", "  <!DOCTYPE html>x"), ("prose\n```html\n<p>a</p>\n```  ", "<p>a</p>"), ("prose ```html\n<p>a</p>", "<p>a</p>"), ("see <html>b", "<html>b"), ("nothing", "nothing")],
)
def test_unwrapping(spark, text, want):
    assert one(spark, a=H.unwrapped(F.lit(text))).a == want
