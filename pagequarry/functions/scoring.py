"""Deterministic scores of a page from its features and from recorded evidence, as columns.

Every function takes a dict of columns; an absent name is null and gets the default of the rubric.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import SEMANTIC_TAGS

#: Points of the dimensions for interactive and for other prompts.
WEIGHTS = {
    True: {"rendering": 10, "visual_design": 20, "functionality": 55, "interaction": 10, "code_quality": 5},
    False: {"rendering": 10, "visual_design": 20, "functionality": 65, "interaction": 0, "code_quality": 5},
}


def clamp(value: Column, low: int, high: int | Column) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high) if isinstance(high, int) else high, value))


def _get(cols: dict[str, Column], name: str, default) -> Column:
    return F.coalesce(cols[name], F.lit(default)) if name in cols else F.lit(default)


def _points(*cases: tuple[Column, int]) -> Column:
    """The points of the first case that holds, else 0."""
    out = F.lit(0)
    for test, n in reversed(cases):
        out = F.when(test, n).otherwise(out)
    return out


def scaled(value: Column, old: int, new: Column) -> Column:
    return clamp(F.bround(F.coalesce(value.cast("double"), F.lit(0.0)) / old * new), 0, new).cast("long")


def interaction_points(e: dict[str, Column]) -> Column:
    """0 to 20 from probe evidence."""
    rate, keys = _get(e, "button_response_rate", 0.0), _get(e, "keys_responded", 0)
    latency, late = e.get("avg_latency_ms", F.lit(None).cast("double")), _get(e, "interactions_timed_out", 0)
    flag = lambda name, n: _points((_get(e, name, False), n))
    total = F.when(rate > 0, F.bround(rate * 5).cast("int")).otherwise(flag("button_responsive", 2))
    total = total + _points((keys >= 5, 4), (keys >= 3, 3), (keys >= 1, 1), (_get(e, "keyboard_responsive", False), 1))
    for name, n in (("hover_effects_detected", 2), ("drag_responsive", 2), ("form_submit_changed", 2), ("gameplay_state_changed", 3), ("has_below_fold", 1)):
        total = total + flag(name, n)
    total = total + F.coalesce(_points((latency < 50, 2), (latency < 150, 1)), F.lit(0)) - F.least(F.lit(4), late)
    return clamp(total, 0, 20)


def code_points(s: dict[str, Column]) -> Column:
    """0 to 15 from static features."""
    n = reduce(lambda a, b: a + b, (_get(s, f"has_{t}", False).cast("int") for t in SEMANTIC_TAGS))
    ext, inline = _get(s, "ext_count", 0), _get(s, "inline_style_count", 0)
    lost = _points((ext >= 8, 3), (ext >= 5, 1)) + _points((inline > 30, 3), (inline > 15, 1)) + _points((n == 0, 4), (n < 2, 3), (n < 4, 1))
    for name in ("has_doctype", "has_title", "has_meta_viewport"):
        lost = lost + _points((~_get(s, name, True), 2))
    return F.greatest(F.lit(0), F.lit(15) - lost)


def rendering_points(s: dict[str, Column], e: dict[str, Column], interactive: Column) -> Column:
    """0 to 10; a page that didn't render has none, and what is deducted after that can't go below."""
    errors, warnings = _get(e, "console_errors", 0), _get(e, "console_warnings", 0)
    dead = interactive & ~_get(s, "has_script", False) & ~_get(s, "has_canvas", False) & ~_get(s, "has_svg", False)
    first = _points((dead, 4), (F.lit(True), 10)) - errors * 3 - F.least(warnings, F.lit(5)) - _get(e, "page_err_count", 0) * 5 - _points((errors + warnings > 0, 1))
    fps, buttons = _get(e, "fps_quality", "not measured"), _get(e, "structural_total_buttons", 0)
    loose = _get(e, "structural_unbound_buttons", 0) / F.nullif(buttons, F.lit(0)) > 0.3
    later = _points((fps == "frozen", 5), (fps == "choppy", 4)) + _points((~_get(s, "has_lang_attr", False), 1)) + _points((F.coalesce(loose, F.lit(False)), 2)) + _points((_get(e, "structural_overlays", 0) > 0, 2))
    return F.greatest(F.lit(0), F.when(_get(e, "rendered", True), first).otherwise(0) - later)


def visual_points(s: dict[str, Column], e: dict[str, Column], vlm: Column) -> Column:
    """0 to 25 from a recorded visual score (8 without one) and guard rails."""
    lost = _points((_get(e, "responsive_has_horizontal_overflow", False), 4)) + _points((~_get(s, "has_meta_viewport", True), 3)) + _points((_get(e, "responsive_mobile_broken", False), 3))
    lost = lost + _points((~_get(s, "has_style", True) & ~_get(s, "has_css_transitions", False), 3))
    return F.greatest(F.lit(0), F.least(F.coalesce(vlm, F.lit(8)), F.lit(25)) - lost)


def composite(s: dict[str, Column], e: dict[str, Column], tests: dict[str, Column], vlm_visual: Column, vlm_functionality: Column, interactive: Column) -> dict[str, Column]:
    """The five dimensions and their total (0 to 100)."""
    weight = lambda d: F.when(interactive, WEIGHTS[True][d]).otherwise(WEIGHTS[False][d])
    rate = _get(tests, "test_pass_rate", 0.0)
    functionality = F.when(_get(tests, "tests_total", 0) > 0, scaled(clamp(rate, 0, 1), 1, weight("functionality"))).otherwise(scaled(vlm_functionality, 25, weight("functionality")))
    probed = scaled(interaction_points(e), 20, weight("interaction"))
    full = (rate >= 0.995) & (probed > 0) & (_get(e, "interactions_timed_out", 0) == 0)
    out = {
        "rendering": scaled(rendering_points(s, e, interactive), 10, weight("rendering")),
        "visual_design": scaled(visual_points(s, e, vlm_visual), 25, weight("visual_design")),
        "functionality": functionality,
        "interaction": F.when(~interactive, 0).when(full, weight("interaction")).otherwise(probed).cast("long"),
        "code_quality": scaled(code_points(s), 15, weight("code_quality")),
    }
    out["total_score"] = clamp(reduce(lambda a, b: a + b, out.values()), 0, 100)
    return out


def guarded(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """The total after a repair less a penalty for dimensions that fell by more than two points; at most half of a gain of three or more."""
    dims = ("functionality", "interaction", "rendering", "visual_design", "code_quality")
    old, new = (reduce(lambda a, b: a + b, (x[d] for d in dims)) for x in (before, after))
    fell = {d: F.when(before[d] - after[d] > 2, before[d] - after[d]).otherwise(0) for d in dims}
    weigh = lambda factors: reduce(lambda a, b: a + b, (fell[d] * n for d, n in zip(dims, factors, strict=True)))
    penalty = F.when(old >= 85, weigh((2, 2, 1, 1, 1))).otherwise(weigh((3, 3, 2, 2, 0)))
    gain = new - old
    return new - F.when(gain >= 3, F.least(penalty, F.floor(gain / 2))).otherwise(penalty)
