"""Columns over texts of answers, reports and consoles: extraction, filters, features, feedback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import any_of
from .taxonomy import stripped

#: Patterns of thinking, fences and pages in answers, and the characters that a page has at least (closed or cut off).
THINKING = r"(?is)<think>.*?</think>"
PAGE_FENCE = r"(?is)```(?:html)?\s*\n(.*?)\s*```"
PAGE_TAGS = r"(?is)(<!DOCTYPE.*?</html>|<html.*?</html>)"
LEAST_PAGE, LEAST_CUT_PAGE = 200, 500


def without_thinking(text: Column) -> Column:
    """A text without its thinking blocks and outer blanks; the whole text if nothing else is left."""
    clean = stripped(F.regexp_replace(text, THINKING, ""))
    return F.when(clean == "", text).otherwise(clean)


def repaired_page(text: Column) -> Column:
    """The page in a repair's answer: the first fence that is long enough, else a tagged page, else an answer that begins like one; or null."""
    clean = without_thinking(text)
    fences = F.transform(F.regexp_extract_all(clean, F.lit(PAGE_FENCE), 1), stripped)
    fenced = F.get(F.filter(fences, lambda p: F.length(p) >= LEAST_PAGE), 0)
    tagged = stripped(F.regexp_extract(clean, PAGE_TAGS, 1))
    begins = F.lower(clean).startswith("<!doctype") | F.lower(clean).startswith("<html")
    return F.coalesce(fenced, F.when(F.length(tagged) >= LEAST_PAGE, tagged), F.when(begins & (F.length(clean) >= LEAST_PAGE), clean))


def is_page(html: Column) -> Column:
    """Whether a page is long enough and closed, or cut off but longer still."""
    low = F.lower(html)
    closed = F.contains(low, F.lit("</html>")) | F.contains(low, F.lit("</body>"))
    cut = F.regexp_replace(low, r"^\s+", "")
    begins = cut.startswith("<!doctype") | cut.startswith("<html")
    return F.coalesce((F.length(html) >= LEAST_PAGE) & (closed | (begins & (F.length(html) >= LEAST_CUT_PAGE))), F.lit(False))


def json_answer(text: Column) -> Column:
    """The JSON in an answer as a variant: without thinking and fence, else from the first to the last brace; null if neither parses."""
    clean = stripped(F.regexp_replace(text, THINKING, ""))
    bare = stripped(F.regexp_replace(F.regexp_replace(clean, r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


#: Console texts that say nothing about a page, and errors that come from the machine.
BENIGN = (
    "notallowederror", "failed to execute 'writetext' on 'clipboard'", "failed to execute 'readtext' on 'clipboard'", "navigator.clipboard", "failed to load resource", "net::err_", "blocked by cors policy",
    "cross-origin request blocked", "access to fetch at",
)
RESOURCE = (
    "resource temporarily unavailable", "errno 11", "pthread_create", "cannot allocate memory", "connection closed while reading from the driver", "target page, context or browser has been closed",
    "target crashed", "browser closed", "browser has been closed",
)
#: Constraints of prompts that aren't scored.
NOT_SCORED = (
    r"\bno external resources?\b", r"\bexternal resources?\b", r"\bexternal dependenc(?:y|ies)\b", r"\bcdn\b", r"\bsingle[- ]html\b", r"\bsingle[- ]file\b", r"\bself-contained\b", r"\braw html only\b",
    r"\bplain html\b", r"\bhtml only\b",
)


def is_benign(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), BENIGN)


def is_resource_error(text: Column) -> Column:
    return any_of(F.lower(F.coalesce(text, F.lit(""))), RESOURCE)


def is_not_scored(text: Column) -> Column:
    return stripped(F.lower(F.coalesce(text, F.lit("")))).rlike("|".join(NOT_SCORED))


def requirement_summary(requirements: Column) -> Column:
    """Counts of an array of (requirement, status, evidence) without constraints that aren't scored: total, done, broken, missing."""
    kept = F.filter(requirements, lambda r: ~(is_not_scored(r["requirement"]) | is_not_scored(r["evidence"])))
    n = lambda s: F.size(F.filter(kept, lambda r: F.coalesce(r["status"], F.lit("missing")) == s)).cast("long").alias(s)
    return F.struct(F.size(kept).cast("long").alias("total"), n("done"), n("broken"), n("missing"))


#: Patterns that are counted and words that are looked for in a page that is to be rewritten.
COUNTED = {
    "svg_paths": r"<path\b", "gradients": r"gradient\s*\(", "keyframes": r"@keyframes\s+(\w+)", "filters": r"filter:|filter\(",
    "screens": r"(?:start|menu|game.?over|pause|settings|tutorial|loading)\s*(?:screen|menu|overlay|modal)", "fonts": r"fonts\.googleapis\.com|@import.*font|@font-face", "forms": r"<(?:input|select|textarea)\b",
}
MARKED = {
    "clip_path": ("clip-path",), "three_d": ("perspective", "transform3d", "rotatex", "rotatey"), "canvas": ("<canvas",), "physics": ("velocity", "gravity", "acceleration", "friction", "bounce", "momentum"),
    "collision": ("collision", "intersect", "hitbox", "boundingbox", "collide"), "states": ("gamestate", "game_state", "currentstate", "showscreen", "currentscreen"),
    "levels": ("currentlevel", "nextlevel", "loadlevel", "leveldata", "levels["),
}
IMAGES, EMOJI = r"<img[^>]+src=[\"']([^\"']+)", r"[\x{1F300}-\x{1F9FF}]"


def visual_features(html: Column) -> dict[str, Column]:
    """What a rewrite of a page must keep: counts of patterns, how many words of each kind occur, images and emoji."""
    low = F.lower(html)
    found = {n: F.regexp_count(low, F.lit(p)).cast("long") for n, p in COUNTED.items()}
    for name, words in MARKED.items():
        found[name] = sum((F.contains(low, F.lit(w)).cast("long") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("long"))
    return found | {"images": F.regexp_count(html, F.lit(IMAGES)).cast("long"), "emoji": F.regexp_count(html, F.lit(EMOJI)).cast("long")}


def missing_tags(html: Column, tags: Column) -> Column:
    """Those of the tags that a page doesn't have, in their order."""
    there = F.transform(F.regexp_extract_all(F.lower(html), F.lit(r"<([a-z][a-z0-9]*)"), 1), lambda t: t)
    return F.array_except(tags, there)


def model_slug(raw: Column) -> Column:
    """The last part of a model's name, in lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(raw, "/+$", ""), "/"), -1))


def edition(path: Column, language: Column) -> Column:
    """The language of a benchmark by its file or folder, else the one asked for, else ``mixed``."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    leaf, parent = F.element_at(parts, -1), F.get(parts, F.size(parts) - 2)
    named = lambda c: F.when(c.isin("en", "zh"), c)
    return F.coalesce(named(leaf), named(parent), F.nullif(language, F.lit("")), F.lit("mixed"))


#: Words of page types and descriptions that tell whether a page is interactive.
STILL_TYPES = ("illustration", "animation", "art", "display", "decoration", "static")
USED_TYPES = ("game", "app", "tool", "dashboard", "form", "editor", "calculator")
SEEN_ACTIONS = ("click", "button", "input", "drag", "keyboard", "key", "submit", "toggle", "slider")
ASKED_ACTIONS = ("click", "button", "input", "keyboard", "drag", "interact", "control")
STILL_WORDS = ("svg", "animation", "illustration", "art", "display", "visualization", "ornament", "decoration", "scene", "landscape", "portrait", "pattern", "drawing")


def is_interactive(page_type: Column, seen: Column, asked: Column, keys_work: Column, interaction: Column, functionality: Column, summary: Column) -> Column:
    """Whether a page wants interaction: by its type, by what an observer saw (array), by its requirements (array), by working keys; pages
    that work well but score low in interaction count as still if their summary says so."""
    kind = F.lower(F.coalesce(page_type, F.lit("")))
    some = lambda texts, words: F.exists(texts, lambda t: any_of(F.lower(t), words))
    still = (functionality >= 22) & (interaction < 18) & any_of(F.lower(F.coalesce(summary, F.lit(""))), STILL_WORDS)
    return (
        F.when(any_of(kind, STILL_TYPES), False).when(any_of(kind, USED_TYPES), True).when(some(seen, SEEN_ACTIONS) | some(asked, ASKED_ACTIONS), True)
        .when(keys_work | (interaction >= 20), True).otherwise(~still)
    )


def contrastive_feedback(iteration: Column, before: Column, after: Column, improved: Column, regressed: Column, unchanged: Column, priority: Column) -> Column:
    """What a comparison of two renderings tells the next repair, as text; sections without entries are left out."""
    head = F.format_string("## Contrastive Visual Feedback (iteration %d: %d → %d, %+d)", iteration, before, after, after - before)
    part = lambda title, mark, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit(f"  {mark} "), i)), "\n")))
    last = F.when(F.coalesce(priority, F.lit("")) != "", F.concat(F.lit("\nPriority for this iteration: "), priority))
    return F.concat_ws(
        "\n", head, part("What improved after last repair:", "+", improved), part("What REGRESSED (MUST fix — do not repeat this mistake):", "!", regressed),
        part("Issues still present (focus here):", "-", unchanged), last,
    )


def weak_dimensions(scores: Column, maxima: dict[str, int]) -> Column:
    """Dimension names, weakest share of their maximum first; equal shares in the order of ``maxima``."""
    ranked = F.array(*(F.struct((scores[n] / most).alias("share"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, most) in enumerate(maxima.items())))
    return F.transform(F.array_sort(ranked), lambda d: d["name"])
