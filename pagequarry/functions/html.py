"""Pages in model answers, and static features of pages, as columns.

Features are regular expressions and counts over one column, so that one projection reads a page once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taxonomy import stripped

FENCE = "```"
SEMANTIC_TAGS = ("header", "main", "section", "nav", "footer", "article", "aside")
EVENTS = "click|change|input|submit|keydown|keyup|keypress|mousedown|mouseup|mousemove|mouseenter|mouseleave|touchstart|touchmove|pointerdown|pointerup|dragstart|dragover|drop"
#: What shows that a page listens to the keyboard.
KEYBOARD_MARKS = ("keydown", "keyup", "keypress", "arrowup", "arrowdown", "arrowleft", "arrowright", "e.key", "e.code", "e.which", "keycode", "key === 'w'", "key === 'a'", "key === 's'", "key === 'd'")
#: Feature -> pattern that shows it.
FLAGS = {
    "has_canvas": "(?i)<canvas",
    "has_script": "(?i)<script",
    "has_style": "(?i)<style",
    "has_svg": "(?i)<svg",
    "has_requestanimationframe": "(?i)requestanimationframe",
    "has_form": "(?i)<form",
    "has_textarea": "(?i)<textarea",
    "has_select": "(?i)<select",
    "has_range": "(?i)<input[^>]*type=[\"']?range",
    "has_checkbox": "(?i)<input[^>]*type=[\"']?(checkbox|radio)",
    "has_audio": "(?i)<audio|new\\s+Audio|AudioContext|webkitAudioContext",
    "has_video": "(?i)<video",
    "has_threejs": "THREE\\.\\w|from\\s+['\"]three['\"]|import.*THREE",
    "has_webgl": "(?i)getContext\\s*\\(\\s*['\"]webgl",
    "has_title": "(?is)<title[^>]*>.+</title>",
    "has_meta_viewport": "(?i)<meta[^>]*viewport",
    "has_lang_attr": "(?i)<html[^>]*\\blang\\s*=",
    "has_media_queries": "@media\\s",
    "has_css_transitions": "(?i)transition\\s*:",
    "has_css_animations": "(?i)@keyframes\\s|animation\\s*:",
    "has_css_variables": "var\\(--",
    "has_flexbox": "(?i)display\\s*:\\s*flex",
    "has_grid": "(?i)display\\s*:\\s*grid",
    "has_gradient": "(?i)gradient\\s*\\(",
    "has_opacity_usage": "(?i)opacity\\s*:",
    "has_hover_css": ":hover\\s*\\{",
    "has_addeventlistener": "addEventListener",
}
#: Fixed value: inputs that take text.
TYPED_INPUT = "(?i)<input[^>]*type=[\"']?(text|email|password|search|number|tel|url)"


def count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern)).cast("long")


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def input_types(html: Column) -> Column:
    low = F.lower(html)
    down, move = any_of(low, ("mousedown", "pointerdown")), any_of(low, ("mousemove", "pointermove"))
    touch, touched = F.contains(low, F.lit("touchstart")), F.contains(low, F.lit("touchmove"))
    found = F.array(
        F.when(any_of(low, KEYBOARD_MARKS), "keyboard"), F.when(any_of(low, ("click", "mousedown", "pointerdown", "mouseup")), "mouse_click"), F.when((down & move) | (touch & touched), "mouse_drag"), F.when(touch, "touch")
    )
    return F.filter(found, lambda x: x.isNotNull())


def features(html: Column) -> dict[str, Column]:
    """Feature name -> column."""
    out = {"html_size": F.length(html).cast("long"), "has_doctype": F.startswith(F.lower(stripped(html)), F.lit("<!doctype"))}
    out |= {name: html.rlike(pattern) for name, pattern in FLAGS.items()}
    out["has_text_input"] = html.rlike(TYPED_INPUT) | html.rlike("(?i)<input(?![^>]*type=)[^>]*>")
    out["external_resources"] = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit("(?:src|href)=[\"'](https?://[^\"']+)[\"']"), 1)))
    out["ext_count"] = F.array_size(out["external_resources"]).cast("long")
    out["input_types"] = input_types(html)
    for tag in SEMANTIC_TAGS:
        out[f"{tag}_count"] = count(html, f"(?i)<{tag}\\b")
        out[f"has_{tag}"] = html.rlike(f"(?i)<{tag}\\b")
    out["semantic_layout_count"] = sum((out[f"has_{t}"].cast("long") for t in SEMANTIC_TAGS), F.lit(0).cast("long"))
    out |= {"h1_count": count(html, "(?i)<h1\\b"), "h2_count": count(html, "(?i)<h2\\b"), "addeventlistener_count": count(html, "addEventListener")}
    # An assignment like ".onclick =" counts as an attribute and as an assignment.
    out["event_handler_count"] = out["addeventlistener_count"] + count(html, f"(?i)\\bon(?:{EVENTS})\\s*=") + count(html, f"(?i)\\.\\s*on(?:{EVENTS})\\s*=")
    out["inline_style_count"] = count(html, "\\bstyle\\s*=\\s*[\"']")
    issues = F.array(F.when(~out["has_doctype"], "Missing DOCTYPE declaration"), F.when(out["html_size"] < 200, F.concat(F.lit("HTML very short ("), out["html_size"].cast("string"), F.lit(" chars)"))))
    out["issues"] = F.filter(issues, lambda x: x.isNotNull())
    return out


def probes(f: dict[str, Column]) -> dict[str, Column]:
    """Which of the browser probes apply to a page, from its features; the others always do."""
    has = lambda kind: F.array_contains(f["input_types"], kind)
    return {
        "probe_keyboard": has("keyboard"), "probe_canvas_click": has("mouse_click") | f["has_canvas"], "probe_form": f["has_text_input"] | f["has_textarea"], "probe_select": f["has_select"],
        "probe_range": f["has_range"], "probe_checkbox": f["has_checkbox"], "probe_drag": has("mouse_drag"), "probe_gameplay": (f["has_canvas"] & (f["has_requestanimationframe"] | f["has_threejs"])) | has("keyboard"),
    }


#: The page around a bare drawing.
SVG_OPEN = '<!DOCTYPE html><html><head><meta charset="utf-8"><style>body{margin:0;display:flex;justify-content:center;align-items:center;min-height:100vh;background:#fff}</style></head><body>'
SVG_CLOSE = "</body></html>"


def looks_like_html(text: Column) -> Column:
    return any_of(F.lower(text), ("<!doctype html", "<html", "<head", "<body", "```html"))


def wrapped(svg: Column) -> Column:
    return F.concat(F.lit(SVG_OPEN), svg, F.lit(SVG_CLOSE))


def completed(text: Column) -> Column:
    """A cut-off page: trailing fence dropped, open body and html closed; a bare drawing is wrapped."""
    bare = F.regexp_replace(stripped(text), "\\s*```+\\s*$", "")
    low = F.lower(bare)
    lacks = lambda tag: F.contains(low, F.lit(f"<{tag}")) & ~F.contains(low, F.lit(f"</{tag}>"))
    closed = F.concat(bare, F.when(lacks("body"), "\n</body>").otherwise(""), F.when(lacks("html"), "\n</html>").otherwise(""))
    return F.when(F.startswith(low, F.lit("<svg")), wrapped(bare)).otherwise(closed)


def candidates(text: Column, partial: bool) -> Column:
    """All page candidates of an answer, trimmed, distinct and not empty, in the order of the rules that found them.

    Closed fences with a page; an unclosed html fence (``partial``); closed svg or xml fences; whole pages with a doctype; and only
    while nothing was found: whole pages without one, a cut-off page (``partial``), drawings in an answer without page.
    """
    every = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), stripped)
    nothing = F.array().cast("array<string>")
    one = lambda use, value: F.when(use, F.array(value)).otherwise(nothing)
    holds = lambda x, *marks: any_of(F.lower(x), marks)
    fenced = F.filter(every("(?is)```(?:html)?\\s*\\n(.*?)```"), lambda x: holds(x, "<html", "<!doctype"))
    drawn = F.filter(every("(?is)```(?:svg|xml)\\s*\\n(.*?)```"), lambda x: holds(x, "<svg"))
    drawn = F.transform(drawn, lambda x: F.when(holds(x, "<html"), x).otherwise(wrapped(x)))
    found = F.concat(fenced, drawn, every("(?is)(<!DOCTYPE\\s+html[^>]*>.*?</html>)"))
    if partial:
        tail = F.regexp_extract(text, "(?is)^.*```html\\s*\\n(.*)$", 1)
        opened = one((tail != "") & ~F.contains(tail, F.lit("```")) & looks_like_html(tail), completed(tail))
        found = F.concat(fenced, opened, drawn, every("(?is)(<!DOCTYPE\\s+html[^>]*>.*?</html>)"))
    rest = every("(?is)(<html[^>]*>.*?</html>)")
    if partial:
        doctype, page = F.regexp_extract(text, "(?is)(<!DOCTYPE\\s+html[^>]*>.*)$", 1), F.regexp_extract(text, "(?is)(<html[^>]*>.*)$", 1)
        cut = F.when(doctype != "", doctype).otherwise(page)
        rest = F.when(F.array_size(rest) > 0, rest).otherwise(one((cut != "") & ~holds(cut, "</html>"), completed(cut)))
    svg = F.when(looks_like_html(text), nothing).otherwise(F.transform(every("(?is)(<svg[^>]*>.*?</svg>)"), wrapped))
    rest = F.when(F.array_size(rest) > 0, rest).otherwise(svg)
    out = F.when(F.array_size(found) > 0, found).otherwise(rest)
    return F.array_distinct(F.filter(F.transform(out, stripped), lambda x: x != ""))


def extract(text: Column, partial: bool = True) -> Column:
    """The longest candidate (the first of equal length); else the whole answer if it begins like a page or drawing; else null."""
    longest = lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best)
    best = F.aggregate(candidates(text, partial), F.lit(None).cast("string"), longest)
    whole = stripped(text)
    low = F.lower(whole)
    page = low.rlike("^(<!doctype|<html)")
    last = F.when(page, completed(whole)) if partial else F.when(page & F.contains(low, F.lit("</html>")), whole)
    return F.coalesce(best, last, F.when(F.startswith(low, F.lit("<svg")) & ~looks_like_html(text), wrapped(whole)))


def response_state(text: Column) -> Column:
    """Why an answer is or isn't valid: ok, empty, truncated or without a page."""
    low, whole = F.lower(text), extract(text, partial=False)
    cut = any_of(low, ("<html", "<!doctype", "```html"))
    return (
        F.when(stripped(text) == "", "empty").when(whole.isNotNull(), "ok").when(cut, "truncated_or_unextractable_html")
        .when(any_of(low, ("```svg", "```xml", "<svg")), "truncated_or_unextractable_svg").otherwise("no_extractable_html")
    )


def inject(html: Column, helper: str) -> Column:
    """``helper`` before the last closing body tag, else at the end."""
    parts = F.regexp_extract(html, "(?is)^(.*)(</body>.*)$", 1)
    rest = F.regexp_extract(html, "(?is)^(.*)(</body>.*)$", 2)
    return F.when(rest != "", F.concat(parts, F.lit(helper), rest)).otherwise(F.concat(html, F.lit(helper)))


def unwrapped(text: Column) -> Column:
    """A page without the prose or fence before it: as it is if it begins as a page, from behind an html fence, or from the page's start."""
    begins = F.lower(F.regexp_replace(text, "^\\s+", "")).rlike("^(<!doctype|<html)")
    behind = F.regexp_extract(text, "(?is)```html\\s*\\n(.*)$", 1)
    inner = F.regexp_replace(F.regexp_replace(behind, "\\s*```\\s*$", ""), "\\s+$", "")
    start = F.regexp_extract(text, "(?is)((?:<!doctype|<html).*)$", 1)
    return F.when(begins, text).when(behind != "", F.when(behind.rlike("```\\s*$"), inner).otherwise(behind)).when(start != "", start).otherwise(text)
