"""Validation of benchmark items and audits of their test cases.

Items are nested (``test_cases`` with ``steps``); they are unrolled once and every rule is a column over the steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.taxonomy import stripped
from ..sources.staging import cut

#: All actions of a step.
ACTIONS = (
    "wait_for", "wait", "click", "click_text", "type", "press_key", "scroll", "eval_js", "drag", "hover", "focus", "contextmenu", "select_option", "check", "screenshot", "resize",
    "assert_visible", "assert_not_visible", "assert_text_contains", "assert_text_not_contains", "assert_count", "assert_attribute", "assert_console_clean", "assert_screenshot_changed",
    "assert_screenshot_not_blank", "assert_js_value", "assert_style", "assert_no_horizontal_scroll", "assert_semantic_html", "assert_a11y_basic",
)
#: Actions that need a selector.
SELECTING = (
    "wait_for", "click", "type", "hover", "focus", "contextmenu", "select_option", "check", "assert_visible", "assert_not_visible", "assert_text_contains", "assert_text_not_contains", "assert_count", "assert_attribute", "assert_style",
)
#: Assertions that say something about state.
SEMANTIC = ("assert_js_value", "assert_text_contains", "assert_count", "assert_visible", "assert_not_visible", "assert_attribute", "assert_style", "assert_semantic_html", "assert_a11y_basic", "assert_no_horizontal_scroll")
#: Fragments of expressions that were cut off.
CUT_OFF = ("[href^=const", "[href*=const", "[src^=const")
#: Words of prompts that ask for a form.
FORM_WORDS = ("form", "submit", "login", "register", "signup", "sign up", "send", "save", "email", "message", "contact", "booking", "application", "feedback", "survey", "rsvp", "checkout")
#: Words of prompts that ask for adding, for an editor, for a heat map.
ADD_WORDS = ("add", "new", "create", "insert", "task", "todo", "card", "item", "note", "event", "entry")
EDITOR_WORDS = ("markdown", "editor", "preview", "rich text", "bold", "format", "document", "whiteboard", "canvas editor")
HEATMAP_WORDS = ("heatmap", "matrix", "correlation", "calendar", "grid", "cell")
#: Names of cases that only say that something changes; texts of cases that come from another template.
GENERIC_NAMES = (
    "click triggers interaction", "keyboard input changes", "button click changes", "hover button", "visual changes", "visible reaction", "changes canvas", "screenshot changed", "game click triggers interaction",
)
EMPTY_SUBMIT = "empty submit shows validation"
ADD_BUTTON = ("'add' feature button present as prompt requires", "add feature button")
EDITOR_MARKS = ("bold/formatting", "bold button", "preview updates in real-time")
#: How grave risks are, gravest first within a report.
SEVERITY = {
    "validator_error": "error", "screenshot_changed_without_prior_screenshot": "error", "exact_duplicate_steps": "high", "duplicate_tc_name": "medium", "cross_template_empty_submit": "high",
    "cross_template_add_button": "high", "cross_template_markdown_editor": "high", "cross_template_heatmap": "medium", "visual_change_only_tc": "medium", "generic_screenshot_not_blank": "medium",
    "broad_surface_visible": "medium", "high_tc_density": "low",
}
#: Cases over which an item has very many, steps up to which a visual check is short.
MANY_CASES, FEW_STEPS = 45, 5
SURFACES = ("svg, canvas", "canvas, svg", "svg,canvas", "canvas,svg")
STEP = "struct<pos:long, action:string, selector:string, expression:string, gte:long, eq:long>"
ITEMS = f"item_id string, prompt string, test_cases array<struct<id:string, name:string, weight:double, steps:array<{STEP}>>>"


def steps(items: DataFrame) -> DataFrame:
    """One row per step: item, case, position, the step's fields and whether a screenshot was taken before it; a case without steps has
    one row with null position."""
    cases = items.select("item_id", "prompt", F.explode("test_cases").alias("tc"))
    taken = F.array_position(F.transform("tc.steps", lambda s: s["action"]), "screenshot")
    rows = cases.select("item_id", "prompt", F.col("tc.id").alias("tc_id"), F.col("tc.name").alias("name"), F.size("tc.steps").alias("n_steps"), taken.alias("taken"), F.posexplode_outer("tc.steps").alias("at", "s"))
    return rows.select("item_id", "prompt", "tc_id", "name", "n_steps", "s.*", ((F.col("taken") > 0) & (F.col("at") >= F.col("taken"))).alias("seeded"))


def _contains_any(text: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


def empty_group(selector: Column) -> Column:
    """Whether a selector is empty or has an empty part between commas."""
    return F.exists(F.split(F.coalesce(selector, F.lit("")), ","), lambda p: stripped(p) == "")


def bad_selectors(expression: Column) -> Column:
    """Whether a querySelector call of the expression has a literal with an empty part."""
    found = F.regexp_extract_all(expression, F.lit("(?s)querySelector(?:All)?\\(\\s*(['\"])(.*?)\\1"), 2)
    return F.exists(found, empty_group)


def step_rules(of: Callable[[str], Column], seeded: Column) -> list[Column]:
    """A column per rule for one step, whose fields ``of`` gives: the rule's name, or null where it is kept."""
    action, text = F.coalesce(of("action"), F.lit("")), F.coalesce(of("expression"), F.lit(""))
    known, runs = action.isin(*ACTIONS), action.isin("assert_js_value", "eval_js")
    step = of("pos").isNotNull()
    written = runs & (stripped(text) != "")
    return [
        F.when(~step, "no steps"), F.when(step & (action == ""), "missing action"), F.when(step & (action != "") & ~known, "unknown action"), F.when(known & action.isin(*SELECTING) & empty_group(of("selector")), "empty selector"),
        F.when((action == "assert_count") & (F.lower(stripped(of("selector"))) == "body") & (F.coalesce(of("gte") > 1, F.lit(False)) | F.coalesce(of("eq") > 1, F.lit(False))), "vacuous body count"),
        F.when((action == "assert_screenshot_changed") & ~seeded, "screenshot seed missing"), F.when(runs & (stripped(text) == ""), "empty expression"),
        F.when(written & bad_selectors(text), "malformed querySelector"), F.when(written & _contains_any(text, CUT_OFF), "truncated fragment"),
    ]


def _scripted(of: Callable[[str], Column]) -> Column:
    """Whether a step has a script that may be unbalanced."""
    return of("action").isin("assert_js_value", "eval_js") & (stripped(of("expression")) != "") & ~_contains_any(of("expression"), CUT_OFF)


def violations(items: DataFrame) -> DataFrame:
    """(item_id, tc_id, pos, rule) for every broken rule but unbalanced delimiters; a step without a known action breaks that rule only."""
    rows = steps(items)
    rules = F.array(*step_rules(F.col, F.col("seeded")))
    return rows.select("item_id", "tc_id", "pos", F.explode_outer(F.filter(rules, lambda r: r.isNotNull())).alias("rule")).where("rule is not null")


def missing_parts(items: DataFrame) -> DataFrame:
    """(item_id, tc_id, pos, rule) for items without id, prompt or test cases that are a list, and cases without id or name."""
    present = lambda rules: F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule")
    none = F.lit(None).cast("string").alias("tc_id"), F.lit(None).cast("long").alias("pos")
    cases = items.select("item_id", F.explode("test_cases").alias("tc"))
    found = cases.select("item_id", F.col("tc.id").alias("tc_id"), F.lit(None).cast("long").alias("pos"), present(_case_rules()))
    return items.select("item_id", *none, present(_item_rules())).unionByName(found)


def _item_rules() -> list[Column]:
    return [F.when(F.col("item_id").isNull(), "missing id"), F.when(F.col("prompt").isNull(), "missing prompt"), F.when(F.col("test_cases").isNull(), "test cases aren't a list")]


def _case_rules() -> list[Column]:
    return [F.when(F.col("tc.id").isNull(), "missing case id"), F.when(F.col("tc.name").isNull(), "missing case name")]


def all_violations(items: DataFrame) -> DataFrame:
    """(item_id, tc_id, pos, rule) for all fifteen rules."""
    open_ended = unbalanced_steps(items).select("item_id", "tc_id", "pos", F.lit("unbalanced delimiters").alias("rule"))
    return violations(items).unionByName(missing_parts(items)).unionByName(open_ended)


@F.pandas_udf(BooleanType())
def unbalanced(expressions: pd.Series) -> pd.Series:
    """Whether quotes, brackets or a regular-expression literal of a script stay open or close wrongly."""
    return expressions.map(_is_unbalanced)


def _is_unbalanced(text: str | None) -> bool:
    """Scans by tokens: a quoted string, a regular-expression literal (where an operand may begin), or one character."""
    import re

    quoted = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`", re.DOTALL)
    literal = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*/", re.DOTALL)
    opened, last, at, text = [], "", 0, text or ""
    while at < len(text):
        c = text[at]
        if c in "'\"`" or (c == "/" and last in ("", *"([{=:,;!?&|")):
            token = (literal if c == "/" else quoted).match(text, at)
            if not token:
                return True
            at, last = token.end(), "/" if c == "/" else last
            continue
        if c in ")]}" and (not opened or opened.pop() + c not in ("()", "[]", "{}")):
            return True
        if c in "([{":
            opened.append(c)
        if not c.isspace():
            last = c
        at += 1
    return bool(opened)


#: A word without blanks out of each mark that a case's text is searched for.
MARK_WORDS = ("validation", "requires", "feature", "bold", "preview", "markdown", "heatmap")


def audit(items: DataFrame) -> DataFrame:
    """(item_id, tc_id, risk) for risks of cases: repeats, checks of another template, visual checks only; without a case for items with very many."""
    plain = lambda c: F.lower(stripped(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")))
    # All fields of a step but its place tell it from others.
    signature = lambda tc: F.to_json(F.transform(tc["steps"], lambda s: s.dropFields("pos")))
    # Repeats are found within an item's own array, so items without an id stay apart.  Rules of an item, and whether it has very many cases, go with its first row.
    own = items.select(
        "item_id", F.array(*_item_rules()).alias("own"), F.coalesce(F.size("test_cases") > MANY_CASES, F.lit(False)).alias("crowded"), plain(F.col("prompt")).alias("prompt"), F.transform("test_cases", signature).alias("signatures"),
        F.transform("test_cases", lambda tc: plain(tc["name"])).alias("names"), F.posexplode_outer("test_cases").alias("at", "tc"),
    )
    there, first = F.col("at").isNotNull(), F.coalesce(F.col("at") == 0, F.lit(True))
    flat = own.withColumns({"signature": F.get("signatures", F.col("at")), "name": F.get("names", F.col("at"))})
    again = lambda values, c: F.array_position(values, F.col(c)) <= F.col("at")
    # White space of a text that has no word of a mark needn't be made plain.
    low = F.lower("signature")
    flat = flat.select(
        "item_id", "prompt", "tc", F.col("tc.id").alias("tc_id"), "name", F.col("tc.steps").alias("steps"), again("signatures", "signature").alias("same_steps"), again("names", "name").alias("same_name"), there.alias("there"),
        F.concat_ws(" ", "name", F.when(_contains_any(low, MARK_WORDS), plain(F.col("signature")))).alias("text"), F.array_position(F.transform("tc.steps", lambda s: s["action"]), "screenshot").alias("taken"),
        F.when(first, F.col("own")).alias("own"), (first & F.col("crowded")).alias("crowded"),
    )
    has = lambda *actions: F.exists("steps", lambda s: s["action"].isin(*actions))
    text, taken = F.col("text"), F.col("taken")
    risks = F.array(
        F.when(F.col("same_steps"), "exact_duplicate_steps"), F.when(F.col("same_name") & (F.col("name") != ""), "duplicate_tc_name"), F.when(F.contains(text, F.lit(EMPTY_SUBMIT)) & ~_contains_any(F.col("prompt"), FORM_WORDS), "cross_template_empty_submit"),
        F.when(_contains_any(text, ADD_BUTTON) & ~_contains_any(F.col("prompt"), ADD_WORDS), "cross_template_add_button"),
        F.when((_contains_any(text, EDITOR_MARKS) | (F.contains(text, F.lit("markdown")) & ~F.contains("prompt", F.lit("markdown")))) & ~_contains_any(F.col("prompt"), EDITOR_WORDS), "cross_template_markdown_editor"),
        F.when(F.contains(text, F.lit("heatmap")) & ~_contains_any(F.col("prompt"), HEATMAP_WORDS), "cross_template_heatmap"),
        F.when(has("assert_screenshot_changed") & ~has(*SEMANTIC) & (_contains_any(F.col("name"), GENERIC_NAMES) | (F.size("steps") <= FEW_STEPS)), "visual_change_only_tc"),
    )
    # Risks of steps count once per step.
    def of_step(s: Column, i: Column) -> Column:
        seed = F.when((s["action"] == "assert_screenshot_changed") & ((taken == 0) | (i < taken)), "screenshot_changed_without_prior_screenshot")
        blank = F.when(s["action"] == "assert_screenshot_not_blank", "generic_screenshot_not_blank")
        return F.coalesce(seed, blank, F.when((s["action"] == "assert_visible") & plain(s["selector"]).isin(*SURFACES), "broad_surface_visible"))

    nested = F.flatten(F.transform("steps", lambda s, i: F.array(*step_rules(lambda f: s[f], (taken > 0) & (i >= taken)))))
    rules = F.when(F.coalesce(F.size("steps"), F.lit(0)) > 0, nested).otherwise(F.when(F.col("there"), F.array(F.lit("no steps"))))
    scripts = F.transform(F.filter("steps", lambda s: _scripted(lambda f: s[f])), lambda s: s["expression"])
    # The nested items are gone through once; what is written is narrow, and each branch reads one column of it.
    found = flat.select("item_id", "tc_id", F.concat(risks, F.coalesce(F.transform("steps", of_step), F.array().cast("array<string>"))).alias("risks"), rules.alias("rules"), F.when(F.col("there"), F.array(*_case_rules())).alias("lacking"), "own", scripts.alias("scripts"), "crowded")
    found = cut(found, "audited")
    none, invalid = F.lit(None).cast("string").alias("tc_id"), F.lit("validator_error").alias("risk")
    of = lambda name: F.explode(F.filter(name, lambda r: r.isNotNull()))
    broken = found.select("item_id", "tc_id", of("rules").alias("rule")).unionByName(found.select("item_id", "tc_id", of("lacking").alias("rule"))).unionByName(found.select("item_id", none, of("own").alias("rule")))
    open_ended = found.select("item_id", "tc_id", F.explode("scripts").alias("script")).where(unbalanced("script"))
    crowded = found.where("crowded").select("item_id", none, F.lit("high_tc_density").alias("risk"))
    return found.select("item_id", "tc_id", of("risks").alias("risk")).unionByName(crowded).unionByName(broken.select("item_id", "tc_id", invalid)).unionByName(open_ended.select("item_id", "tc_id", invalid))


def severity(risk: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))[risk], F.lit("low"))


def risk_table(risks: DataFrame) -> DataFrame:
    """Risks by severity, then by how often, then by name: risk, severity, count, place."""
    counts = risks.groupBy("risk").agg(F.count("*").alias("count")).withColumn("severity", severity(F.col("risk")))
    grade = F.array_position(F.array(*map(F.lit, ("error", "high", "medium", "low"))), F.col("severity"))
    # One row per kind of risk, twelve at most.
    return counts.withColumn("place", F.row_number().over(W.orderBy(grade, F.desc("count"), "risk")).cast("long"))


def risky_items(risks: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` items with most risks but violations; ties by id."""
    own = risks.where("risk <> 'validator_error'").groupBy("item_id").agg(F.count("*").alias("risk_count"))
    return own.orderBy(F.desc("risk_count"), "item_id").limit(top)


def examples(risks: DataFrame, most: int = 25) -> DataFrame:
    """The first ``most`` cases of each risk by item and case; Spark keeps as many per task before it shuffles."""
    nth = F.row_number().over(W.partitionBy("risk").orderBy("item_id", F.col("tc_id").asc_nulls_first()))
    return risks.select("risk", "item_id", "tc_id").distinct().withColumn("nth", nth.cast("long")).where(F.col("nth") <= most)


def alignment(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(pos, kind, field) where two editions of a benchmark differ, by position: rows on one side only, other ids, other fields."""
    a = left.select("pos", F.struct("item_id", *fields).alias("a"))
    b = right.select("pos", F.struct("item_id", *fields).alias("b"))
    both = a.join(b, "pos", "full")
    differs = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit("metadata_mismatch").alias("kind"), F.lit(f).alias("field"))) for f in fields]
    one = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit("item_id").alias("field")))
    kinds = F.when(F.col("b").isNull(), one("missing_right")).when(F.col("a").isNull(), one("missing_left")).when(~F.col("a.item_id").eqNullSafe(F.col("b.item_id")), one("id_mismatch")).otherwise(F.filter(F.array(*differs), lambda d: d.isNotNull()))
    return both.select("pos", F.explode(kinds).alias("m")).select("pos", "m.*")


def parsed_cases(items: DataFrame) -> DataFrame:
    """(item_id, id, name, weight, steps, error) of test cases as a runner takes them: missing ids are numbered, names are empty, weights 1.

    A case with an unknown action has an error (its first one) and no steps.
    """
    cases = items.select("item_id", F.posexplode("test_cases").alias("at", "tc"))
    unknown = F.get(F.filter("tc.steps", lambda s: ~F.coalesce(s["action"], F.lit("")).isin(*ACTIONS)), 0)["action"]
    bad = F.exists("tc.steps", lambda s: ~F.coalesce(s["action"], F.lit("")).isin(*ACTIONS))
    filled = F.transform("tc.steps", lambda s: F.struct(s["action"].alias("action"), F.coalesce(s["selector"], F.lit("")).alias("selector"), F.coalesce(s["expression"], F.lit("")).alias("expression"), s["gte"].alias("gte"), s["eq"].alias("eq")))
    return cases.select(
        "item_id", F.coalesce("tc.id", F.format_string("tc_%03d", "at")).alias("id"), F.coalesce("tc.name", F.lit("")).alias("name"), F.coalesce("tc.weight", F.lit(1.0)).alias("weight"),
        F.when(bad, F.slice(filled, 1, 0)).otherwise(filled).alias("steps"), F.when(bad, F.concat(F.lit("Unknown test action: "), F.coalesce(unknown, F.lit("")))).alias("error"),
    )


def case_alignment(left: DataFrame, right: DataFrame, fields: list[str], language: str = "zh") -> DataFrame:
    """(pos, case, kind, field) where the items of two editions differ by position: pos, item_id, language, ``fields`` and test_cases.

    Other ids end an item's comparison; then languages, fields, the number of cases, and case by case ids, weights, the number of
    steps, or else the sequence of actions.
    """
    columns = ["item_id", "language", *fields, "test_cases"]
    a, b = (x.select("pos", F.struct(*columns).alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, "pos").withColumn("same", F.col("a.item_id").eqNullSafe(F.col("b.item_id")))
    entry = lambda kind, field, case=None: F.struct(F.lit(case).cast("long").alias("case"), F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    differ = lambda name: ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    ours, theirs = (F.coalesce(f"{n}.test_cases", F.array().cast(dict(left.dtypes)["test_cases"])) for n in "ab")
    top = F.array(
        F.when(~F.col("b.language").eqNullSafe(F.lit(language)), entry("language_mismatch", "language")),
        *(F.when(differ(f), entry("metadata_mismatch", f)) for f in fields), F.when(F.size(ours) != F.size(theirs), entry("tc_count_mismatch", "test_cases")),
    )

    def of_case(pair: Column, i: Column) -> Column:
        x, y = pair["x"], pair["y"]
        named = lambda kind, field: F.struct((i + 1).cast("long").alias("case"), F.lit(kind).alias("kind"), F.lit(field).alias("field"))
        actions = lambda tc: F.transform(F.coalesce(tc["steps"], F.array()), lambda s: s["action"])
        u, v = actions(x), actions(y)
        steps = F.when(F.size(u) != F.size(v), named("step_count_mismatch", "steps")).when(~u.eqNullSafe(v), named("step_action_sequence_mismatch", "steps"))
        return F.array(F.when(~x["id"].eqNullSafe(y["id"]), named("tc_id_mismatch", "id")), F.when(~x["weight"].eqNullSafe(y["weight"]), named("tc_weight_mismatch", "weight")), steps)

    n = F.least(F.size(ours), F.size(theirs))
    pairs = F.zip_with(F.slice(ours, F.lit(1), n), F.slice(theirs, F.lit(1), n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    found = F.when(F.col("same"), F.concat(top, F.flatten(F.transform(pairs, of_case)))).otherwise(F.array(entry("id_mismatch", "item_id")))
    return both.select("pos", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("m")).select("pos", "m.*")


def unbalanced_steps(items: DataFrame) -> DataFrame:
    rows = steps(items).where(_scripted(F.col))
    return rows.where(unbalanced("expression")).select("item_id", "tc_id", "pos", "expression")


def json_objects(texts: DataFrame) -> DataFrame:
    """(id, object): the first JSON object in each text that parses, from whichever brace, or null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        decoder = json.JSONDecoder()

        def first(text: str | None) -> str | None:
            at = (text or "").find("{")
            while at >= 0:
                try:
                    return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True)
                except (ValueError, RecursionError):
                    at = text.find("{", at + 1)
            return None

        for part in parts:
            yield pd.DataFrame({"id": part["id"], "object": part["text"].map(first)})

    return texts.select("id", "text").mapInPandas(run, "id long, object string")
