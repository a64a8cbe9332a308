"""Test cases as a runner takes them, from objects without a schema, and results as they are written: typed, with defaults and caps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import ACTIONS

#: A step's fields with their types and what stands for a missing one.
FIELDS: dict[str, tuple[str, object]] = {
    "action": ("string", ""), "selector": ("string", ""), "text": ("string", ""), "text_pattern": ("string", ""), "key": ("string", ""), "repeat": ("long", 1), "timeout": ("long", 5000), "ms": ("long", 0), "threshold": ("double", 0.95),
    "width": ("long", 0), "height": ("long", 0), "from_pos": ("array<long>", None), "to_pos": ("array<long>", None), "gte": ("long", None), "lte": ("long", None), "eq": ("long", None), "expression": ("string", ""), "expected": ("variant", None),
    "attr": ("string", ""), "value": ("string", ""), "property": ("string", ""), "tags": ("array<string>", None), "label": ("string", ""), "direction": ("string", ""), "amount": ("long", 300),
}
COMPACT = ("action", "selector", "expression", "key", "text", "text_pattern", "tags")
#: Errors of a phase, and of probes, that a written result holds at most.
ERRORS = 5
OBJECT, LIST = "map<string, variant>", "array<variant>"


def _field(v: Column, name: str, kind: str, default: object) -> Column:
    """A field of an object (a variant): the default stands for a missing key only, a null stays one."""
    typed = F.try_variant_get(v, f"$.{name}", kind)
    return typed if default is None else F.coalesce(typed, F.when(_lacks(v, name), F.lit(default).cast(kind)))


def _lacks(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant").isNull()


def _items(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", LIST), F.array().cast(LIST))


def parsed(cases: Column, fields: Iterable[str] = tuple(FIELDS)) -> Column:
    """(cases, error) of a list of test cases (a variant): id, name, weight and steps with ``fields`` (all ``FIELDS``); missing ids are numbered.

    The first unknown action makes the whole list an error, without cases.  No list: no cases.
    """
    objects = F.coalesce(cases.try_cast(LIST), F.array().cast(LIST))
    # Fields are looked up in the variants; a map of them would copy all fields once for each that is read.
    step = lambda s: F.struct(*(_field(s, n, *FIELDS[n]).alias(n) for n in fields))
    steps = lambda c: F.transform(_items(c, "steps"), step)
    ident = lambda c, i: F.coalesce(_field(c, "id", "string", None), F.when(_lacks(c, "id"), F.format_string("tc_%03d", i)))
    typed = F.transform(objects, lambda c, i: F.struct(ident(c, i).alias("id"), _field(c, "name", "string", "").alias("name"), _field(c, "weight", "double", 1.0).alias("weight"), steps(c).alias("steps")))
    action = lambda s: _field(s, "action", "string", "")
    unknown = lambda c: F.filter(F.transform(_items(c, "steps"), action), lambda a: ~F.coalesce(a, F.lit("None")).isin(*ACTIONS))
    told = lambda c: F.concat(F.lit("Unknown test action: "), F.coalesce(F.concat(F.lit("'"), F.get(unknown(c), 0), F.lit("'")), F.lit("None")), F.lit(" in test case "), F.coalesce(_field(c, "id", "string", "?"), F.lit("None")))
    error = F.get(F.transform(F.filter(objects, lambda c: F.size(unknown(c)) > 0), told), 0)
    return F.struct(F.when(error.isNull(), typed).alias("cases"), error.alias("error"))


def compact(cases: Column) -> Column:
    """Parsed cases as they are kept beside their results: what a score needs of each step."""
    value = lambda s, n: F.coalesce(s[n], F.array().cast("array<string>")) if n == "tags" else s[n]
    return F.transform(cases, lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), c["weight"].alias("weight"), F.transform(c["steps"], lambda s: F.struct(*(value(s, n).alias(n) for n in COMPACT))).alias("steps")))


def written() -> Column:
    """A result as one JSON object, from columns: source (variant object), score (struct), dataset, status, output_dir, skip_reason,
    timeout_phase, elapsed_ms, phases (array), fallback (boolean), fallback_reason, extract (struct or null), render (struct or null: rendered,
    keyframes_selected, total_frames_captured, probe_errors, errors), screenshots (array), tests (struct or null), phase_errors (map of arrays).

    What a run says replaces fields of the source; its own line number goes.  Of errors the first five are kept, of phases those with
    errors; what isn't known is left out.
    """
    c = F.col
    skipped = c("skip_reason").isNotNull() & (c("skip_reason") != "")
    first = lambda a: F.slice(F.coalesce(a, F.array().cast("array<string>")), 1, ERRORS)
    count = lambda a: F.coalesce(F.size(a), F.lit(0))
    render = F.when(c("render").isNotNull(), F.struct(
        c("render.rendered").alias("rendered"), count(c("screenshots")).alias("screenshot_count"), F.coalesce("render.keyframes_selected", F.lit(0)).alias("keyframes_selected"), F.coalesce("render.total_frames_captured", F.lit(0)).alias("total_frames_captured"),
        count(c("render.probe_errors")).alias("probe_errors_count"), first(c("render.probe_errors")).alias("probe_errors"), first(c("render.errors")).alias("phase_errors"),
    ))
    failing = F.map_filter("phase_errors", lambda _, e: F.size(e) > 0)
    errors = F.when(F.size(failing) > 0, F.transform_values(failing, lambda _, e: F.slice(e, 1, ERRORS)))
    own = F.struct(
        c("score"), c("dataset"), c("status").alias("eval_status"), F.concat("output_dir", F.lit("/report.md")).alias("report"), F.when(skipped, c("skip_reason")).alias("skip_reason"), F.when(skipped, c("timeout_phase")).alias("timeout_phase"),
        F.when(skipped, F.bround("elapsed_ms", 1)).alias("timeout_elapsed_ms"), F.when(skipped, c("phases")).alias("completed_phases_before_timeout"), F.when(c("fallback"), F.lit(True)).alias("fallback_scoring"),
        F.when(c("fallback"), F.coalesce("fallback_reason", "skip_reason")).alias("fallback_reason"), c("extract").alias("extract_summary"), render.alias("render_summary"), c("tests").alias("test_runner_summary"), errors.alias("phase_errors"),
    )
    told = F.parse_json(F.to_json(own)).cast(OBJECT)
    kept = F.map_filter(c("source").cast(OBJECT), lambda k, _: (k != "_line_idx") & ~F.map_contains_key(told, k))
    return F.to_json(F.map_concat(kept, told))


def write_delimited(rows: DataFrame, path: str, separator: str = ",") -> None:
    """Writes a table as text with a header, values apart by a comma, a tab or another sign."""
    rows.write.option("header", "true").option("sep", separator).option("emptyValue", "").csv(path)


def read_delimited(rows: DataFrame, path: str, separator: str = ",") -> DataFrame:
    """Reads such a text with the schema of ``rows``."""
    return rows.sparkSession.read.schema(rows.schema).option("header", "true").option("sep", separator).csv(path)


def markdown_line(*cells: Column) -> Column:
    """A table's line; signs that end a cell are escaped, nulls are empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for x in cells)), F.lit(" |"))
