"""Two editions of a benchmark: bringing one in line with the other, and comparing their objects field by field.

Editions are tables with a row per item: ``file`` and ``pos`` (its place in the file) tell what belongs together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glossary import TERMS, Glossary
from ..sources.staging import cut

META = ("category", "source_category", "sub_type", "difficulty", "has_interaction")
#: Counters of a step, with their names in reports.
COUNTERS = {
    "text_steps": "text_assertion_steps_patched", "text_alternatives": "text_assertion_alternatives_added", "click_steps": "click_text_steps_patched", "click_alternatives": "click_text_alternatives_added",
    "source_skipped": "source_text_expressions_skipped", "risky": "high_risk_text_expressions", "script_steps": "js_steps_patched", "regexes": "js_regex_patches", "entries": "js_array_alternatives_added",
    "includes": "js_includes_patches",
}
READ = ("action", "text", "text_pattern", "expression")
#: Characters of a step whose edit a task keeps for its repeats, and how many edits it keeps.
SHORT_STEP, STEPS_KEPT = 1000, 4096
EDIT = "array<array<struct<text_pattern string, expression string, " + ", ".join(f"{c} int" for c in COUNTERS) + ">>>"


def step_edits(cases: Column, fields: list[str], terms: dict | None = None) -> Column:
    """What a glossary changes in each step of each case of an item, nested as the steps are."""
    glossary, own = Glossary(terms or TERMS), [f for f in READ if f in fields]

    @F.pandas_udf("string")
    def edits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def told(step: tuple) -> str:
            return json.dumps(glossary.step(dict(step)), ensure_ascii=False)

        known = lru_cache(STEPS_KEPT)(told)

        def one(step: dict) -> str:
            row = tuple(step.items())
            return (known if sum(len(x) for x in step.values() if x) <= SHORT_STEP else told)(row)

        for part in parts:
            yield part.map(lambda nested: "[" + ",".join("[" + ",".join(map(one, steps)) + "]" for steps in json.loads(nested)) + "]")

    read = F.transform(cases, lambda c: F.transform(F.coalesce(c["steps"], F.array()), lambda s: F.struct(*(s[f].alias(f) for f in own))))
    return F.from_json(edits(F.to_json(read)), EDIT)


def alternatives(text: Column, terms: dict | None = None) -> Column:
    """Counterparts of the glossary's terms in a text, as an array in the glossary's order; of a null none."""
    glossary = Glossary(terms or TERMS)

    @F.pandas_udf("array<string>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: glossary.alternatives(t or ""))

    return found(text)


def _step_fields(df: DataFrame) -> list[str]:
    return df.schema["test_cases"].dataType.elementType["steps"].dataType.elementType.names


def bilingual_cases(rows: DataFrame, terms: dict | None = None) -> DataFrame:
    """``rows`` with test cases whose texts are sought in both languages, and ``edits``, what was changed step by step.

    All other fields of cases and steps stay.  A case without steps has an empty list of them.  Null cases are none.
    """
    fields = _step_fields(rows)
    kind = dict(rows.dtypes)["test_cases"]
    known = rows.withColumn("test_cases", F.coalesce("test_cases", F.array().cast(kind)))
    known = known.withColumn("edits", step_edits(F.col("test_cases"), fields, terms))

    def one(step: Column, edit: Column) -> Column:
        for name in ("text_pattern", "expression"):
            if name in fields:
                step = step.withField(name, F.coalesce(edit[name], step[name]))
        return step

    def case(c: Column, i: Column) -> Column:
        return c.withField("steps", F.zip_with(F.coalesce(c["steps"], F.slice(c["steps"], 1, 0), F.array()), F.get("edits", i), one))

    return known.withColumn("test_cases", F.transform("test_cases", case))


def checked(both: DataFrame) -> None:
    """ValueError if two editions (file, pos, a and b: structs with item_id, null where a side has no row) have other numbers of rows in a
    file, or other ids at a place."""
    sizes = both.groupBy("file").agg(F.count("a").alias("main"), F.count("b").alias("other")).where("main <> other").orderBy("file").first()
    if sizes is not None:
        raise ValueError(f"line count mismatch for {sizes.file}: {sizes.main} and {sizes.other}")
    odd = both.where(~F.col("a.item_id").eqNullSafe(F.col("b.item_id"))).orderBy("file", "pos").first()
    if odd is not None:
        raise ValueError(f"id mismatch {odd.file}:{odd.pos}: {odd.a.item_id} and {odd.b.item_id}")


def synced(main: DataFrame, other: DataFrame, language: str = "zh", fields: tuple[str, ...] = META, terms: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The other edition made anew from the main one: rows, counters (name, n), and the first 30 risks (place, label).

    Rows meet by place; other numbers of rows or other ids raise ValueError.  Everything is copied from the main edition but the prompt, which
    stays the other's own, and the language; steps' texts and scripts accept both languages.  Counters tell what was looked at, patched,
    skipped, and which fields and rows (by file) differ from what was there.
    """
    columns = main.columns
    fields = tuple(f for f in fields if f in columns)
    # Each side is read once: rows without a counterpart are written too, for the check, and left out behind it.
    old = other.select("file", "pos", F.struct(*columns).alias("old"))
    made = bilingual_cases(main, terms).withColumn("a", F.struct("item_id")).join(old, ["file", "pos"], "full").withColumn("b", F.when(F.col("old").isNotNull(), F.struct("old.item_id")))
    made = made.withColumn("prompt", F.coalesce("old.prompt", F.lit(""))).withColumn("language", F.lit(language))
    differ = lambda c: ~F.col(c).eqNullSafe(F.col(f"old.{c}"))
    changed = F.lit(False)
    for c in columns:
        changed = changed | differ(c)
    made = cut(made.withColumn("changed", changed).withColumn("moved", F.filter(F.array(*(F.when(differ(f), F.lit(f)) for f in fields)).cast("array<string>"), lambda x: x.isNotNull())).drop("old"), "synced")
    checked(made)
    made = made.where("a is not null and b is not null")
    flat = F.flatten("edits")
    total = lambda name: F.aggregate(flat, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e[name], F.lit(0)))
    sums = [F.sum(total(k)).alias(v) for k, v in COUNTERS.items()]
    sums += [F.sum(F.size(flat)).cast("long").alias("steps_seen"), F.sum(F.size("test_cases")).cast("long").alias("test_cases_seen"), F.count("*").alias("items_seen")]
    sums += [F.count_if(F.array_contains("moved", f)).alias(f"metadata_synced_{f}") for f in fields]
    names = [*COUNTERS.values(), "steps_seen", "test_cases_seen", "items_seen", *(f"metadata_synced_{f}" for f in fields)]
    counted = made.agg(*sums).select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in names))).alias("c")).select("c.*")
    by_file = made.groupBy(F.concat(F.lit("changed_rows_"), "file").alias("name")).agg(F.count_if("changed").alias("n"))
    steps = made.select("file", "pos", "item_id", "test_cases", F.posexplode("edits").alias("case", "own")).select("file", "pos", "item_id", "test_cases", "case", F.posexplode("own").alias("step", "e")).where("e.risky = 1")
    tc = F.get("test_cases", F.col("case"))
    label = F.concat(F.coalesce("item_id", F.lit("None")), F.lit("/"), F.coalesce(tc["id"], F.lit("None")), F.format_string("/step[%d]/", "step"), F.get(tc["steps"], F.col("step"))["action"])
    risks = steps.orderBy("file", "pos", "case", "step").limit(30).select("file", "pos", label.alias("label"))
    return made.select(*columns, "changed"), counted.where("n > 0").unionByName(by_file), risks


#: Fields that editions may differ in, at the top and by a step's action; fields of provenance begin with an underscore.
FREE = ("prompt", "language", "test_cases", "_line_no")
FREE_IN_STEPS = {
    "assert_text_contains": "text_pattern", "assert_text_not_contains": "text_pattern", "click_text": "text_pattern", "assert_js_value": "expression", "eval_js": "expression",
}
OBJECT, LIST = "map<string, variant>", "array<variant>"


def strict_alignment(main: DataFrame, other: DataFrame, files: tuple[str, ...], strict: bool = True, language: str = "zh", names: tuple[str, str] = ("en", "zh")) -> DataFrame:
    """(file, pos, case, step, kind, field) of everything in which two editions of JSON objects (file, pos, item: variant) differ.

    Objects need no schema: at each of the three levels the keys of both sides together are compared; a missing key is a null.
    Missing files, other numbers of lines, other ids (which end an item), languages, fields of ``META``, numbers of cases; case by case ids,
    weights, numbers of steps (which end the case) and actions in order; with ``strict`` all other fields at the top, of cases and of
    steps.  What a language may change in a step is told as ``allowed_<action>_<field>_diff``.  Cases and steps count from 1.
    """
    got = lambda m, key: F.try_element_at(m, key if isinstance(key, Column) else F.lit(key))
    # A variant compares as its JSON text, in which keys are sorted and decimals have no idle zeros.
    plain = lambda v: F.coalesce(F.to_json(v), F.lit("null"))
    differ = lambda a, b, key: plain(got(a, key)) != plain(got(b, key))
    text = lambda m, key: got(m, key).cast("string")
    items = lambda m, key: F.coalesce(got(m, key).cast(LIST), F.array().cast(LIST))
    none = F.lit(None).cast("long")
    entry = lambda kind, field, case=none, step=none: F.struct(case.cast("long").alias("case"), step.cast("long").alias("step"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (F.lit(field) if isinstance(field, str) else field).alias("field"))
    kept = lambda *found: F.filter(F.array(*found), lambda x: x.isNotNull())

    def keys(a: Column, b: Column, but: tuple[str, ...]) -> Column:
        return F.filter(F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b))), lambda k: ~k.startswith("_") & ~k.isin(*but))

    def fields(a: Column, b: Column, but: tuple[str, ...], kind: str, case=none, step=none) -> Column:
        return F.transform(F.filter(keys(a, b, but), lambda k: differ(a, b, k)), lambda k: entry(kind, k, case, step))

    def of_step(pair: Column, i: Column, case: Column) -> Column:
        a, b = pair["a"], pair["b"]
        action = text(a, "action")
        free = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FREE_IN_STEPS.items() for x in kv)), F.coalesce(action, F.lit(""))), F.lit(""))
        return F.transform(F.filter(keys(a, b, ()), lambda k: differ(a, b, k)), lambda k: entry(F.when(k == free, F.concat(F.lit("allowed_"), action, F.lit("_"), k, F.lit("_diff"))).otherwise("step_field_mismatch"), k, case, i + 1))

    def zipped(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.cast(OBJECT).alias("a"), y.cast(OBJECT).alias("b")))

    def of_case(pair: Column, i: Column) -> Column:
        a, b, case = pair["a"], pair["b"], i + 1
        actions = lambda s: F.transform(s, lambda x: plain(F.try_variant_get(x, "$.action", "variant")))
        own = kept(F.when(differ(a, b, "id"), entry("tc_id_mismatch", "id", case)), F.when(differ(a, b, "weight"), entry("tc_weight_mismatch", "weight", case)))
        if strict:
            own = F.concat(own, fields(a, b, ("steps",), "tc_field_mismatch", case))

        def of_steps(both: Column) -> Column:
            u, v = both["u"], both["v"]
            inner = kept(F.when(actions(u) != actions(v), entry("step_action_sequence_mismatch", "steps", case)))
            if strict:
                inner = F.concat(inner, F.flatten(F.transform(zipped(u, v), lambda p, k: of_step(p, k, case))))
            return F.when(F.size(u) != F.size(v), F.array(entry("step_count_mismatch", "steps", case))).otherwise(inner)

        # The steps of a case are cast once and named by a lambda.
        steps = F.array(F.struct(items(a, "steps").alias("u"), items(b, "steps").alias("v")))
        return F.concat(own, F.flatten(F.transform(steps, of_steps)))

    both = main.select("file", "pos", F.col("item").cast(OBJECT).alias("a")).join(other.select("file", "pos", F.col("item").cast(OBJECT).alias("b")), ["file", "pos"])
    a, b = F.col("a"), F.col("b")
    ours, theirs = items(a, "test_cases"), items(b, "test_cases")
    top = kept(
        F.when(~F.coalesce(text(b, "language"), F.lit("")).eqNullSafe(F.lit(language)), entry("language_mismatch", "language")),
        *(F.when(differ(a, b, f), entry("metadata_mismatch", f)) for f in META), F.when(F.size(ours) != F.size(theirs), entry("tc_count_mismatch", "test_cases")),
    )
    if strict:
        top = F.concat(top, fields(a, b, (*FREE, *META, "id"), "top_level_field_mismatch"))
    found = F.when(differ(a, b, "id"), F.array(entry("id_mismatch", "id"))).otherwise(F.concat(top, F.flatten(F.transform(zipped(ours, theirs), of_case))))
    inside = both.select("file", "pos", F.explode(found).alias("m")).select("file", "pos", "m.*")
    # Files: one row each, however many lines.
    count = lambda df, name: df.groupBy("file").agg(F.count("*").alias(name))
    listed = main.sparkSession.createDataFrame([(f,) for f in files], "file string").join(count(main, "left"), "file", "left").join(count(other, "right"), "file", "left")
    told = F.when(F.col("left").isNull(), f"missing_{names[0]}_file").when(F.col("right").isNull(), f"missing_{names[1]}_file").when(F.col("left") != F.col("right"), "line_count_mismatch")
    whole = listed.select("file", none.alias("pos"), none.alias("case"), none.alias("step"), told.alias("kind"), F.lit("file").alias("field")).where("kind is not null")
    return inside.join(F.broadcast(main.sparkSession.createDataFrame([(f,) for f in files], "file string")), "file", "left_semi").unionByName(whole)


def alignment_summary(found: DataFrame) -> DataFrame:
    """(file, kind, n), mismatches by file; what is allowed is counted under no file."""
    allowed = F.col("kind").startswith("allowed_")
    return found.groupBy(F.when(~allowed, F.col("file")).alias("file"), "kind").agg(F.count("*").alias("n"))
