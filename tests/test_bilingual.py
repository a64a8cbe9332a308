"""Editions by hand: glossary, rewritten steps, strict comparison."""

from __future__ import annotations

import random
import re

import pytest
from pagequarry.functions.glossary import TERMS, Glossary
from pagequarry.operators import bilingual
from pyspark.sql import functions as F

STEP = "struct<action string, text string, text_pattern string, expression string, note string>"
SCHEMA = f"file string, pos long, item_id string, language string, prompt string, category string, test_cases array<struct<id string, steps array<{STEP}>>>"


def test_terms_equal_a_search_term_by_term():
    def there(term, probe):
        own = re.escape(term).replace(r"\ ", r"[\s_\-]*")
        return re.search(rf"(?<![a-z0-9]){own}(?![a-z0-9])", probe, re.IGNORECASE)

    rng, glossary = random.Random(1), Glossary()
    words = [w for t in TERMS for w in t.split()] + ["xx", "9", "ſ", "İ"]
    for _ in range(600):
        text = "".join(rng.choice(words) + rng.choice([" ", "_", "-", "", "  ", "|", "\\b", "\n", ".", "(?:"]) for _ in range(8))
        probe = re.sub(r"\\[bBdDsSwW]|\(\?:|\(\?i\)|[\[\]{}^$+*?.()]", " ", text.lower())
        assert glossary.found(text) == {t for t in TERMS if there(t, probe)}


@pytest.mark.parametrize(
    ("step", "want"),
    [
        ({"action": "click_text", "text": "Turn off"}, {"text_pattern": "Turn off|关闭", "click_steps": 1, "click_alternatives": 1}),
        ({"action": "click_text", "text": "关闭 close"}, {}),
        ({"action": "wait", "text": "close"}, {}),
        ({"action": "assert_text_contains", "text_pattern": "", "text": "jan"}, {"text_pattern": "jan|一月|1月", "text_steps": 1, "text_alternatives": 2}),
        ({"action": "eval_js", "expression": "el.innerText === 'close'"}, {}),
        ({"action": "eval_js", "expression": "/close/g.test(el.innerText + el.outerHTML)"}, {"source_skipped": 1}),
        ({"action": "eval_js", "expression": "/close|undefined/.test(el.innerText)"}, {}),
        ({"action": "assert_js_value", "expression": "/close/g.test(el.innerText)"}, {"expression": "/close|关闭/g.test(el.innerText)", "script_steps": 1, "regexes": 1, "entries": 0, "includes": 0}),
        ({"action": "assert_js_value", "expression": "patterns=['sun',] el.innerText"}, {"expression": "patterns=['sun',\"周日\",\"星期日\"] el.innerText", "script_steps": 1, "regexes": 0, "entries": 2, "includes": 0}),
    ],
)
def test_steps(step, want):
    assert Glossary().step(step) == want


def _editions(spark):
    main = [
        ("f", 1, "a", "en", "Do", "x", [("t1", [("click_text", "Save", None, None, "kept"), ("wait", None, None, None, None)]), ("t2", None)]),
        ("f", 2, "b", "en", "Go", None, None),
    ]
    other = [("f", 1, "a", "zh", "做", "y", None), ("f", 2, "b", "zh", None, None, [])]
    return spark.createDataFrame(main, SCHEMA), spark.createDataFrame(other, SCHEMA)


def test_synced_editions(spark):
    main, other = _editions(spark)
    rows, counters, risks = bilingual.synced(main, other)
    first, second = rows.orderBy("pos").collect()
    assert (first.prompt, first.language, first.category, first.changed) == ("做", "zh", "x", True)
    assert [tuple(s) for s in first.test_cases[0].steps] == [("click_text", "Save", "Save|保存", None, "kept"), ("wait", None, None, None, None)]
    assert first.test_cases[1].steps == [] and (second.prompt, second.test_cases) == ("", []) and risks.count() == 0
    got = {r.name: r.n for r in counters.collect()}
    assert got == {"click_text_steps_patched": 1, "click_text_alternatives_added": 1, "steps_seen": 2, "test_cases_seen": 2, "items_seen": 2, "metadata_synced_category": 1, "changed_rows_f": 2}


def test_editions_that_do_not_fit_are_errors(spark):
    main, other = _editions(spark)
    with pytest.raises(ValueError, match="line count mismatch for f: 2 and 1"):
        bilingual.synced(main, other.where("pos = 1"))
    with pytest.raises(ValueError, match="id mismatch f:2: b and c"):
        bilingual.synced(main, other.withColumn("item_id", F.when(F.col("pos") == 2, "c").otherwise(F.col("item_id"))))


def test_strict_alignment_by_hand(spark):
    a = '{"id":"1","language":"en","category":"x","has_interaction":true,"title":"t","extra":1.0,"_src":1,"test_cases":[{"id":"a","weight":1,"name":"n","steps":[{"action":"click_text","text_pattern":"x","s":1},{"action":"wait","ms":5}]},{"id":"b","weight":2.0,"steps":[]}]}'
    b = '{"id":"1","language":"fr","category":"y","title":"u","extra":1,"_src":2,"test_cases":[{"id":"a","weight":1.0,"steps":[{"action":"click_text","text_pattern":"x|y","s":2},{"ms":5,"action":"wait","q":null}]},{"id":"c","weight":2,"steps":[{"action":"z"}]},{"id":"d"}]}'
    table = lambda *rows: spark.createDataFrame(rows, "file string, pos long, s string").select("file", "pos", F.parse_json("s").alias("item"))
    main, other = table(("f", 1, a), ("f", 2, '{"id": "q"}'), ("g", 1, '{"id": 7}')), table(("f", 1, b), ("g", 1, '{"id": 8, "x": 1}'))
    got = sorted((r.file, r.pos or 0, r.case or 0, r.step or 0, r.kind, r.field) for r in bilingual.strict_alignment(main, other, ("f", "g", "h")).collect())
    assert got == sorted([
        ("f", 1, 0, 0, "language_mismatch", "language"), ("f", 1, 0, 0, "metadata_mismatch", "category"), ("f", 1, 0, 0, "metadata_mismatch", "has_interaction"), ("f", 1, 0, 0, "tc_count_mismatch", "test_cases"),
        ("f", 1, 0, 0, "top_level_field_mismatch", "title"), ("f", 1, 1, 0, "tc_field_mismatch", "name"), ("f", 1, 1, 1, "step_field_mismatch", "s"), ("f", 1, 1, 1, "allowed_click_text_text_pattern_diff", "text_pattern"),
        ("f", 1, 2, 0, "tc_id_mismatch", "id"), ("f", 1, 2, 0, "tc_field_mismatch", "id"), ("f", 1, 2, 0, "step_count_mismatch", "steps"), ("f", 0, 0, 0, "line_count_mismatch", "file"),
        ("g", 1, 0, 0, "id_mismatch", "id"), ("h", 0, 0, 0, "missing_en_file", "file"),
    ])
    loose = {r.kind for r in bilingual.strict_alignment(main, other, ("f",), strict=False).collect()}
    assert loose == {"language_mismatch", "metadata_mismatch", "tc_count_mismatch", "tc_id_mismatch", "step_count_mismatch", "line_count_mismatch"}
