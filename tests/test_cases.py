"""Typed cases and written results by hand."""

from __future__ import annotations

import json

from pagequarry.operators import cases as C
from pyspark.sql import functions as F


def parsed(spark, value):
    return spark.createDataFrame([(value,)], "s string").select(C.parsed(F.parse_json("s")).alias("p")).first().p


def test_defaults_stand_for_missing_keys_only(spark):
    got = parsed(spark, json.dumps([{"steps": [{"action": "scroll"}, {"action": "press_key", "repeat": None, "amount": 7, "expected": [1, {"a": 2}], "from_pos": [1, 2]}]}, {"id": "b", "name": None, "weight": 2, "steps": []}, {"id": None}]))
    first, second = got.cases[0].steps
    assert (first.repeat, first.timeout, first.threshold, first.amount, first.selector, first.tags, first.gte) == (1, 5000, 0.95, 300, "", None, None)
    assert (second.repeat, second.amount, second.expected.toJson(), second.from_pos) == (None, 7, '[1,{"a":2}]', [1, 2])
    assert [(c.id, c.name, c.weight) for c in got.cases] == [("tc_000", "", 1.0), ("b", None, 2.0), (None, "", 1.0)] and got.error is None


def test_unknown_actions_are_errors(spark):
    assert parsed(spark, '[{"id": "x", "steps": [{"action": "click"}, {"action": "fly"}]}, {"steps": [{"action": "z"}]}]').error == "Unknown test action: 'fly' in test case x"
    assert parsed(spark, '[{"steps": [{}]}]').error == "Unknown test action: '' in test case ?"
    for value in ("[]", "{}", "null", '"x"'):
        got = parsed(spark, value)
        assert got.cases == [] and got.error is None


def test_lists_of_actions_and_fields():
    assert len(C.FIELDS) == 25 and set(C.COMPACT) <= set(C.FIELDS)


def test_delimited_files_keep_separators(spark, tmp_path):
    rows = spark.createDataFrame([("a\tb", 1, None), ('c"d', 2, "x,y"), ("", 3, "|")], "t string, n long, u string")
    for sep in ("\t", ","):
        path = f"file://{tmp_path}/{ord(sep)}"
        C.write_delimited(rows, path, sep)
        assert {(r.t or "", r.n, r.u) for r in C.read_delimited(rows, path, sep).collect()} == {("a\tb", 1, None), ('c"d', 2, "x,y"), ("", 3, "|")}
    assert [r[0] for r in rows.where("n > 1").select(C.markdown_line(F.col("t"), F.col("n"), F.col("u"))).collect()] == ['| c"d | 2 | x,y |', "|  | 3 | \\| |"]


def test_only_fields_that_are_asked_for_are_made(spark):
    rows = spark.createDataFrame([('[{"steps": [{"action": "scroll", "tags": ["a"], "key": null}]}, 7, {"steps": [3]}]',)], "s string")
    steps = rows.select(C.parsed(F.parse_json("s"), C.COMPACT).alias("p"))
    assert steps.schema["p"].dataType["cases"].dataType.elementType["steps"].dataType.elementType.names == list(C.COMPACT)
    assert steps.first().p.error == "Unknown test action: '' in test case ?"
    whole = parsed(spark, '[{"steps": [{"action": "scroll", "tags": ["a"], "key": null}]}, 7]')
    assert [(c.id, len(c.steps)) for c in whole.cases] == [("tc_000", 1), ("tc_001", 0)] and (whole.cases[0].steps[0].key, whole.cases[0].steps[0].tags) == (None, ["a"])
    # Objects become no maps.
    assert "map<" not in steps._jdf.queryExecution().optimizedPlan().toString()
