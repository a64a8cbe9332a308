"""Answers of models by hand: JSON in prose, patches in every shape, scores."""

from __future__ import annotations

import json
import time

import pytest
from pagequarry.operators import answers as A
from pyspark.sql import functions as F


def first_object(text):
    """The plain definition: from the first brace on, character by character."""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text):
        if start < 0:
            start, depth = (i, 1) if c == "{" else (-1, 0)
        elif quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def test_objects_in_texts():
    import random

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(['{', '}', '"', "\\", "a", " ", "{}", '{"k": "}"}']) for _ in range(rng.randint(0, 14)))
        whole, first = text.strip(), first_object(text.strip())
        assert A.json_texts(text) == list(dict.fromkeys(x for x in (first, whole) if x)), text
    assert A.json_texts('a {"x": {"y": 1}} b {"z": "}"}', every=True)[:2] == ['{"x": {"y": 1}}', '{"z": "}"}']
    assert A.json_texts('{ never {"k": 1} closed', every=True)[0] == '{"k": 1}'
    assert A.json_texts('x ```JSON\n {"a": 1} \n``` ```{"b": {}}``` ') == ['{"a": 1}', '{"b": {}}', 'x ```JSON\n {"a": 1} \n``` ```{"b": {}}```']


@pytest.mark.parametrize("text", ["{" * 1_000_000, '{"a": ' * 200_000, "```json" + " " * 1_000_000, "``` {" * 200_000, "} " * 500_000, '"' * 1_000_001, '{"' + "\\" * 1_000_000])
def test_hostile_answers_take_linear_time(text):
    began = time.process_time()
    A.json_texts(text, every=True)
    assert time.process_time() - began < 20


P = [{"old_str": "a", "new_str": "b"}]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (json.dumps({"patches": P}), 1), (json.dumps(P), 1), ("```json\n" + json.dumps(P) + "\n```", 1), ("```\n[]\n```", 0), ("[]", 0), ("{}", None), ("none", None), (None, None),
        ('{"patches": [{"old_str": "a"}]}', None), ('{"patches": "a"}', None), ("```json\n[]\n``` and ```json\n" + json.dumps(P) + "\n```", 1), ('so {"patches": [{"old_str": "a", "new_str": null}]} it is', 1),
        ('so {"patches": [ ]} it is', 0), ("<think>[]</think>\n" + json.dumps(P + P), 2), ("<think>[]</think>", None), ("```json\n{bad\n```" + json.dumps(P), None), ("```json\n[1]\n```\n[]", None),
    ],
)
def test_patches(spark, answer, want):
    row = spark.createDataFrame([(answer,)], "a string").select(A.patches_of(F.col("a")).alias("p")).first()
    assert (None if row.p is None else len(row.p)) == want


def test_repaired_pages(spark):
    page = "<html><body>" + "<p>text</p>" * 30 + "<b>one</b></body></html>"
    rows = [
        (1, page, json.dumps([{"old_str": "<b>one</b>", "new_str": "<b>two</b>"}, {"old_str": "zzz", "new_str": ""}])), (2, page, "[]"), (3, page, "sorry"), (4, page, "```html\n" + page.replace("one", "six") + "\n```"),
        (5, page, json.dumps([{"old_str": "zzz", "new_str": ""}])), (6, page, None), (7, page, "<think>" + page + "</think>" + page.replace("one", "ten")), (8, page, json.dumps([{"old_str": "</body></html>", "new_str": ""}])),
    ]
    got = {r.id: r for r in A.repaired(spark.createDataFrame(rows, "id long, html string, answer string")).collect()}
    assert {i: r.how for i, r in got.items()} == {1: "patched", 2: "unchanged", 3: None, 4: "rewritten", 5: None, 6: None, 7: "rewritten", 8: None}
    assert got[1].html == page.replace("one", "two") and (got[1].applied, got[1].total) == (1, 2) and got[2].html == page and got[7].html == page.replace("one", "ten") and got[8].html is None


def test_scores(spark):
    values = ['{"total": 12.9, "rendering": 3, "bugs": ["a", 1], "highlights": "x", "summary": 5}', "7", "7.9", "null", '{"total": null}', '"8"', "{}", "-3.5"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", F.parse_json("s").alias("s"))
    assert [r.t for r in rows.orderBy("i").select(A.total_score(F.col("s")).alias("t")).collect()] == [12, 7, 7, 0, 0, 8, 0, -3]
    first, *rest = [r.f for r in rows.orderBy("i").select(A.final_score(F.col("s")).alias("f")).collect()]
    assert (first.rendering.score, first.interaction.reason, first.total_score, first.bugs, first.highlights, first.summary) == (3.0, "", 12.9, ["a", "1"], [], "") and rest[0] is None and rest[5].total_score == 0.0
