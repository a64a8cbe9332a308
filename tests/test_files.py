"""Files by hand: benchmark folders, filters that reach the reader, lookups that open few files, listings."""

from __future__ import annotations

import json

import pytest
from pagequarry.sources import benchmark, jsonl, listing, lookup
from pyspark.sql import functions as F


@pytest.fixture
def root(tmp_path):
    for edition in ("en", "zh", "responses"):
        (tmp_path / "benchmark" / edition / "sub").mkdir(parents=True)
    at = tmp_path / "benchmark"
    item = lambda i, **more: json.dumps({"id": i, "language": "en", "category": "game", "test_cases": [{"id": "t", "free": {"x": 1}}], **more})
    (at / "en" / "b.jsonl").write_text(item("b1") + "\n\n{broken\n" + item("b2", category="three_3d", difficulty="hard") + "\n")
    (at / "en" / "sub" / "a.jsonl").write_text(item("a1", language=None) + "\n")
    (at / "en" / "z.json").write_text("[" + item("z1") + ",\n" + item("z2") + "]")
    (at / "zh" / "one.json").write_text("{\n" + item("o1", language="zh")[1:])
    (at / "responses" / "r.jsonl").write_text(item("r1") + "\n")
    return f"file://{at}"


def ids(rows):
    return [r.id for r in rows.orderBy("place").collect()]


def test_benchmark_folders(spark, root):
    rows = benchmark.benchmark(spark, root)
    assert ids(rows) == ["z1", "z2", "b1", "b2", "a1", "o1"], "editions in order, whole files before lines, files by path"
    first = rows.where("id = 'b2'").first()
    assert (first.category, first.source_category) == ("three_d_webgl", "three_3d") and json.loads(first.test_cases.toJson())[0]["free"] == {"x": 1}
    assert ids(benchmark.benchmark(spark, f"{root}/responses")) == ["r1"] and ids(benchmark.benchmark(spark, f"{root}/en/z.json")) == ["z1", "z2"] and ids(benchmark.benchmark(spark, f"{root}/en/b.jsonl")) == ["b1", "b2"]
    assert ids(benchmark.benchmark(spark, root, language="zh")) == ["o1"] and ids(benchmark.benchmark(spark, root, category="three_d_webgl", difficulty="hard")) == ["b2"]


def test_filters_reach_the_reader(spark, root):
    plan = benchmark.benchmark(spark, root, language="en", difficulty="hard")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(language,en)" in plan and "EqualTo(difficulty,hard)" in plan


def test_lookups_open_few_files(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    path = f"file://{tmp_path}/sorted"
    lookup.build(rows, "o_orderkey", path, parts=10)
    found = lookup.find(spark, path, "o_orderkey", [7, 1200])
    assert sorted(r.o_orderkey for r in found.collect()) == [7, 1200]
    assert len(found.inputFiles()) == 2 < len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert "FileScan parquet" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "IN (7,1200)" in plan
    assert lookup.find(spark, path, "o_orderkey", [-5]).count() == 0
    doubled = rows.withColumn("line", F.lit(0)).unionByName(rows.withColumns({"line": F.lit(1), "o_custkey": F.lit(-1).cast("long")}))
    assert lookup.first_of(doubled, "o_orderkey", "line").where("o_custkey = -1").count() == 0


def test_trace_heads(spark):
    lines = ['{"record_id": "a", "final_score": 80, "improvement": -3}', '{"final_score": 1}', '{"record_id":"b","query":"' + "x" * 6000 + '","final_score": 9}', '{"record_id": "a", "final_score": 70}']
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(lines)], "value string, line_idx long")
    assert {tuple(r) for r in lookup.trace_heads(rows).collect()} == {("a", 70, 0), ("b", 0, 0)}


def test_listings_hold_no_contents(spark, root):
    found = listing.files(spark, f"{root}/en", "*.jsonl")
    assert sorted(r.relative for r in found.collect()) == ["b.jsonl", "sub/a.jsonl"]
    assert "content:" not in found._jdf.queryExecution().executedPlan().toString()


def test_screenshots_fall_back(spark):
    there = spark.createDataFrame([(p,) for p in ("a/1.png", "a/frame_1.png", "b/frame_2.png", "b/frame_1.png", "c/x.png", "c/frame_1.png")], "relative string")
    records = spark.createDataFrame([("a", "a", ["a/1.png", "a/0.png", "a/1.png"], ["frame_1.png"]), ("b", "b", ["no.png"], []), ("c", "c", None, ["x.png"]), ("d", "d", [], [])], "uid string, folder string, shots array<string>, annotated array<string>")
    assert {r.uid: r.shots for r in listing.screenshots(records, there).collect()} == {"a": ["a/1.png"], "b": ["b/frame_1.png", "b/frame_2.png"], "c": ["c/x.png"], "d": []}


def test_lines_join_their_split_table_by_broadcast(spark, root):
    plan = jsonl.lines(spark, f"{root}/en/b.jsonl", "id string")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_heads_of_traces_are_hashed_and_made_once(spark):
    rows = spark.createDataFrame([('{"record_id": "a", "final_score": 1}', 1), ('{"final_score": 9}', 3), ('{"record_id": "a", "improvement": -2}', 2)], "value string, line_idx long")
    heads = lookup.trace_heads(rows)
    assert [tuple(r) for r in heads.collect()] == [("a", 0, -2)]
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert heads._jdf.queryExecution().optimizedPlan().toString().count('"record_id"') == 1


def test_heads_are_cut_by_characters(spark):
    page = lambda fill, n: '{"record_id": "r%s", "best": "%s", "improvement": 4}' % (n, fill)
    rows = [(page("é" * n, n), 1) for n in (4900, 5100)] + [(page("e" * n, n), 1) for n in (4901, 5101)] + [("", 1), (None, 1), ('{"record_id": "é", "final_score": 7}', 1)]
    got = lookup.trace_heads(spark.createDataFrame(rows, "value string, line_idx long"))
    assert {tuple(r) for r in got.collect()} == {("r4900", 0, 4), ("r5100", 0, 0), ("r4901", 0, 4), ("r5101", 0, 0), ("é", 7, 0)}
