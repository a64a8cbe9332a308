"""JSON-lines sources, runs in folders, and intervals."""

from __future__ import annotations

import json

from pagequarry.operators import records
from pagequarry.sources import jsonl
from pyspark.sql import functions as F


def test_bad_lines_are_counted_but_left_out(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\nnot json\n[1, 2]\n{"id": "y"}\n"text"\n{"n": 3, "extra": 1}\n')
    rows = jsonl.lines(spark, str(tmp_path / "a.jsonl"), "id string, n long").orderBy("line_idx").collect()
    assert [(r.line_idx, r.id, r.n) for r in rows] == [(0, "x", 1), (4, "y", None), (6, None, 3)]


def test_lines_of_split_files_are_numbered_through(spark, tmp_path):
    text = "".join(json.dumps({"n": i}) + "\n" if i % 7 else "\n" for i in range(5000))
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.lines(spark, str(tmp_path), "n long").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2 * sum(i % 7 > 0 for i in range(5000)) and all(r.n == r.line_idx for r in rows)


def test_json_and_json_lines_together(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}], indent=1))
    (tmp_path / "sub" / "b.jsonl").write_text('{"id": "3"}\n{"id": "4"}\n')
    assert sorted(r.id for r in jsonl.documents(spark, str(tmp_path), "id string").collect()) == ["1", "2", "3", "4"]


def test_runs_are_named_by_their_folders(spark, tmp_path):
    for name in ("sft__a__b/m1", "plain/m2", "outputs_stale__x/m3"):
        at = tmp_path / "outputs" / name / "en" / "full"
        at.mkdir(parents=True)
        (at / "results.jsonl").write_text('{"total": 5}\n')
    rows = jsonl.runs(spark, str(tmp_path), "total long").collect()
    assert sorted((r.group, r.config, r.model, r.total) for r in rows) == [("sft", "a__b", "m1", 5), ("unknown", "plain", "m2", 5)]


def test_intervals_cover_the_mean(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 5, "few").otherwise("many").alias("g"), (F.col("id") * 37 % 101).alias("total"))
    got = {r.g: r for r in records.intervals(rows, ["g"]).collect()}
    assert set(got) == {"many"}
    r = got["many"]
    assert r.n == 395 and r.ci_low < r.mean < r.ci_high and 4 < r.ci_high - r.ci_low < 8


def test_lines_are_found_whatever_their_blanks():
    text = "a\n\t<p>  \n      x\nb"
    assert records.lines_like(text, "    <p>\n      x") == "\t<p>  \n      x"
    assert records.lines_like(text, "  <p>\n      x") is None
    assert records.lines_like("", "x") is None
