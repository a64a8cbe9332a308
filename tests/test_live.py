"""Watched runs, retries and resamples against plain definitions."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pagequarry.operators import resampling
from pagequarry.streaming import live
from pyspark.sql import functions as F


def plain_interval(scores, n_bootstrap=1000):
    rng, n = random.Random(42), len(scores)
    means = sorted(sum(scores[rng.randint(0, n - 1)] for _ in range(n)) / n for _ in range(n_bootstrap))
    return round(means[int(0.025 * n_bootstrap)], 2), round(means[int(0.975 * n_bootstrap) - 1], 2)


@pytest.mark.parametrize("n", [10, 16, 17, 100, 257])
def test_resamples_are_those_of_the_generator(n):
    import numpy as np

    scores = [(i * 37) % 101 for i in range(n)]
    assert resampling.interval(np.array(scores)) == plain_interval(scores)


def test_intervals_by_order_and_size(spark):
    rows = [("a", i, (i * 37) % 101, "m1") for i in range(64)] + [("a", i, (i * 31) % 90, "m2") for i in range(40)] + [("b", i, 5, "m1") for i in range(9)] + [(None, i, i % 7, "m2") for i in range(30)]
    table = spark.createDataFrame(rows, "g string, line_idx long, total long, model string").orderBy(F.rand(3))
    got = {(r.g, r.model): (r.n, r.ci_low, r.ci_high) for r in resampling.ordered_intervals(table, ["g", "model"]).collect()}
    want = {}
    for g, m in {(r[0], r[3]) for r in rows}:
        own = [r[2] for r in rows if (r[0], r[3]) == (g, m)]
        if len(own) >= 10:
            want[g, m] = (len(own), *plain_interval(own))
    assert got == want
    large = {r.g: r for r in resampling.ordered_intervals(table.where("model = 'm1'"), ["g"], held=20).collect()}
    assert set(large) == {"a"} and large["a"].ci_low < large["a"].mean < large["a"].ci_high
    both = {r.g: r for r in resampling.compare_with_intervals(table, "m1", "m2", ("g",)).collect()}
    assert both["a"].overlap == (both["a"].base_low <= both["a"].other_high and both["a"].other_low <= both["a"].base_high) and both["b"].overlap is None and both["b"].base_avg == 5.0


SCHEMA = "item_id string, event_id long, eval_status string, total long, test_pass_rate double"


def _batches(tmp_path, spark):
    first = [("1", 1, "failed", 10, None), ("2", 2, "completed", 80, 0.5), ("3", 3, "processing", 0, None)]
    second = [("1", 4, "completed_with_fallback", 60, 1.0), ("4", 5, "failed", 0, None)]
    for i, rows in enumerate((first, second)):
        pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")]).to_parquet(tmp_path / f"part{i}.parquet")
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/part*")


def test_watched_runs_go_on_after_a_crash(spark, tmp_path, monkeypatch):
    source = _batches(tmp_path, spark)
    at = f"file://{tmp_path}/live"
    calls = []

    class Broken(RuntimeError):
        pass

    real = spark.createDataFrame

    def breaking(data, *rest, **more):
        if rest and rest[0] == "part long, version long":
            calls.append(1)
            if len(calls) == 2:
                raise Broken("stop")
        return real(data, *rest, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: breaking(*a, **k))
    with pytest.raises(Exception, match="stop"):
        live.watched(source(), "item_id", "event_id", at)
    monkeypatch.undo()
    now = live.watched(source(), "item_id", "event_id", at)
    items = spark.createDataFrame([(str(i), i < 6) for i in range(1, 8)], "item_id string, generated boolean")
    row = live.live_state(now, items).first().asDict()
    assert row == {"total_items": 7, "generated": 5, "evaluated": 3, "completed": 2, "failed": 1, "pending_generation": 2, "pending_evaluation": 2, "avg_score_completed": 70.0, "avg_test_pass_rate_completed": 0.75}
    assert {r.item_id for r in live.pending(now, items).collect()} == {"3", "4", "5"}
    told = {r.batch: (r.rows, r.completed, r.failed, r.points) for r in live.progress(source(), at).collect()}
    assert told == {0: (3, 1, 1, 80), 1: (2, 1, 1, 60)}


def test_failures_come_back_until_they_succeed(spark, tmp_path):
    at, rows = f"file://{tmp_path}/retries", tmp_path / "in"
    rows.mkdir()

    def run(n, outcomes):
        pd.DataFrame(outcomes, columns=["uid", "eval_status", "n"]).to_parquet(rows / f"{n}.parquet")
        stream = spark.readStream.schema("uid string, eval_status string, n long").parquet(f"file://{rows}")
        return {r.uid: r.attempt for r in live.to_retry(live.retries(stream, "n", at)).collect()}

    assert run(1, [("a", "failed", 1), ("b", "completed", 2), ("c", "failed", 3)]) == {"a": 1, "c": 1}
    assert run(2, [("a", "failed", 4), ("b", "failed", 5), ("c", "completed", 6)]) == {"a": 2}
    assert run(3, [("a", "failed", 7)]) == {}
    tries = spark.read.schema(live.RETRIES).parquet(f"{at}/rows").collect()
    assert sorted((r.uid, r.attempt, r.action) for r in tries) == [("a", 1, "retry"), ("a", 2, "retry"), ("a", 3, "gave up"), ("b", 1, "done"), ("c", 1, "retry"), ("c", 2, "done")]
