"""What must not grow: batches of Python workers, and how often a table is read or a value computed."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pagequarry.llm import jaccard_groups as J
from pagequarry.llm.common import narrow_batches
from pagequarry.llm.interpolation import packed
from pagequarry.operators import bilingual as B
from pagequarry.operators import curation as C
from pagequarry.operators import quality as Q
from pagequarry.operators import tcpool as T
from pagequarry.sources.staging import BATCH_BYTES, BATCH_ROWS
from pagequarry.sources.tables import table
from pagequarry.streaming import incremental as I  # noqa: E741
from pyspark.sql import functions as F


def counted(spark, column, kind):
    """A column that passes a value on, and the count of values that passed."""
    passed = spark.sparkContext.accumulator(0)

    @F.udf(kind)
    def run(value):
        passed.add(1)
        return value

    return run(column), passed


def test_python_workers_get_bounded_batches(spark, sf):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    sizes = table(spark, sf, "lineitem").select("l_orderkey").mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long")
    assert 0 < sizes.agg(F.max("n")).first()[0] <= BATCH_ROWS


def edition(spark, passing=True):
    step = "array<struct<id string, steps array<struct<action string, text string, text_pattern string, expression string>>>>"
    rows = [("f", i, f"i{i}", "en", "p", "c", [("t", [("click_text", "save", None, None), ("click_text", "save", None, None)])]) for i in range(20)]
    df = spark.createDataFrame(rows, f"file string, pos long, item_id string, language string, prompt string, category string, test_cases {step}")
    column, passed = counted(spark, F.col("category"), "string")
    return df.withColumn("category", column), passed


def test_editions_are_read_once(spark):
    (main, a), (other, b) = edition(spark), edition(spark)
    rows, counters, _ = B.synced(main, other)
    assert rows.select(F.explode("test_cases.steps").alias("s")).select(F.explode("s.text_pattern")).distinct().collect() == [("save|保存",)]
    assert {r.name: r.n for r in counters.collect()}["click_text_steps_patched"] == 40
    assert (a.value, b.value) == (20, 20)


def test_risks_of_a_case_are_computed_once(spark):
    steps = [(i, "assert_visible", "svg, canvas", None, None, None) for i in range(3)]
    rows = [(f"i{i}", "Make a form", [("c", "heatmap", 1.0, steps)]) for i in range(5)]
    found = Q.audit(spark.createDataFrame(rows, Q.ITEMS))
    assert {r.risk: r["count"] for r in found.groupBy("risk").count().collect()} == {"broad_surface_visible": 15, "cross_template_heatmap": 5}
    # Risks of cases and of their steps come from one explode; the other three are those of broken rules.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(filter(") == 4


def test_audits_write_no_nested_items(spark):
    found = Q.audit(spark.createDataFrame([(None, None, None), ("b", "p", []), ("c", "p", [("1", "n", 1.0, None), None])], Q.ITEMS))
    # Items without an id, a prompt or cases have their rules once; a case without steps, and one that is null, too.
    assert sorted((r.item_id or "", r.tc_id or "", r.risk) for r in found.collect()) == [("", "", "validator_error")] * 3 + [("c", "", "validator_error")] * 3 + [("c", "1", "validator_error")]
    assert "test_cases" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shingles_of_a_block_are_made_and_sent_by_parts(monkeypatch):
    """Beside a block's keys no arrays of its size pile up, and parts give what the whole gives."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 2000).astype(np.int32)
    tokens = rng.integers(1, 40000, lengths.sum()).astype(np.int32)
    tokens[np.cumsum(lengths) - 1] = 0
    cells = {"block": 1, "part": 0, "ids": list(range(2000)), "lengths": packed(lengths), "vocabulary": packed(rng.integers(0, 2**63, 40000).astype(np.uint64)), "tokens": packed(tokens)}
    batch = pa.RecordBatch.from_pylist([cells])
    tracemalloc.start()
    sent = sum(out.num_rows for out in J._send(256, 40, 5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent == 256
    assert peak < 8 * 8 * len(tokens)
    keys, sizes = J.shingle_sets(J.Block(cells), 5)
    monkeypatch.setattr(J, "SLICE", 1 << 40)
    whole = J.shingle_sets(J.Block(cells), 5)
    assert (keys == whole[0]).all() and (sizes == whole[1]).all()


def most_held(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_a_block_takes_few_arrays_of_its_size():
    """Keys of a block are counted, numbered and answered in a few arrays at a time, and a worker gives back what it no longer holds."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 2000).astype(np.int32)
    tokens = rng.integers(1, 40000, lengths.sum()).astype(np.int32)
    tokens[np.cumsum(lengths) - 1] = 0
    cells = {"block": 1, "part": 0, "ids": list(range(2000)), "lengths": packed(lengths), "vocabulary": packed(rng.integers(0, 2**63, 40000).astype(np.uint64)), "tokens": packed(tokens)}
    batch = pa.RecordBatch.from_pylist([cells])
    assert most_held(lambda: [None for _ in J._send(4096, 40, 5)(iter([batch]))]) < 5.5 * 8 * len(tokens)
    keys = np.unique(J.shingle_sets(J.Block(cells), 5)[0] >> np.uint64(24))
    assert most_held(lambda: J.numbered(keys)) < 4 * 8 * len(keys)
    answers = pa.table({"bucket": pa.array([0], pa.int32()), "block": [1], "octaves": pa.array([bytes(len(keys))], pa.binary())})
    assert most_held(lambda: J._sets(40, 5)(pa.Table.from_batches([batch]), answers)) < 6 * 8 * len(tokens)


def test_keys_are_counted_and_numbered():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 50, 400).astype(np.uint64), np.array([7], np.uint64), np.empty(0, np.uint64)):
        distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        assert (J.numbered(keys) == inverse).all()
        got = J.counted(keys.copy())
        assert (got[0] == distinct).all() and (got[1] == counts).all() and got[1].dtype == np.int64


def test_blocks_are_written_and_sent_one_at_a_time(spark, monkeypatch):
    """Rows of more bytes than ``BATCH`` share neither a row group nor an Arrow batch; afterwards batches are bounded as before."""
    name, written, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], J.materialize

    def watch(df, tag, *args, **options):
        written.append((tag, spark.conf.get(name), options))
        return write(df, tag, *args, **options)

    monkeypatch.setattr(J, "materialize", watch)
    assert J.similar_sets(spark.createDataFrame([(i, f"w{i} a b c d e") for i in range(4)], "doc_id long, text string")).count() == 4
    assert {size for _, size, _ in written} == {str(J.BATCH)} and spark.conf.get(name) == str(BATCH_BYTES)
    assert [options for tag, _, options in written if tag == "gram-blocks"] == [J.ROW_GROUPS]
    large = write(spark.range(0, 6, 1, 1).select(F.expr("cast(concat_ws('', transform(sequence(1, 150000), n -> md5(cast(7 * n + id as string)))) as binary)").alias("x")), "large", **J.ROW_GROUPS)
    assert sum(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in large.inputFiles()) == 6
    with narrow_batches(spark, J.BATCH):
        got = large.mapInArrow(lambda parts: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in parts), "n long").collect()
    assert [r.n for r in got] == [1] * 6


def test_texts_that_share_few_bands_are_not_compared(spark, monkeypatch):
    """Sixty texts share a band by chance; two share most: only these meet, and are linked."""
    rng = np.random.default_rng(1)
    rows = [[i, rng.integers(0, 2**32, C.PERMUTATIONS)] for i in range(62)]
    rows[61][1] = rows[60][1].copy()
    rows[61][1][4:76:3] += 1  # 24 places of 19 bands: 104 of 128 are equal
    for _, signature in rows:
        signature[:4] = 7
    written, old = {}, C.cut
    monkeypatch.setattr(C, "cut", lambda df, name: written.setdefault(name, old(df, name)))
    found = C.similar_pairs(spark.createDataFrame([(i, s.tolist()) for i, s in rows], "id long, signature array<long>"))
    assert [(r.a, r.b, r.similarity) for r in found.collect()] == [(60, 61, 104 / 128)]
    assert {r.id for r in written["buckets"].select("id").collect()} == {60, 61}


def test_least_bands_is_safe():
    # 103 equal places of 128 at 0.8: 25 others spoil 25 bands of 32 at most.
    assert C.least_bands(32, 0.8) == 7
    assert C.least_bands(32, 0.75) == 1
    assert C.least_bands(16, 0.8) == 1
    assert C.least_bands(32, 1.0) == 32


def test_rows_behind_a_stop_are_only_counted(monkeypatch):
    """The rule reads a user's rows one by one up to the stop; they aren't made records of all columns first."""

    class State:
        exists = hasTimedOut = False

        def update(self, state):
            self.get = state

        def setTimeoutTimestamp(self, at):  # noqa: N802
            self.at = at

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

    def whole(*_, **__):
        raise AssertionError("all rows were made records")

    monkeypatch.setattr(pd.DataFrame, "to_dict", whole)
    state, n = State(), 50
    # Out of order and in two parts: row 3 is near perfect.
    ids = list(range(n))[::-1]
    rows = pd.DataFrame({"user_id": 1, "event_id": ids, "ts": pd.Timestamp("2026-01-01"), "score": [99 if i == 3 else i for i in ids], "interaction": 20, "keyboard_broken": False})
    (found,) = I._stops((1,), iter([rows[:20], rows[20:]]), state)
    assert tuple(found.iloc[0]) == (1, n, 99, 3, "near_perfect")
    assert state.get[0] == n and state.get[6:] == ("near_perfect", 3)


def test_steps_of_a_case_are_cast_once(spark):
    row = '{"id": "a", "test_cases": [{"id": "c", "steps": [{"action": "wait"}, {"text": "x"}, {"action": null}]}]}'
    other = '{"id": "a", "language": "zh", "test_cases": [{"id": "c", "steps": [{"action": "wait"}, {"text": "y"}, {"action": "wait"}]}]}'
    sides = [spark.range(1).select(F.lit("f").alias("file"), F.lit(1).alias("pos"), F.parse_json(F.lit(x)).alias("item")) for x in (row, other)]
    found = B.strict_alignment(*sides, ("f",))
    # A missing action and one that is null are the same, as before.
    assert sorted((r.kind, r.step or 0, r.field) for r in found.collect()) == [("step_action_sequence_mismatch", 0, "steps"), ("step_field_mismatch", 2, "text"), ("step_field_mismatch", 3, "action")]
    # Once in each edition, and the name stands in two kinds of mismatch.
    assert found._jdf.queryExecution().analyzed().toString().count(", steps)") == 4


def outcomes_of(spark):
    rows = [("i", str(k % 3), f"m{k % 4}", "sft" if k % 2 else "base", "" if k % 5 else f"n{k}", float(k % 7), k % 3 == 0 or None if k % 11 else False, (k * 37) % 101) for k in range(100)]
    return rows, spark.createDataFrame(rows, "item_id string, test_id string, model string, group string, name string, weight double, passed boolean, pos long")


def test_statistics_of_tests_dont_sort_all_outcomes(spark):
    rows, outcomes = outcomes_of(spark)
    stats = T.pass_stats(outcomes, "m2")
    plan = [line for line in stats._jdf.queryExecution().sparkPlan().treeString().splitlines() if "Aggregate(" in line]
    assert re.search(r"\bHashAggregate", plan[-1]), "only aggregates of numbers hash as many keys as there are"
    for r in stats.collect():
        own = sorted((x for x in rows if x[1] == r.test_id), key=lambda x: x[7])
        sft, base, m2 = ([x for x in own if x[i] == v] for i, v in ((3, "sft"), (3, "base"), (2, "m2")))
        passed = lambda xs: sum(bool(x[6]) for x in xs)
        assert (r.observations, r.passed, r.sft_observations, r.sft_passed) == (len(own), passed(own), len(sft), passed(sft))
        assert (r.non_sft_observations, r.non_sft_passed, r.target_observations, r.target_passed) == (len(base), passed(base), len(m2), passed(m2))
        assert (r.groups, r.name, r.weight, r.first_pos) == ("base,sft", next((x[4] for x in own if x[4]), ""), own[-1][5], own[0][7])


def test_outcomes_dont_move_to_meet_kept_tests(spark, monkeypatch):
    rows, outcomes = outcomes_of(spark)
    kept = spark.createDataFrame([("i", "1")], "item_id string, test_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = T.filtered_rates(outcomes, kept)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().sparkPlan().treeString()
        monkeypatch.setattr(T, "BROADCAST_TESTS", 0)
        many = T.filtered_rates(outcomes, kept)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().sparkPlan().treeString()
        assert sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(r.kept_total for r in few.collect()) == sum(x[1] == "1" for x in rows)
