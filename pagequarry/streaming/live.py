"""A run that can be watched while it goes on, and one whose failures come back: progress by micro-batch, state by item, retries by key."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.analysis import COMPLETED
from .incremental import upsert_latest

OBSERVED = "live"
PROGRESS = "batch long, at string, rows long, completed long, failed long, points long, seconds double"


class Progress(StreamingQueryListener):
    """Keeps what each micro-batch of an observed stream reported; at most ``most`` of them."""

    def __init__(self, most: int = 10_000):
        self.rows: list[tuple] = []
        self.most = most

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        told = json.loads(event.progress.json)
        seen = told.get("observedMetrics", {}).get(OBSERVED)
        if seen and seen.get("rows"):
            self.rows = [*self.rows, (told["batchId"], told["timestamp"], seen["rows"], seen["completed"], seen["failed"], seen["points"], told["durationMs"].get("triggerExecution", 0) / 1000)][-self.most :]


def observed(results: DataFrame) -> DataFrame:
    """Results (eval_status, total) that report, as they pass, how many there are, completed and failed, and the completed ones' points."""
    done = F.col("eval_status").isin(*COMPLETED)
    points = F.coalesce(F.sum(F.when(done, F.col("total"))), F.lit(0)).alias("points")
    return results.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("completed"), F.count_if(F.col("eval_status") == "failed").alias("failed"), points)


def watched(results: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """Runs a stream of results to the end of what is there, keeps the last of each key under ``at`` and writes every micro-batch's report to
    ``at/progress``, also if the run breaks off.  Started again with ``at``, it goes on."""
    spark, listener = results.sparkSession, Progress()
    spark.streams.addListener(listener)
    try:
        return upsert_latest(observed(results), [key], order, at)
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
        spark.createDataFrame(listener.rows, PROGRESS).coalesce(1).write.mode("append").parquet(f"{at}/progress")


def progress(results: DataFrame, at: str) -> DataFrame:
    """Each micro-batch's last report, with results a minute."""
    read = results.sparkSession.read.schema(PROGRESS).parquet(f"{at}/progress")
    last = read.groupBy("batch").agg(F.max_by(F.struct("rows", "completed", "failed", "points", "seconds"), "at").alias("r")).select("batch", "r.*")
    return last.withColumn("per_minute", F.bround(F.col("rows") * 60 / F.greatest("seconds", F.lit(0.001)), 2))


def live_state(table: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """One row: how many of ``items`` (``key``, generated: whether there is something to evaluate) are there, generated, evaluated, completed and failed,
    pending for both steps, and the completed ones' averages."""
    now = items.join(table.select(F.col(key), "eval_status", "total", "test_pass_rate"), key, "left")
    done, failed = F.col("eval_status").isin(*COMPLETED), F.col("eval_status") == "failed"
    terminal = F.coalesce(done | failed, F.lit(False))
    return now.agg(
        F.count("*").alias("total_items"), F.count_if("generated").alias("generated"), F.count_if(terminal).alias("evaluated"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"),
        F.count_if(~F.col("generated")).alias("pending_generation"), F.count_if(F.col("generated") & ~terminal).alias("pending_evaluation"),
        F.bround(F.avg(F.when(done, F.col("total"))), 2).alias("avg_score_completed"), F.bround(F.avg(F.when(done, F.col("test_pass_rate"))), 4).alias("avg_test_pass_rate_completed"),
    )


def pending(table: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Items to be evaluated yet, or again: generated, but without a result that completed."""
    done = table.where(F.col("eval_status").isin(*COMPLETED)).select(key)
    return items.where("generated").join(done, key, "left_anti").select(key)


RETRIES = "uid string, attempt int, action string"


class Retries(StatefulProcessor):
    """Per key: how often it was tried, and whether it is settled.  A failure asks for another try until ``most`` of them; what comes after a
    success or after the last try is ignored.  Settled keys are forgotten after ``ttl`` (ms of processing time), if it is given."""

    def __init__(self, most: int, order: str, ttl: int | None):
        self.most, self.order, self.ttl = most, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "attempts int, settled boolean", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        attempts, settled = self.state.get() if self.state.exists() else (0, False)
        out = []
        for status in pd.concat(list(rows)).sort_values(self.order)["eval_status"]:
            if settled:
                break
            attempts += 1
            settled = status in COMPLETED or attempts >= self.most
            out.append((key[0], attempts, "done" if status in COMPLETED else "gave up" if settled else "retry"))
        self.state.update((attempts, settled))
        yield pd.DataFrame(out, columns=["uid", "attempt", "action"])

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def retries(outcomes: DataFrame, order: str, at: str, most: int = 3, ttl: int | None = None) -> DataFrame:
    """(uid, attempt, action) of a stream of outcomes (uid, eval_status, ``order``): every try with what follows from it.

    The state is kept by key under ``at``, not in a table that is rewritten: a run that is started again knows all former tries.  Rows
    whose last action is ``retry`` are those to be tried again.
    """
    spark = outcomes.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        tried = outcomes.groupBy("uid").transformWithStateInPandas(Retries(most, order, ttl), RETRIES, "Append", "None" if ttl is None else "ProcessingTime")
        query = tried.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows")
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(RETRIES).parquet(f"{at}/rows")


def to_retry(tries: DataFrame) -> DataFrame:
    """(uid, attempt) of keys whose last try asks for another."""
    last = tries.groupBy("uid").agg(F.max_by(F.struct("attempt", "action"), "attempt").alias("t")).select("uid", "t.*")
    return last.where("action = 'retry'").select("uid", "attempt")
