"""Incremental runs with Structured Streaming: windows, latest-wins tables, first-seen rows, early stops.

Each job reads new files of a source once (``availableNow``) and keeps its progress and its results under a folder that is given
(``at``): the same job started again with the folder goes on where it stopped, after a clean end as after a crash.  Without a folder
it starts anew in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.repair import stop_rule
from ..sources.staging import folder

#: Parts of a table by key; a micro-batch rewrites those that it touches.
PARTS = 16


def stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """The files of ``path`` (a file, folder or pattern) as a stream with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def run(df: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs ``df`` over all that is there and reads its output back; ``at`` is the folder of an earlier run to go on with."""
    spark = df.sparkSession
    at = at or f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind; rows later than ``late`` are left out."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users: begin, end and number of events."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def place(spark: SparkSession, name: str, at: str | None = None) -> str:
    return at or f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def upsert(rows: DataFrame, keys: list[str], best: Callable[[Column, Column], Column], order: Column, at: str, mode: str = "append", parts: int = PARTS) -> DataFrame:
    """Keeps a table of one row per key over micro-batches: the row that ``best`` (``max_by`` or ``min_by``) picks by ``order``.

    The table is cut in ``parts`` by a hash of the key.  A micro-batch reads and rewrites the parts that it touches; a manifest by batch
    number says which version of each part counts.  A batch that is repeated after a failure finds the manifest of the one before it
    and writes the same version again.
    """
    spark, schema = rows.sparkSession, rows.schema
    part = F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), F.lit(parts))
    read = lambda paths: spark.read.schema(schema).parquet(*paths)
    paths = lambda manifest: [f"{at}/rows/version={v}/__part={p}" for p, v in sorted(manifest.items())]

    def merge(batch: DataFrame, number: int) -> None:
        before = {r.part: r.version for r in spark.read.parquet(f"{at}/manifests/batch={number - 1}").collect()} if number else {}
        batch = batch.persist()
        touched = {r.p for r in batch.select(part.alias("p")).distinct().collect()}
        old = {p: v for p, v in before.items() if p in touched}
        both = batch.unionByName(read(paths(old))) if old else batch
        kept = both.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(best(F.struct(*schema.names), order).alias("__row")).select("__row.*")
        kept.withColumn("__part", part).write.mode("overwrite").partitionBy("__part").parquet(f"{at}/rows/version={number}")
        manifest = [(int(p), int(v)) for p, v in (before | dict.fromkeys(touched, number)).items()]
        spark.createDataFrame(manifest, "part long, version long").coalesce(1).write.mode("overwrite").parquet(f"{at}/manifests/batch={number}")
        batch.unpersist()

    started = rows.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    try:
        manifests = spark.read.schema("part long, version long, batch long").parquet(f"{at}/manifests")
    except Exception as e:  # no batch yet: the source was empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    last = manifests.agg(F.max("batch")).first()[0]
    now = {r.part: r.version for r in manifests.where(F.col("batch") == last).collect()}
    return read(paths(now)) if now else spark.createDataFrame([], schema)


def upsert_latest(rows: DataFrame, keys: list[str], order: str, at: str) -> DataFrame:
    """The last row of each key."""
    return upsert(rows, keys, F.max_by, F.col(order), at)


def first_seen(rows: DataFrame, keys: list[str], order: str, at: str) -> DataFrame:
    """The first row of each key: what a resumed run has done already.  The keys are kept in a table, not in a growing state."""
    return upsert(rows, keys, F.min_by, F.col(order), at)


STATE = "count long, best long, interaction long, broken boolean, since long, low long, reason string, stopped long"
#: What the rule reads of a row.
RULED = ("event_id", "score", "interaction", "keyboard_broken")
STOPS = "user_id long, iterations long, best long, stopped_at long, reason string"


def _stops(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The early-stop rule over a user's rows; all parts of a micro-batch are put in order before it goes on."""
    if state.hasTimedOut:
        state.remove()
        return
    count, *rest, stopped = state.get if state.exists else (0, 0, 0, False, 0, 0, None, -1)
    now = dict(zip(("best", "interaction", "broken", "since", "low", "reason"), rest, strict=True)) if count else {}
    found = list(parts)
    rows = found[0] if len(found) == 1 else pd.concat(found)
    count += len(rows)
    if not now or now["reason"] is None:
        ordered = rows if rows["event_id"].is_monotonic_increasing else rows.sort_values("event_id")
        # Rows behind the stop are only counted.
        for cells in zip(*(ordered[c].tolist() for c in RULED), strict=True):
            row = dict(zip(RULED, cells, strict=True))
            now, stopped = stop_rule(now, row), row["event_id"]
            if now["reason"] is not None:
                break
    state.update((int(count), int(now["best"]), int(now["interaction"]), bool(now["broken"]), int(now["since"]), int(now["low"]), now["reason"], int(stopped)))
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame({"user_id": [key[0]], "iterations": [int(count)], "best": [int(now["best"])], "stopped_at": [int(stopped)], "reason": [now["reason"] or "exhausted"]})


#: A user's state is dropped when nothing has come for so long (ms of event time).
IDLE_MS = 90 * 24 * 3600 * 1000


def early_stops(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Per user (user_id, event_id, ts, score, interaction, keyboard_broken): where repairs would have stopped, as a state that goes on over
    micro-batches."""
    watched = events.withWatermark("ts", late)
    return watched.groupBy("user_id").applyInPandasWithState(_stops, STOPS, STATE, "update", GroupStateTimeout.EventTimeTimeout)
