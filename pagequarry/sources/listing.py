"""What lies in folders: a recursive listing as a table, artifacts of records by candidate paths, and their contents read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import first_existing

#: Folders of a record's repaired pages, the latest first; those of tests come before those of a whole run.
TEST_ROUNDS, RUN_ROUNDS, PAGE = ("repair_2_repair", "repair_1_repair"), ("repair_3_repair", "repair_2_repair", "repair_1_repair"), "game.html"
KINDS = ("original", "repair_orig", "repaired", "refine_orig", "refined")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, relative, length, modified) of all files under ``root`` whose name fits ``pattern``; their contents aren't read."""
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=pattern).load(root)
    # A path is told from its root by what follows the root's last name.
    name = root.rstrip("/").rsplit("/", 1)[-1]
    relative = F.substring_index("path", f"/{name}/", -1)
    return found.select("path", relative.alias("relative"), "length", F.col("modificationTime").alias("modified"))


def page_candidates(record: Column, kind: str, uid: Column, repaired: Column, refined: Column) -> Column:
    """Where a record's page of a kind may lie, the likeliest first: ``record`` is ``dataset_line``; ``repaired`` and ``refined`` tell whether it
    has such a trace.  Pages of whole runs count only with a trace."""
    at = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit(f"/{PAGE}"))
    scored = at(record, "_default")
    dataset_uid = F.concat(F.regexp_replace(record, "_[^_]*$", ""), F.lit("_"), uid)
    rounds = F.array(*(at(dataset_uid, f"_{r}") for r in RUN_ROUNDS))
    none = F.array().cast("array<string>")
    if kind in ("original", "refine_orig"):
        return F.array(scored)
    if kind == "repair_orig":
        return F.array(at("repairtest_", uid, "_test"), scored)
    if kind == "repaired":
        return F.concat(F.array(*(at("repairtest_", uid, f"_{r}") for r in TEST_ROUNDS)), F.when(repaired, rounds).otherwise(none))
    return F.when(refined, rounds).otherwise(none)


def page_paths(records: DataFrame, listing: DataFrame, repairs: DataFrame, refines: DataFrame) -> DataFrame:
    """(uid, kind, found) for every record (uid, dataset, line_number) and kind: the first candidate that ``listing`` (relative) has, or null.

    ``repairs`` and ``refines`` hold the record_ids (``dataset_uid``) that have a trace."""
    traced = lambda df, name: df.select(F.col("record_id").alias(f"__{name}")).distinct()
    record_id = F.concat("dataset", F.lit("_"), "uid")
    joined = records.withColumn("record_id", record_id)
    for df, name in ((repairs, "repaired"), (refines, "refined")):
        joined = joined.join(traced(df, name), joined["record_id"] == F.col(f"__{name}"), "left")
    record = F.concat("dataset", F.lit("_"), F.col("line_number").cast("string"))
    has = lambda name: F.col(f"__{name}").isNotNull()
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), page_candidates(record, k, F.col("uid"), has("repaired"), has("refined")).alias("candidates")) for k in KINDS))).alias("k")
    asked = joined.select(F.col("uid").alias("owner"), kinds).select("owner", "k.*").withColumn("uid", F.concat("owner", F.lit("/"), "kind"))
    found = first_existing(asked, "candidates", listing.select(F.col("relative").alias("path")))
    return found.select(F.col("owner").alias("uid"), "kind", "found")


def screenshots(records: DataFrame, listing: DataFrame, limit: int | None = None) -> DataFrame:
    """(uid, shots) of records (uid, folder, shots, annotated): the listed ones of their own paths; if there are none, those that annotations name in
    the record's folder; if none again, all ``frame_*.png`` in it by name.  Each path once, in order, ``limit`` at most."""
    there = listing.select(F.col("relative").alias("path"))
    inside = F.transform("annotated", lambda n: F.when(n != "", F.concat("folder", F.lit("/"), n)))
    named = records.select("uid", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("shots").alias("paths")), F.struct(F.lit(1).alias("rank"), inside.alias("paths")))).alias("s"))
    named = named.select("uid", "s.rank", F.posexplode("s.paths").alias("place", "path")).where("path <> ''").join(there, "path")
    framed = there.where(F.regexp_like("path", F.lit(r"/frame_[^/]*\.png$"))).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(records.select("uid", "folder"), "folder")
    # A record's frames are few.
    ranked = named.select("uid", "rank", "place", "path").unionByName(framed.select("uid", F.lit(2).alias("rank"), F.lit(0).alias("place"), "path"))
    best = ranked.groupBy("uid", "rank").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"])).alias("found"))
    first = best.groupBy("uid").agg(F.min_by("found", "rank").alias("found"))
    shots = F.coalesce("found", F.array().cast("array<string>"))
    return records.select("uid").join(first, "uid", "left").select("uid", (F.slice(shots, 1, limit) if limit is not None else shots).alias("shots"))


def sidecars(rows: DataFrame, path: str, contents: DataFrame) -> DataFrame:
    """``rows`` with ``sidecar``, the content of the file that their column ``path`` names: ``contents`` (file, fields ...) holds all files, read once."""
    held = contents.select(F.col("file").alias("__file"), F.struct(*(c for c in contents.columns if c != "file")).alias("sidecar"))
    return rows.join(held, rows[path] == held["__file"], "left").drop("__file")
