"""JSON-lines sources: permissive lines, benchmark items, runs laid out in folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file or folder: the file, the physical line number (from 0, blank and bad lines counted) and the fields of ``schema``.

    Lines that aren't a JSON object are left out.  Every split of a file numbers its own lines; the lines of the splits before it are
    added from a table of one row per split, so that a large file isn't numbered by one task.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block")
    raw = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("__at"), "value")
    splits = raw.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # One row per split: small beside the lines, which stay where they are.
    placed = raw.join(F.broadcast(splits.select("file", "__block", "__first", before.alias("__before"))), ["file", "__block"])
    numbered = placed.withColumn("line_idx", F.col("__before") + F.col("__at") - F.col("__first"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    return numbered.where(is_object).withColumn("r", parsed).select("file", "line_idx", "r.*")


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of ``.json`` files (an object or a list of objects) and ``.jsonl`` files of a folder, with subfolders."""
    options = {"recursiveFileLookup": "true"}
    whole = spark.read.options(multiLine="true", pathGlobFilter="*.json", **options).schema(schema).json(path)
    return whole.unionByName(spark.read.options(pathGlobFilter="*.jsonl", **options).schema(schema).json(path))


def run_columns(path: Column) -> dict[str, Column]:
    """Group, configuration and model of a results file from its path ``.../outputs/{group}__{config}/{model}/...``."""
    own = F.regexp_extract(path, "/outputs/([^/]+)/([^/]+)/", 1)
    parts = F.split(own, "__", 2)
    two = F.array_size(parts) > 1
    return {"group": F.when(two, parts[0]).otherwise("unknown"), "config": F.when(two, F.get(parts, 1)).otherwise(own), "model": F.regexp_extract(path, "/outputs/([^/]+)/([^/]+)/", 2)}


def runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All results of ``root/outputs/*/*/en/full/results.jsonl`` but stale ones, with the run's group, configuration and model."""
    found = lines(spark, f"{root}/outputs/*/*/en/full/results.jsonl", schema).where(~F.contains("file", F.lit("outputs_stale")))
    return found.withColumns(run_columns(F.col("file")))


def write_lines(rows: DataFrame, path: str, column: str = "value") -> None:
    """Writes a column of texts as lines of files in a folder."""
    rows.select(F.col(column).alias("value")).write.text(path)


def first_existing(rows: DataFrame, candidates: str, listing: DataFrame) -> DataFrame:
    """``rows`` with ``found``: the first of their candidate paths (an array column) that ``listing`` (path) has, or null.

    Paths are never followed row by row: the candidates meet the listing in one join.  Rows need a unique ``uid``.
    """
    named = rows.select("uid", F.posexplode(candidates).alias("place", "path")).join(listing.select("path").distinct(), "path")
    best = named.groupBy("uid").agg(F.min_by("path", "place").alias("found"))
    return rows.join(best, "uid", "left")
