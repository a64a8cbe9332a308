"""Benchmark items from files: JSON lines and whole JSON files (an object or a list of them), in the order of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators.items import normalized

FIELDS = "id string, language string, prompt string, category string, source_category string, sub_type string, difficulty string, has_interaction boolean, response string, test_cases variant"
EDITIONS = ("en", "zh")


def roots(spark: SparkSession, path: str, lines: str, whole: str) -> list[str]:
    """``path`` itself, or, where it has files in folders ``en`` or ``zh``, only these."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    first = F.substring_index(F.substring_index("path", f"/{name}/", -1), "/", 1)
    found = {r[0] for r in read.option("pathGlobFilter", f"{{{lines},{whole}}}").load(path).select(first.alias("f")).where(F.col("f").isin(*EDITIONS)).distinct().collect()}
    return [f"{path.rstrip('/')}/{e}" for e in EDITIONS if e in found] or [path]


def benchmark(
    spark: SparkSession, path: str, language: str = "", category: str = "", difficulty: str = "", lines: str = "*.jsonl", whole: str = "*.json", fields: str = FIELDS
) -> DataFrame:
    """Items of a file or a folder with its subfolders: ``fields``, with ``file``, and ``place``, whose order is that of the files: by edition, whole
    files before lines, by path, and within a file.

    Of a folder with ``en`` or ``zh`` in it only these are read.  ``language`` and ``difficulty`` are pushed down to the reader of JSON, ``category`` (families
    or older names) is told by the family.  Lines that aren't JSON objects are left out.
    """
    is_file = path.endswith((".json", ".jsonl"))
    at = [path] if is_file else roots(spark, path, lines, whole)
    parts = []
    for e, root in enumerate(at):
        for kind, (glob, options) in enumerate(((whole, {"multiLine": "true"}), (lines, {}))):
            if is_file and path.endswith(".jsonl") != (kind == 1):
                continue
            more = {} if is_file else {"pathGlobFilter": glob, "recursiveFileLookup": "true"}
            read = spark.read.schema(f"{fields}, __broken string").options(columnNameOfCorruptRecord="__broken", **options, **more).json(root)
            for name, value in (("language", language), ("difficulty", difficulty)):
                read = read.where(F.col(name) == value) if value else read
            place = F.struct(F.lit(e).alias("edition"), F.lit(kind).alias("kind"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            parts.append(read.select("*", F.col("_metadata.file_path").alias("file"), place.alias("place")).where("__broken is null").drop("__broken"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    rows = rows.where(taxonomy.matches(F.col("category"), F.col("source_category"), category)) if category else rows
    return normalized(rows)
