"""Looking up few records among many: a table sorted by key with an index of its files, and heads of long lines.

Files hold ranges of keys, so a lookup opens the few files whose range may hold a key, and in them, by the statistics of their row
groups, the few groups that may.  The index has one row per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a trace's line that are looked at for its head; the page comes behind them.
HEAD = 5000
#: Bytes of a row group of a sorted table.
GROUP = 1 << 20


def build(rows: DataFrame, key: str, path: str, parts: int | None = None, group: int = GROUP) -> None:
    """Writes ``rows`` sorted by ``key`` in files of key ranges under ``path/rows``, and their index under ``path/index``."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.option("parquet.block.size", group).parquet(f"{path}/rows")
    read = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"))
    read.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).write.parquet(f"{path}/index")


def find(spark: SparkSession, path: str, key: str, values: list) -> DataFrame:
    """The rows whose ``key`` is one of some values; only files whose range holds one of them are opened."""
    index, rows = spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/rows")
    holds = F.lit(False)
    for v in values:
        holds = holds | F.lit(v).between(F.col("low"), F.col("high"))
    files = [r.file for r in index.where(holds).select("file").collect()]
    return spark.read.schema(rows.schema).parquet(*files).where(F.col(key).isin(*values)) if files else rows.limit(0)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("r")).select(key, "r.*")


def trace_heads(lines: DataFrame, value: str = "value", order: str = "line_idx") -> DataFrame:
    """(record_id, final_score, improvement) from the first ``HEAD`` characters of traces' lines, without parsing what is behind; of a record's lines
    the last.  Lines without an id are left out, scores that aren't there are 0."""
    # As many bytes that are as many characters are the head; only other texts are counted through.
    some = F.substring(F.col(value).cast("binary"), 1, HEAD).cast("string")
    head: Column = F.when(F.char_length(some) == F.least(F.octet_length(value), F.lit(HEAD)), some).otherwise(F.substring(value, 1, HEAD))
    # The head is a variable of a function, so that it is made once a line and not for each field.
    patterns = {"record_id": '"record_id"\\s*:\\s*"([^"]+)"', "final_score": '"final_score"\\s*:\\s*(\\d+)', "improvement": '"improvement"\\s*:\\s*(-?\\d+)'}
    told = F.get(F.transform(F.array(head), lambda h: F.struct(*(F.regexp_extract(h, p, 1).alias(n) for n, p in patterns.items()))), 0)
    number = lambda name: F.coalesce(F.nullif(F.col(f"told.{name}"), F.lit("")).cast("long"), F.lit(0)).alias(name)
    found = lines.select(told.alias("told"), order).select("told.record_id", number("final_score"), number("improvement"), order)
    # Numbers of fixed width are aggregated by hashing, a struct would be sorted.  Lines without an id are left out behind it: a test of the id before it would make each line and its head twice.
    last = found.groupBy("record_id").agg(*(F.max_by(c, order).alias(c) for c in ("final_score", "improvement")), F.max(F.col("record_id") != "").alias("named"))
    return last.where("named").drop("named")
