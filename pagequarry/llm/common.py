"""What the training-data operators share: reading, hash folds, tables that cut lineage, id joins."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import bounded, cut, folder

#: Ids that are broadcast at most for an anti join (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Narrow rows (some numbers each) that are broadcast at most.
BROADCAST_ROWS = 250_000

#: The column that numbers rows.
ROW = "__row_number"


def session(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes; whole long texts stay whole."""
    return bounded(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new temporary one in local mode only."""
    return folder(spark)


def materialize(df: DataFrame, tag: str, codec: str = "zstd", **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    return cut(df, tag, codec, **options)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has ``limit`` rows at most."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def free_name(docs: DataFrame, name: str = ROW) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _of_files(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a file: a scan, of which rows and columns may have been left out, and nothing else."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, tag: str = "numbered", name: str = ROW) -> DataFrame:
    """``docs`` with a number of its own for every row (``name``) that stays from scan to scan; ids may be null or repeated.

    A table read from Parquet files is numbered by file and place in the file; any other is written first.
    """
    file, place = free_name(docs, "__file"), free_name(docs, "__place")
    at = None
    if _of_files(docs):
        try:
            at = docs.withColumns({file: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
        except AnalysisException:  # files of another format
            pass
    if at is None:
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), tag)
    # One row per file; files hold fewer than 2 ** 33 rows.
    files = materialize(at.select(file).distinct().coalesce(1).select(F.col(file).alias("__of"), F.monotonically_increasing_id().alias("__number")), f"{tag}-files")
    number = F.shiftleft("__number", 33).bitwiseOR(F.col(place))
    return at.join(small(files), F.col(file) == F.col("__of")).withColumn(name, number).select(*(F.col(f"`{c}`") for c in docs.columns), name)


def without_ids(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` whose ``id_col`` is not in ``ids`` (one column of that name; materialized).  Rows with a null id stay.

    The ids are broadcast if they are ``limit`` at most, else both sides shuffle and only the ids are hashed.
    """
    ids = ids.select(F.col(id_col).alias("__gone")).where(F.col("__gone").isNotNull())
    small = ids.limit(limit + 1).count() <= limit
    ids = ids.hint("broadcast" if small else "shuffle_hash")
    return docs.join(ids, docs[id_col] == ids["__gone"], "left_anti")


def release_arrow() -> None:
    """Gives back what Arrow's pool has kept of freed arrays: a Python worker serves later steps too."""
    pa.default_memory_pool().release_unused()


def release_memory() -> None:
    """Gives back what Arrow's pool and the C library have kept of freed arrays."""
    release_arrow()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


@contextmanager
def narrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Bounds Arrow batches by ``size`` bytes for the plans that are run inside; a row of more stays whole, in a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def text_bytes(texts: Iterable[str | None]) -> Iterable[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return (b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts)
