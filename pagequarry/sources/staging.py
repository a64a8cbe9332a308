"""Tables in the shared folder: they cut lineage, so that a lost executor recomputes no more than the step it ran."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch holds at most, so that long texts don't fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes; whole long texts stay whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; a new local one where it is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-stages-')}"
    return found.rstrip("/")


def cut(df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
    """Writes ``df`` (with Parquet's ``options``) and reads it back."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``cut`` wrote, once what was made of it has been written itself."""
    files = df.inputFiles()
    if not files:
        return
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
