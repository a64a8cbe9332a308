"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> SimHash near-dedup -> benchmark decontamination -> mixing sources to target weights -> token-id files

Null texts count as empty in every stage, null and repeated ids are rows like any other, and long texts are processed whole.  Columns
of ``documents`` keep their names and types up to the last stage; extra columns go along.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import components, decontaminate, jaccard_groups, mixing, quality, simhash, token_files
from pagequarry.llm.common import free_name, materialize, numbered, read, session, shared_dir, without_ids


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(session(spark) and docs, read(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least doc_id, or any row where no row of the group has an id.

    Groups are those of links by SimHash (three words, three bits) and by five-word shingles (similarity 0.8 or more).  Texts without
    words are one group.  A row stays or goes by its own text, whatever its id.
    """
    row = free_name(docs)
    rows = numbered(docs, name=row)
    groups = simhash.near_duplicates(rows, shingle=3, id_col=row).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    similar = jaccard_groups.similar_sets(rows, id_col=row).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    named = components.components(groups.unionByName(similar).where("a <> b")).select("node", "component")
    named = materialize(named.join(rows.select(F.col(row).alias("node"), "doc_id"), "node"), "near-duplicates")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first"))
    gone = materialize(named.select("node").join(first.select(F.col("first.node").alias("node")), "node", "left_anti").select(F.col("node").alias(row)), "near-duplicate-rows")
    return without_ids(rows, gone, id_col=row).drop(row)


def unleaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in random order."""
    # Whole rows travel as one column, so that no name of theirs meets one of the operator's.
    rows = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return mixing.mix(rows).select("row.*")


def token_id_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", unleaked_documents),
    ("source mixing", mixed_documents),
    ("token-id files", token_id_files),
]

#: SQL can't express the trained classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    out = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{out}/{i}")
        docs = spark.read.schema(done.schema).parquet(f"{out}/{i}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
ORACLES: dict[str, str] = {}
