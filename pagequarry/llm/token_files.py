"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

An id is replaced by its rank (0: most frequent over the whole corpus), and a rank takes as few whole bytes as it needs (1 to
4).  Two bits per id say how many; four ids share a control byte, and control bytes and data bytes are stored apart,
so that a block is decoded with numpy: one table lookup gives the lengths of all ids of a control byte.

The files are a Parquet data set (binary columns, no second compression) with one row per block of documents, in ascending
doc_id order (null ids first; equal ids in the order of their coded texts), written by range-partitioned tasks, beside a small table of ids by rank.

Null text counts as empty: it is stored as the end id alone.  An empty table gives empty files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, partitions, session, shared_dir
from .pieces import release_encoders, tokenizer, worker_encoder

#: Bytes of ids (4 each) that a block gathers before it is closed.
BLOCK_BYTES = 1 << 20
END_ID = 0


@lru_cache(maxsize=1)
def length_table() -> np.ndarray:
    """Row b: the byte lengths (1 to 4) of the four ids whose control byte is b."""
    b = np.arange(256)
    return np.stack([(b >> (2 * i) & 3) + 1 for i in range(4)], axis=1).astype(np.int64)


def pack(values: np.ndarray, runs: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each run of unsigned 32-bit values; ``runs`` holds their lengths."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = -(-runs // 4)
    ends, slots = np.cumsum(runs), np.cumsum(padded)
    wide = np.zeros(4 * int(padded.sum()), np.uint8)
    wide[np.arange(len(v)) + np.repeat(4 * (slots - padded) - (ends - runs), runs)] = code
    control = (wide.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()
    until = np.r_[0, np.cumsum(code.astype(np.int64) + 1)][np.r_[0, ends]].tolist()
    at = np.r_[0, slots].tolist()
    return [control[i:j] for i, j in zip(at, at[1:], strict=False)], [data[i:j] for i, j in zip(until, until[1:], strict=False)]


def unpack(control: bytes, data: bytes, runs: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block whose runs (documents) each begin a control byte; ValueError if the streams don't fit."""
    slots = length_table()[np.frombuffer(control, np.uint8)].ravel()
    padded = -(-runs // 4) * 4
    if padded.sum() != len(slots):
        raise ValueError("control bytes and counts disagree")
    used = np.arange(len(slots)) - np.repeat(np.cumsum(padded) - padded, padded) < np.repeat(runs, padded)
    lengths = slots[used]
    if lengths.sum() != len(data):
        raise ValueError("control and data bytes disagree")
    mask = np.arange(4) < lengths[:, None]
    octets = np.zeros((n, 4), np.uint8)
    octets[mask] = np.frombuffer(data, np.uint8)
    return octets.view("<u4").ravel()


def token_ids(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """id, and each whole text's token ids with the end id, as little-endian 16- or 32-bit integers."""
    dtype = _dtype(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = worker_encoder(path, dtype)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(run.ids(batch.column(1).to_pylist(), END_ID), pa.binary())], names=["id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(encode, "id long, ids binary")


def _vocabulary(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


def _dtype(path: str) -> str:
    """Ids that fit take two bytes ("H"), others four ("I")."""
    return "I" if _vocabulary(path) > 0x10000 else "H"


def _count(dtype: str, vocabulary: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_encoders()  # this step follows the encoding on the same workers
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=vocabulary)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(there, pa.int64()), "n": pa.array(total[there], pa.int64())})

    return count


def id_ranks(encoded: DataFrame, dtype: str, vocabulary: int) -> np.ndarray:
    """rank of each id by its frequency over all documents (ties: the smaller id first); bounded by the vocabulary."""
    seen = encoded.select("ids").mapInArrow(_count(dtype, vocabulary), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(vocabulary, np.int64)
    for r in seen:
        n[r.token] = r.n
    rank = np.empty(vocabulary, np.uint32)
    rank[np.lexsort((np.arange(vocabulary), -n))] = np.arange(vocabulary, dtype=np.uint32)
    return rank


def write_files(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """Encodes ``docs`` into token files at ``out``: ``blocks`` and ``ranks``."""
    spark = session(docs.sparkSession)
    vocabulary, dtype = _vocabulary(path), _dtype(path)
    encoded = materialize(token_ids(docs, path, id_col, text_col), "token-ids")
    rank = id_ranks(encoded, dtype, vocabulary)
    order = np.argsort(rank).tolist()
    spark.createDataFrame(list(enumerate(order)), "rank int, token int").coalesce(1).write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            own = batch.column(1).to_pylist()
            n = np.array([len(x) // np.dtype(dtype).itemsize for x in own], np.int64)
            control, data = pack(ranks[np.frombuffer(b"".join(own), dtype)], n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["id", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, held, total = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            row = {"part": [part], "first": [first], "ids": [[h[0] for h in held]], "n": [[h[1] for h in held]], "control": [b"".join(h[2] for h in held)], "data": [b"".join(h[3] for h in held)]}
            return pa.RecordBatch.from_pydict(row, schema=BLOCK_ARROW)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                total += row[1]
                if 4 * total >= block_bytes:
                    yield close()
                    first, held, total = first + total, [], 0
        if held:
            yield close()

    coded = encoded.mapInArrow(code, "id long, n long, control binary, data binary")
    nulls, bounds = _bounds(encoded, partitions(spark))
    placed = coded.repartitionById(nulls + sum(m for _, m in bounds) + 1, _place(F.col("id"), nulls, bounds))
    ordered = placed.sortWithinPartitions(F.col("id").asc_nulls_first(), "n", "data", "control")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{out}/blocks")


def _bounds(encoded: DataFrame, parts: int) -> tuple[int, list[tuple[int, int]]]:
    """Parts for null ids, and ids that cut the documents into about equal ranges, each with the number of parts that it takes itself (more than
    one where many documents have the id); only the id column is read."""
    size = encoded.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    nulls = -(-parts * size.nulls // size.n) if size.nulls else 0
    found = encoded.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return nulls, sorted(Counter(int(x) for x in found).items())


def _place(id_col: Column, nulls: int, bounds: list[tuple[int, int]]) -> Column:
    """The part of a document: null ids first, then as many parts as the bounds below the id take; documents of one id are dealt by their tokens."""
    dealt = lambda m: F.pmod(F.xxhash64("data", "n"), m).cast("int")
    none = dealt(F.lit(max(nulls, 1)))
    if not bounds:
        return F.when(id_col.isNull(), none).otherwise(F.lit(nulls))
    table = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(m).alias("m")) for b, m in bounds))
    below = F.aggregate(table, F.lit(nulls), lambda at, x: at + F.when(x["b"] < id_col, x["m"]).otherwise(0))
    own = F.get(F.filter(table, lambda x: x["b"] == id_col), 0)["m"]
    return F.when(id_col.isNull(), none).otherwise(below + F.when(own > 1, dealt(own)).otherwise(0))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Decodes token files: doc_id, start, n_tokens, ids_crc32 per document.

    A block knows how many ids precede it in its part; the totals of the parts (one row each, as many as tasks wrote)
    give the rest.
    """
    blocks = session(spark).read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    width = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.groupBy("part").agg(F.max(F.col("first") + width).alias("n")).orderBy("part").collect()
    starts, before = {}, 0
    for r in totals:
        starts[r.part], before = before, before + r.n
    order = np.array([r.token for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    shared = spark.sparkContext.broadcast((starts, order))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, order = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n"], np.int64)
                ids = order[unpack(row["control"], row["data"], n, int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(ends - n + row["first"] + starts[row["part"]], pa.int64()), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, out, id_col, text_col)
    return read_files(spark, out)


BLOCK_SCHEMA = "part int, first long, ids array<long>, n array<long>, control binary, data binary"
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
