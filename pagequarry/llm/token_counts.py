"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent words (with the blank before them and the marks behind) and their token counts, broadcast
to all tasks; tier two is each worker's own bounded cache, filled through the tokenizer.  No pre-token of a text is ever
shuffled: only each task's ``LOCAL_TOP`` most frequent words are summed to choose the table.

Null text counts as empty (0 tokens).  Rows with equal or null ids stay rows of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session
from .pieces import KEPT_LENGTH, OPENING, Plan, special_strings, split, worker_encoder

#: Pieces that a task reports, pieces that are counted at once before rare ones go, and entries of the broadcast table.
LOCAL_TOP, LOCAL_HELD, TABLE_ENTRIES = 2048, 400_000, 32_768
LIMIT = 512


def frequent_pieces(docs: DataFrame, text: str, special: dict[str, int], entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent pieces over all whole texts, by lossy counting in each task; ``entries`` rows at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            found = split(Plan([t or "" for t in batch.column(0).to_pylist()], special).parts).flatten().value_counts()
            own = zip(found.field("values").to_numpy(zero_copy_only=False).tolist(), found.field("counts").to_numpy().tolist(), strict=True)
            for word, n in own:
                seen[word] += n
            if len(seen) > LOCAL_HELD:
                seen = Counter(dict(seen.most_common(LOCAL_HELD // 2)))
        top = [x for x in seen.most_common(LOCAL_TOP) if not x[0].startswith(OPENING) and len(x[0]) <= KEPT_LENGTH]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([k for k, _ in top], pa.string()), "n": pa.array([v for _, v in top], pa.int64())})

    counted = docs.select(F.col(text)).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in counted.orderBy(F.desc("n"), "piece").limit(entries).collect()]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = session(docs.sparkSession)
    lengths = worker_encoder(path).cache
    table = {p: lengths[p] for p in frequent_pieces(docs, text_col, special_strings(path), entries)}
    shared = spark.sparkContext.broadcast(table)

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(path)
        encode.cache.first = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = encode.lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return kept.mapInArrow(lookup, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
