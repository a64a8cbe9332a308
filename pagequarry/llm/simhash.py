"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  If two fingerprints differ in at most three bits, one of
the segments differs in at most one; with that bit deleted the segments are equal.  So each distinct fingerprint is
indexed under its 2 x 32 one-wildcard variants (segment, deleted position, the 31 bits left), an equality shuffle brings
equal variants together, and the pairs in a bucket are verified by the Hamming distance of the whole fingerprints.

Exact copies collapse to one fingerprint first.  A bucket reports a spanning forest of its links, never all pairs; a bucket of
over ``BUCKET`` fingerprints is cut into blocks (of ``BLOCK``) whose pairs are spread over tasks, so that no task holds it whole.

Null or word-less text: fingerprint zero, linked like any other.  Fewer words than the shingle: one shingle of all.
Null ids are rows too and never become a component's name.  Repeated rows are kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, session, text_bytes
from .components import components

SEED, MAX_BITS = 42, 3
SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints of a bucket that are compared at once, and of a block of a larger bucket: each fingerprint is sent to as many tasks as
#: its bucket has blocks.
BUCKET, BLOCK = 512, 8192


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' XXH64 (repeats included)."""
    import xxhash

    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i : i + 4096], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.lower().split(), shingle) for t in text_bytes(batch.column(1).to_pylist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kept = session(docs.sparkSession) and docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """The 64 signatures of a fingerprint: segment and deleted position (6 bits) above the 31 bits that are left."""
    out = []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        for p in range(SEGMENT_BITS):
            left = F.shiftleft(F.shiftright(segment, p + 1), p).bitwiseOR(segment.bitwiseAND(F.lit((1 << p) - 1)))
            out.append(left.bitwiseOR(F.lit((s * SEGMENT_BITS + p) << SEGMENT_BITS)))
    return F.array(*out)


def _linked(key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints of ``a`` and ``b`` are linked and belong to this bucket.

    Segments that are equal meet in all 32 buckets of the segment and count in the one with position 0; others meet where the
    differing bit is deleted.
    """
    diff = a[:, None] ^ b[None, :]
    place = key >> SEGMENT_BITS
    s, p = divmod(place, SEGMENT_BITS)
    here = (diff >> np.uint64(s * SEGMENT_BITS + p)) & np.uint64(1) != 0
    if p == 0:
        here |= (diff >> np.uint64(s * SEGMENT_BITS)) & np.uint64((1 << SEGMENT_BITS) - 1) == 0
    return here & (np.bitwise_count(diff) <= MAX_BITS)


def _forest(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the bipartite links between ``a`` and ``b`` (which may be the same): at most one edge per node."""
    edges, seen_a, seen_b = [], np.zeros(len(a), bool), np.zeros(len(b), bool)
    for start in np.flatnonzero(linked.any(1)):
        if seen_a[start]:
            continue
        seen_a[start], queue = True, [(True, start)]
        while queue:
            left, i = queue.pop()
            if left:
                new = np.flatnonzero(linked[i] & ~seen_b)
                seen_b[new] = True
                edges += [(a[i], b[j]) for j in new]
            else:
                new = np.flatnonzero(linked[:, i] & ~seen_a)
                seen_a[new] = True
                edges += [(a[j], b[i]) for j in new]
            queue += [(not left, j) for j in new]
    return edges


EDGES = "key long, a long, b long"


def _edge_batch(key: np.ndarray | list, a: np.ndarray | list, b: np.ndarray | list | None) -> pa.RecordBatch:
    as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if key is None else pa.array(np.array(key, np.int64)), as_long(a), pa.nulls(n, pa.int64()) if b is None else as_long(b)], names=["key", "a", "b"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, fp) sorted by key: links of each bucket as (null, a, b); rows of too large buckets as (key, fp, null)."""
    held_k, held_f, over = np.empty(0, np.int64), np.empty(0, np.uint64), None

    def close(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        begin, end = np.r_[0, cuts], np.r_[cuts, len(keys)]
        size = end - begin
        two = begin[size == 2]
        if len(two):
            x, y, place = fps[two], fps[two + 1], keys[two] >> SEGMENT_BITS
            diff, s, p = x ^ y, (place // SEGMENT_BITS * SEGMENT_BITS).astype(np.uint64), (place % SEGMENT_BITS).astype(np.uint64)
            segment = (diff >> s) & np.uint64((1 << SEGMENT_BITS) - 1)
            ok = (((segment >> p) & np.uint64(1) != 0) | ((p == 0) & (segment == 0))) & (np.bitwise_count(diff) <= MAX_BITS)
            if ok.any():
                yield _edge_batch(None, x[ok], y[ok])
        edges = []
        for i, j in zip(begin[size > 2], end[size > 2], strict=True):
            if j - i > BUCKET:
                yield _edge_batch(keys[i:j], fps[i:j], None)
            else:
                own = fps[i:j]
                edges += _forest(_linked(int(keys[i]), own, own), own, own)
        if edges:
            a, b = zip(*edges, strict=True)
            yield _edge_batch(None, a, b)

    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if over is not None:  # the rest of a bucket that was too large already
            same = int(np.searchsorted(k, over, "right"))
            if same:
                yield _edge_batch(k[:same], f[:same], None)
                k, f = k[same:], f[same:]
            if not len(k):
                continue
            over = None
        held_k, held_f = np.r_[held_k, k], np.r_[held_f, f]
        if not len(held_k):
            continue
        last = int(np.searchsorted(held_k, held_k[-1], "left"))
        if last:
            yield from close(held_k[:last], held_f[:last])
            held_k, held_f = held_k[last:], held_f[last:]
        if len(held_k) > BUCKET:
            yield _edge_batch(held_k, held_f, None)
            over, held_k, held_f = int(held_k[-1]), held_k[:0], held_f[:0]
    if len(held_k):
        yield from close(held_k, held_f)


def _block_pair(table: pa.Table) -> pa.Table:
    """The links between blocks i and j of a large bucket, as a forest."""
    i, j, key = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("key")[0].as_py()
    fps, block = table.column("fp").to_numpy().view(np.uint64), table.column("block").to_numpy()
    a, b = fps[block == i], fps[block == j]
    edges = []
    for x in range(0, len(a), 1024):
        for y in range(0, len(b), 1024):
            edges += _forest(_linked(key, a[x : x + 1024], b[y : y + 1024]), a[x : x + 1024], b[y : y + 1024])
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.Table.from_batches([_edge_batch(None, a, b)]).select(["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct`` (fp) within ``MAX_BITS``."""
    n = 4 * partitions(distinct.sparkSession)
    indexed = distinct.select(F.explode(variants(F.col("fp"))).alias("key"), "fp")
    found = materialize(indexed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_buckets, EDGES), "simhash-links")
    edges = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    counted = large.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocked = large.join(counted, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    return edges.unionByName(paired.groupBy("key", "i", "j").applyInArrow(_block_pair, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id that is reachable over links; one row per row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    label = components(links(first.select("fp"))).select(F.col("node").alias("fp"), "component")
    named = first.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
