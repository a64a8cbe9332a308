"""Curation of a corpus: score tiers, near-duplicate pages by MinHash, training exports."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import cut
from ..sources.tables import spread
from .graph import components

PERMUTATIONS, BANDS, SHINGLE, SIMILARITY = 128, 32, 5, 0.8


def tier(score: Column, a: int = 80, b: int = 40) -> Column:
    return F.when(score >= a, "A").when(score >= b, "B").otherwise("C")


def tiers(rows: DataFrame, need_completed: bool = True) -> DataFrame:
    """Rows with their tier; only those whose status is exactly completed, unless told otherwise."""
    kept = rows.where("eval_status = 'completed'") if need_completed else rows
    return kept.withColumn("tier", tier(F.col("total")))


def tier_counts(rows: DataFrame) -> DataFrame:
    """Rows and shares per tier; the total comes from the few counts."""
    counts = tiers(rows).groupBy("tier").agg(F.count("*").alias("n"), F.sum("total").alias("points"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select("tier", "n", "points", F.bround(F.try_divide(F.col("n") * 100.0, "all"), 1).alias("percent"))


def sft_rows(rows: DataFrame, least: int = 80) -> DataFrame:
    return tiers(rows).where((F.col("tier") == "A") & (F.col("total") >= least)).select(F.col("item_id").alias("query"), F.col("line_idx").alias("source_line"), F.col("total").alias("score"))


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """The table of CRC-32, one entry per byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """The distinct CRC-32 values of the UTF-8 of all runs of ``k`` characters (a shorter text: the whole), all windows at once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    windows, table = max(1, len(points) - k + 1), _crc_table()
    crc = np.full(windows, 0xFFFFFFFF, np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    most = int(width.max(initial=1))
    for i in range(min(k, len(points))):
        c, w = points[i : i + windows], width[i : i + windows]
        for byte in range(most):
            # Byte number ``byte`` of the character's UTF-8: a leading byte, or six more bits.
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[w] if most > 1 else 0
            value = (c >> (6 * (w - 1)).astype(np.uint32) | lead) if byte == 0 else (c >> (6 * np.maximum(w - 1 - byte, 0)).astype(np.uint32)) & 0x3F | 0x80
            new = table[(crc ^ value) & 0xFF] ^ (crc >> 8)
            crc = np.where(w > byte, new, crc) if byte else new
    return np.unique(crc ^ np.uint32(0xFFFFFFFF))


@lru_cache(maxsize=4)
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(n, dtype=np.uint64)
    # Unsigned 32-bit products and sums wrap at 2 ** 32, as the definition asks.
    return ((i + 1) * np.uint64(2654435761)).astype(np.uint32), (i * np.uint64(1013904223)).astype(np.uint32)


def least_values(flat: np.ndarray, sizes: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """Signatures (one row of ``n`` minima each) of runs of 32-bit hashes; runs aren't empty."""
    starts = np.cumsum(sizes) - sizes
    return np.stack([np.minimum.reduceat(flat * t + p, starts) for t, p in zip(*_factors(n), strict=True)], axis=1)


def signatures(texts: DataFrame, n: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """(id, signature): for each i the least (s * (i + 1) * 2654435761 + i * 1013904223) mod 2 ** 32 over the text's shingle hashes s (CRC-32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = re.compile(r"\s+")
        for batch in batches:
            own = [shingle_hashes(blank.sub(" ", (t or "").lower()), k) for t in batch.column(1).to_pylist()]
            sizes, least = np.fromiter(map(len, own), np.int64, len(own)), []
            # Some texts at a time, so that their hashes stay in the processor's cache.
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 65536, prepend=-1)).tolist() + [len(own)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                least.append(least_values(np.concatenate(own[i:j]), sizes[i:j], n))
            flat = np.concatenate(least).astype(np.int64).ravel() if least else np.empty(0, np.int64)
            signed = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["id", "signature"])

    return spread(texts.select("id", "text")).mapInArrow(run, "id long, signature array<long>")


def estimate(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.array_size(a)


#: Nodes of a bucket that are compared at once; nodes of a bucket whose pairs (28 at most) are listed.
BLOCK, SMALL = 8192, 8


def _block_links(least: float):
    """Links between blocks i and j of a bucket, thinned to a spanning forest: at most one link per node."""

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, block = group.column("id").to_numpy(), group.column("block").to_numpy()
        sig = group.column("signature").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        seen_l, seen_r, out = np.zeros(len(left), bool), np.zeros(len(right), bool), []
        for start in range(len(left)):
            if seen_l[start]:
                continue
            seen_l[start], queue = True, [(True, start)]
            while queue:
                from_left, at = queue.pop()
                own, others, seen = (left[at], right, seen_r) if from_left else (right[at], left, seen_l)
                unseen = np.flatnonzero(~seen)
                share = np.zeros(len(others))
                for x in range(0, len(unseen), 1024):
                    some = unseen[x : x + 1024]
                    share[some] = (sig[others[some]] == sig[own]).mean(1)
                new = unseen[share[unseen] >= least]
                seen[new] = True
                out += [(int(ids[own]), int(ids[others[k]]), float(share[k])) for k in new if ids[own] != ids[others[k]]]
                queue += [(not from_left, int(k)) for k in new]
        a, b, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(s, pa.float64())})

    return run


def least_bands(bands: int, least: float) -> int:
    """How many bands similar signatures share at least, as each place that differs spoils one; 1 where that says nothing."""
    return max(1, bands - (PERMUTATIONS - math.ceil(least * PERMUTATIONS)))


def similar_pairs(signed: DataFrame, bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b, similarity) that join all texts that share a band and are similar enough.

    Rows with equal signatures are one node, to whose first row the others link.  Similar nodes share several bands (``least_bands``), so
    all but so many of a node's commonest ones are enough to meet in: buckets of texts that share little go, and no link.  Signatures travel only for buckets with
    several nodes; of a small bucket the few pairs are compared; a large bucket is cut into blocks whose pairs are spread over tasks, and every task reports a spanning
    forest instead of all pairs.
    """
    sig = F.md5(F.array_join("signature", ",").cast("binary"))
    nodes = cut(signed.groupBy(sig.alias("sig")).agg(F.min("id").alias("id"), F.any_value("signature").alias("signature")), "nodes")
    rows = PERMUTATIONS // bands
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * rows + 1, F.lit(rows))))
    banded = nodes.select("id", F.posexplode(keys).alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    order = W.partitionBy("id").orderBy(F.desc("n"), "band", "key")
    ranked = banded.join(shared, ["band", "key"]).withColumn("rank", F.row_number().over(order))
    # The rarest band that two similar nodes share is behind the others of them in either's order, so the first ones can be left out.
    rare = cut(ranked.where(F.col("rank") >= least_bands(bands, least)).select("id", "band", "key"), "bands")
    shared = rare.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    met = cut(rare.join(shared, ["band", "key"]), "buckets")
    # Small buckets: the few pairs, each once whatever the number of bands it shares.
    ids = met.where(F.col("n") <= SMALL).groupBy("band", "key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    two = F.flatten(F.transform("ids", lambda x: F.transform(F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = ids.select(F.explode(two).alias("p")).select("p.*").distinct()
    left, right = nodes.select(F.col("id").alias("a"), F.col("signature").alias("x")), nodes.select(F.col("id").alias("b"), F.col("signature").alias("y"))
    close = pairs.join(left, "a").join(right, "b").select("a", "b", estimate(F.col("x"), F.col("y")).alias("similarity")).where(F.col("similarity") >= least)
    # Large buckets: pairs of blocks.
    large = met.where(F.col("n") > SMALL).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    paired = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "key", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = close.unionByName(paired.join(nodes.select("id", "signature"), "id").groupBy("band", "key", "i", "j").applyInArrow(_block_links(least), "a long, b long, similarity double"))
    own = signed.select("id", sig.alias("sig")).join(nodes.select("sig", F.col("id").alias("first")), "sig").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return own.unionByName(found).distinct()


def clusters(links: DataFrame) -> DataFrame:
    """(node, cluster): the least node reachable over ``links`` (a, b)."""
    return components(links).select("node", F.col("component").alias("cluster"))


def deduplicate(rows: DataFrame, **options) -> DataFrame:
    """``rows`` (id, text, score) with their cluster and whether they are kept: the best score, then the first id."""
    signed = cut(signatures(rows, **options), "signatures")
    named = clusters(similar_pairs(signed)).select(F.col("node").alias("id"), "cluster")
    joined = rows.select("id", "score").join(named, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    best = joined.groupBy("cluster").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("best"))
    return joined.join(best, "cluster").select("id", "cluster", "score", (F.col("id") == F.col("best")).alias("kept"))


def curated(rows: DataFrame, gate: int = 80, include_c: bool = False) -> DataFrame:
    """A curation run over (id, text, total, eval_status): every row with its tier, whether it is kept for training (best of its
    near-duplicate cluster in tier A), is to be repaired (tier B, and C if wanted), or goes."""
    tiered = cut(tiers(rows), "tiers")
    best = tiered.where(F.col("tier") == "A").select("id", "text", F.col("total").alias("score"))
    kept = deduplicate(best).select("id", "kept")
    repaired = F.col("tier").isin("B", *(["C"] if include_c else []))
    decision = F.when(F.col("kept") & (F.col("total") >= gate), "train").when(F.col("kept"), "below_gate").when(F.col("kept").isNotNull(), "duplicate").when(repaired, "repair").otherwise("drop")
    return tiered.join(kept, "id", "left").select("id", "tier", "total", decision.alias("decision"))
