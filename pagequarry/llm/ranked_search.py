"""Ranked lexical search by pipelined term partitioning.

The index is partitioned twice: by blocks of documents, and by term owners.  An owner holds the postings of the terms whose share of
documents lies in its range (``OWNERS``), rarest first.  A bundle holds some items and, for one block of documents, the sparse
accumulators of these items; it visits the owners one after the other, by a cogroup with the owner's postings of that block, and each
adds its integer contributions.  Before an owner passes a bundle on it drops accumulators that can't reach the item's ``TOP`` best any
more: those whose score and all that later owners could add at most stay below the 20th best score so far, which only grows.  The last
owner selects each block's best, then the best of all blocks are chosen.

    score(item, document) = sum over the item's terms of w * ((10^9 * tf) div (1000 * tf + 12 * m)),   w = floor(1000 * ln((2N + 2) / (2 df + 1)))

Documents are read once.  Which terms are indexed is told by a bitmap of the items' term hashes, at most 2 ** ``BITMAP_BITS``
bits whatever the number of items; terms are equal where their 64-bit hashes are.  No task holds more than a block's postings and a
bundle's accumulators.

Null texts have no terms; items without terms, or whose terms are nowhere, get no rows.  Items and documents are rows: repeated or null
ids are ranked like others, a null doc_id after all others of its score.  Very long texts are indexed whole.  Extra columns are
ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, materialize, numbered, partitions, session, text_bytes
from .interpolation import packed, unpacked

TOP = 20
#: Least shares of documents of the second, third and fourth owner's terms.
OWNERS = (1 / 256, 1 / 32, 1 / 4)
#: A block's bytes of text and documents; a bundle's items; word hashes that a worker keeps; bits of a bitmap's positions.
BLOCK_BYTES, BLOCK_DOCS, BUNDLE, WORDS_KEPT, BITMAP_BITS = 4 << 20, 8192, 256, 500_000, (16, 26)
#: Positions per piece of the bitmap.
PIECE = 16

INDEX = "block long, term long, df long, most long, docs binary, tfs binary, ids array<long>, lengths binary, documents long, terms long"
STATE = "bundle int, block long, lengths binary, cuts array<int>, docs binary, scores binary, best array<struct<item: long, score: long>>"

#: Terms are runs of letters and digits of ASCII and of all other characters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TermHashes(dict):
    """Hashes of terms as signed 64-bit numbers, never zero; with a bitmap, zero for terms that it doesn't hold."""

    def __init__(self, bitmap: np.ndarray | None = None, bits: int = 0):
        self.bitmap, self.shift = bitmap, 64 - bits

    def __missing__(self, term: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(term) or 1
        at = value >> self.shift
        known = self.bitmap is None or self.bitmap[at >> 3] >> (at & 7) & 1
        self[term] = value = (value - (1 << 64) if value >> 63 else value) if known else 0
        return value


def item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(item, term, times) of numbered items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            own = [np.unique(np.array([hashes[t] for t in terms_of(x)], np.int64), return_counts=True) for x in text_bytes(batch.column(1).to_pylist())]
            sizes = [len(t) for t, _ in own]
            flat = [np.concatenate([o[k] for o in own] or [np.empty(0, np.int64)]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array(flat[0]), pa.array(flat[1], pa.int64())], names=["item", "term", "times"])

    return items.select(F.col(ROW).alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item long, term long, times long")


def _piece(bits: int):
    """One piece of the bitmap."""

    def run(table: pa.Table) -> pa.Table:
        wanted = np.zeros(1 << min(PIECE, bits), np.uint8)
        wanted[table.column("at").to_numpy() & (len(wanted) - 1)] = 1
        return pa.table({"piece": table.column("piece")[:1], "bitmap": [np.packbits(wanted, bitorder="little").tobytes()]})

    return run


def bitmap_of(terms: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the leading ``bits`` bits of terms' hashes; only its non-empty pieces reach the driver."""
    at = F.shiftrightunsigned("term", 64 - bits).alias("at")
    pieces = terms.select(at).distinct().withColumn("piece", F.shiftright("at", PIECE)).groupBy("piece").applyInArrow(_piece(bits), "piece long, bitmap binary").collect()
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in pieces:
        found = np.frombuffer(r.bitmap, np.uint8)
        out[r.piece * len(found) : (r.piece + 1) * len(found)] = found
    return out


def _index(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = TermHashes(shared.value, bits)
        number, size = TaskContext.get().partitionId() << 24, 0
        ids: list = []
        lengths: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            terms, tfs = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            docs = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            order = np.argsort(terms, kind="stable")
            terms, tfs, docs = terms[order], tfs[order].astype(np.int32), docs[order].astype(np.int32)
            begin = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.empty(0, np.int64)
            end = np.r_[begin[1:], len(terms)].astype(np.int64) if len(begin) else begin
            k, n = len(begin), np.array(lengths, np.int32)
            most = np.maximum.reduceat(tfs, begin) if k else np.empty(0, np.int32)
            spans = list(zip(begin.tolist(), end.tolist(), strict=True))
            # The last row holds the block's documents.
            cols = [
                pa.array([number] * (k + 1), pa.int64()), pa.array([*terms[begin].tolist(), None], pa.int64()), pa.array([*(end - begin).tolist(), None], pa.int64()), pa.array([*most.tolist(), None], pa.int64()),
                pa.array([*(packed(docs[i:j]) for i, j in spans), None], pa.binary()), pa.array([*(packed(tfs[i:j]) for i, j in spans), None], pa.binary()), pa.array([*[None] * k, ids], pa.list_(pa.int64())),
                pa.array([*[None] * k, packed(n)], pa.binary()), pa.array([*[None] * k, int((n > 0).sum())], pa.int64()), pa.array([*[None] * k, int(n.sum(dtype=np.int64))], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1).to_pylist()), strict=True):
                terms = terms_of(text)
                own = np.fromiter(map(hashes.__getitem__, terms), np.int64, len(terms))
                held.append(np.unique(own[own != 0], return_counts=True))
                ids.append(doc_id)
                lengths.append(len(terms))
                size += len(text) + 64
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield close()
                    number, size, ids, lengths, held = number + 1, 0, [], [], []
        if ids:
            yield close()

    return run


def _middle(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document, from its number of terms."""
    if 25 * int(n.max(initial=0)) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // terms for x in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * documents // max(terms, 1)


def _visit(stage: int, documents: int, terms: int, top: int):
    """A bundle's visit to an owner: adds its contributions, drops what can't be among the best."""

    def run(left: pa.Table, right: pa.Table) -> tuple[dict, np.ndarray]:
        row = left.to_pylist()[0]
        n = unpacked(row["lengths"], np.int32)
        m = _middle(n, documents, terms)
        place = {x["item"]: i for i, x in enumerate(row["items"])}
        sums = np.zeros((len(place), len(n)), np.int64)
        docs, scores = unpacked(row["docs"], np.int32), unpacked(row["scores"], np.int64)
        for i, (a, b) in enumerate(zip(row["cuts"], row["cuts"][1:], strict=False)):
            sums[i, docs[a:b]] = scores[a:b]
        for p in right.select(["docs", "tfs", "w", "asked"]).to_pylist():
            docs, tf = unpacked(p["docs"], np.int32), unpacked(p["tfs"], np.int32).astype(np.int64)
            added = p["w"] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
            for x in p["asked"]:
                sums[place[x["item"]], docs] += x["times"] * added
        rest = np.array([x["after"][stage] for x in row["items"]], np.int64)
        floor = np.array([x["floor"] for x in row["items"]], np.int64)
        if sums.shape[1] >= top:
            floor = np.maximum(floor, np.partition(sums, sums.shape[1] - top, axis=1)[:, sums.shape[1] - top])
        sums[sums + rest[:, None] < floor[:, None]] = 0
        return row, sums

    return run


def _pass_on(stage: int, documents: int, terms: int, top: int):
    visit = _visit(stage, documents, terms, top)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, sums = visit(left, right)
        docs, cuts, best = [], [0], []
        for item, own in zip(row["items"], sums, strict=True):
            at = np.flatnonzero(own)
            docs.append(at.astype(np.int32))
            cuts.append(cuts[-1] + len(at))
            scores = own[at]
            best += [{"item": item["item"], "score": int(x)} for x in (np.partition(scores, len(at) - top)[len(at) - top :] if len(at) > top else scores)]
        flat = np.concatenate([own[at] for own, at in zip(sums, docs, strict=True)])
        out = {"bundle": row["bundle"], "block": row["block"], "lengths": row["lengths"], "cuts": cuts, "docs": packed(np.concatenate(docs)), "scores": packed(flat), "best": best}
        kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.struct([("item", pa.int64()), ("score", pa.int64())]))]
        return pa.table([pa.array([v], k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _select(stage: int, documents: int, terms: int, top: int):
    visit = _visit(stage, documents, terms, top)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, sums = visit(left, right)
        ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        unnamed = np.array([x is None for x in row["ids"]], bool)
        items, found, scores = [], [], []
        for item, own in zip(row["items"], sums, strict=True):
            at = np.flatnonzero(own)
            at = at[np.lexsort((ids[at], unnamed[at], -own[at]))][:top]
            items += [item["item"]] * len(at)
            found += [row["ids"][k] for k in at]
            scores += own[at].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in (items, found, scores)], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, ranked by score, then by id."""
    spark = session(docs.sparkSession)
    numbers = numbered(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "items")
    asked = materialize(item_terms(numbers, "text"), "item-terms")
    sizes = asked.agg(F.approx_count_distinct("term").alias("terms"), F.count_distinct("item").alias("items")).first()
    bits = min(max(BITMAP_BITS[0], (64 * sizes.terms).bit_length()), BITMAP_BITS[1])
    shared = spark.sparkContext.broadcast(bitmap_of(asked, bits))
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    index = materialize(kept.mapInArrow(_index(shared, bits), INDEX), "index")
    blocks = index.where("term is null").select("block", "ids", "lengths", "documents", "terms")
    size = blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    postings = index.where("term is not null").select("block", "term", "df", "most", "docs", "tfs")
    # Weights and owners of the items' terms, and what an owner can add to an item at most.
    n = F.lit(float(size.documents))
    df, most = F.sum("df").alias("df"), F.max("most").alias("most")
    share = F.col("df") / F.greatest(n, F.lit(1.0))
    owner = sum(((share >= x).cast("int") for x in OWNERS), F.lit(0))
    weight = F.floor(F.log((2 * n + 2) / (2 * F.col("df") + 1)) * 1000)
    limit = F.floor(F.lit(1_000_000_000) * F.col("most") / (1000 * F.col("most") + 900)) + 1
    known = postings.groupBy("term").agg(df, most).select("term", weight.alias("w"), owner.alias("owner"), limit.alias("limit"))
    bundles = max(1, -(-sizes["items"] // BUNDLE))
    routed = asked.join(known, "term").withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int"))
    routed = materialize(routed, "routes")
    routes = routed.groupBy("bundle", "term", "w", "owner").agg(F.collect_list(F.struct("item", "times")).alias("asked"))
    stages = len(OWNERS) + 1
    after = F.array(*(F.coalesce(F.sum(F.when(F.col("owner") > s, F.col("times") * F.col("w") * F.col("limit"))), F.lit(0)) for s in range(stages)))
    potential = materialize(routed.groupBy("bundle", "item").agg(after.alias("after")), "potentials")
    nothing = F.lit(b"")
    empty = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "block", "lengths", F.array().cast("array<int>").alias("cuts"), nothing.alias("docs"), nothing.alias("scores"))
    state, floors = empty, None
    for stage in range(stages):
        own = potential.withColumn("floor", F.lit(0).cast("long")) if floors is None else potential.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
        info = own.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("item", "after", "floor"))).alias("items"))
        visiting = state.join(info, "bundle")
        here = postings.select("block", "term", "docs", "tfs").join(routes.where(F.col("owner") == stage), "term").select("bundle", "block", "docs", "tfs", "w", "asked")
        here = here.toDF(*here.columns)  # blocks and postings are of one table
        if stage == stages - 1:
            visiting = visiting.join(blocks.select("block", "ids"), "block")
        tasks = 2 * partitions(spark)
        left, right = (x.repartition(tasks, "bundle", "block").groupBy("bundle", "block") for x in (visiting, here))
        if stage == stages - 1:
            best = left.cogroup(right).applyInArrow(_select(stage, size.documents, size.terms, top), "item long, doc_id long, score long")
            break
        state = materialize(left.cogroup(right).applyInArrow(_pass_on(stage, size.documents, size.terms, top), STATE), f"bundles-{stage}")
        scores = state.select(F.explode("best").alias("x")).select("x.item", "x.score")
        nth = Window.partitionBy("item").orderBy(F.desc("score"))
        reached = scores.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= top)
        floors = materialize(reached.groupBy("item").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= top).select("item", "floor"), "floors")
        state = state.drop("best")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(numbers.select(F.col(ROW).alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
