"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is a short set of word shingles, a document may be a thousand times longer, so MinHash similarity of the two says
nothing.  Items are therefore partitioned by size (one class per octave), and for each class the documents are
searched in windows of at most four times the class's smallest size: half-overlapping, so that a run of as many shingles as the
largest item of the class always lies in one window.  Within a window an item's similarity is at least

    t / (4 + (1 - t)) > 1/6    for containment t = 0.8,

and ``HASHES`` bands of one row each miss it with a probability below 1e-5 (for verbatim passages below 1e-8).  The windows of a class
are unions of those of the class below, so all classes share one pass over the shingles.  An item of fewer words than a shingle is
a class of its own length: one shingle of all its words.  Every candidate is verified by exact containment: the share of the
item's distinct shingles (as text) in the whole document.

The documents are scanned once, whatever the benchmark's size.  A benchmark of ``BLOCK_BYTES`` at most is broadcast with its
signatures; of a larger one only a bitmap of bounded size is, and the signatures that it lets through are joined with those of the
items by equality; candidates then meet the texts by joins on their digests.

Texts are lower-cased (A-Z) and cut at ASCII white space.  Null texts and texts without words match nothing.  Repeated rows give
repeated results; null ids are carried; extra columns are ignored.  No documents or no items: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, numbered, session, text_bytes, without_ids

SHINGLE, CONTAINMENT = 5, 0.8
HASHES = 64
#: Bytes of item text that are broadcast at most; word hashes that a worker keeps.
BLOCK_BYTES, WORDS_KEPT = 1 << 20, 500_000
#: Bits of a position in the bitmap, at least and at most; rows that are broadcast at most in the join.
BITMAP_BITS, BROADCAST_ROWS = (16, 26), 250_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

PAIRS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers, one per hash function."""
    x = np.arange(1, n + 1, dtype=np.uint64) * GOLDEN
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> frozenset[bytes]:
    return frozenset(b" ".join(s) for s in zip(*(words[i:] for i in range(size)), strict=False))


def shingle_hashes(docs: list[list[bytes]], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all documents in order, and how many each document has."""
    sizes = np.array([len(w) for w in docs], np.int64)
    flat = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.int64, len(w)) for w in docs] or [np.empty(0, np.int64)])
    return _runs(flat.view(np.uint64), sizes, size)


def _runs(flat: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    total = len(flat)
    if total < size:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    mixed = np.zeros(total - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * GOLDEN + flat[i : total - size + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    n = np.maximum(sizes - size + 1, 0)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(total + 1, np.int64)
    np.add.at(inside, starts[n > 0], 1)
    np.add.at(inside, (starts + n)[n > 0], -1)
    return mixed[np.cumsum(inside)[: len(mixed)] > 0], n


def signature(flat: np.ndarray, factor: np.uint64) -> np.ndarray:
    return ((flat * factor) >> np.uint64(32)).astype(np.uint32)


def _key(place: int, minima: np.ndarray) -> np.ndarray:
    """The key of minima of a place: class x ``HASHES`` + hash number; short items have places of their own above those."""
    return np.uint64(place) << np.uint64(32) | minima.astype(np.uint64)


def _salt(place: int) -> np.uint32:
    return np.uint32((place * 0x9E3779B1) & 0xFFFFFFFF)


def short_place(size: int) -> int:
    return 64 * HASHES + size


def _position(place: int, minima: np.ndarray, bits: int) -> np.ndarray:
    return (minima ^ _salt(place)) >> np.uint32(32 - bits)


def item_keys(words: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(keys, item numbers) of the signatures of items with words, and the classes or short sizes (negative) that occur."""
    keys, members, kinds = [], [], {}
    for i, w in enumerate(words):
        kinds.setdefault(-len(w) if len(w) < SHINGLE else len(shingle_set(w)).bit_length() - 1, []).append(i)
    factors = multipliers(HASHES)
    for kind, own in sorted(kinds.items()):
        flat, n = shingle_hashes([words[i] for i in own], hashes, min(SHINGLE, -kind) if kind < 0 else SHINGLE)
        if kind < 0:
            keys.append(_key(short_place(-kind), signature(flat, factors[0])))
            members.append(np.array(own))
            continue
        starts = np.cumsum(n) - n
        for h, factor in enumerate(factors):
            keys.append(_key(kind * HASHES + h, np.minimum.reduceat(signature(flat, factor), starts)))
            members.append(np.array(own))
    empty = np.empty(0, np.uint64), np.empty(0, np.int64)
    return (*((np.concatenate(keys), np.concatenate(members)) if keys else empty), sorted(kinds))


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap's positions of keys."""
    places = (keys >> np.uint64(32)).astype(np.uint64)
    salts = ((places * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return ((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ salts) >> np.uint32(32 - bits)


def document_keys(docs: list[list[bytes]], hashes: WordHashes, kinds: list[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document numbers, keys) of all windows' signatures that ``bitmap`` lets through."""
    bits = len(bitmap).bit_length() - 1
    sizes = np.array([len(w) for w in docs], np.int64)
    words = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.int64, len(w)) for w in docs] or [np.empty(0, np.int64)]).view(np.uint64)
    factors = multipliers(HASHES)
    for size in (-k for k in kinds if k < 0):
        flat, n = _runs(words, sizes, size)
        minima, place = signature(flat, factors[0]), short_place(size)
        at = np.flatnonzero(bitmap[_position(place, minima, bits)])
        yield np.repeat(np.arange(len(docs)), n)[at], _key(place, minima[at])
    classes = {k for k in kinds if k >= 0}
    flat, n = _runs(words, sizes, SHINGLE)
    there = np.flatnonzero(n > 0)
    if not len(there) or not classes:
        return
    n, low, high = n[there], min(classes), max(classes)
    half = 1 << (low + 1)
    count = -(-n // half)
    begin = np.cumsum(n) - n
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    levels = [(np.repeat(begin, count) + inner * half, count)]
    for _ in range(low, high):
        before = levels[-1][1]
        count = -(-before // 2)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        levels.append((np.repeat(np.cumsum(before) - before, count) + 2 * inner, count))
    owners = [np.repeat(there, c) for _, c in levels]
    for h, factor in enumerate(factors):
        minima = signature(flat, factor)
        for k, ((cuts, _), owner) in enumerate(zip(levels, owners, strict=True), low):
            minima = np.minimum.reduceat(minima, cuts)
            if k not in classes:
                continue
            windows = minima.copy()
            same = owner[1:] == owner[:-1]
            windows[:-1][same] = np.minimum(minima[:-1], minima[1:])[same]
            place = k * HASHES + h
            at = np.flatnonzero(bitmap[_position(place, windows, bits)])
            if len(at):
                yield owner[at], _key(place, windows[at])


def verified(words: list[bytes], items: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(item number, n_shared, n_item) of the items that a document contains."""
    own: dict[int, frozenset[bytes]] = {}
    for i, item in items:
        size = min(SHINGLE, len(item))
        if size not in own:
            own[size] = shingle_set(words, size)
        theirs = shingle_set(item, size)
        both = len(theirs & own[size])
        if both >= CONTAINMENT * len(theirs):
            yield i, both, len(theirs)


def _bits(n: int) -> int:
    return min(BITMAP_BITS[1], max(BITMAP_BITS[0], (16 * n).bit_length()))


class Items:
    """A broadcast benchmark: ids, words, sorted signature keys with their items, and the bitmap of the keys."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        words = [words_of(t) for t in text_bytes([r[1] for r in rows])]
        kept = [i for i, w in enumerate(words) if w]
        self.ids, self.words = [rows[i][0] for i in kept], [words[i] for i in kept]
        keys, members, self.kinds = item_keys(self.words, WordHashes())
        order = np.argsort(keys, kind="stable")
        self.keys, self.members = keys[order], members[order]
        self.bitmap = np.zeros(1 << _bits(len(keys)), bool)
        self.bitmap[positions(keys, _bits(len(keys)))] = True

    def candidates(self, docs: list[list[bytes]], hashes: WordHashes) -> dict[int, set[int]]:
        """The items of each document whose signatures meet in some window."""
        found: dict[int, set[int]] = {}
        for owner, wanted in document_keys(docs, hashes, self.kinds, self.bitmap):
            first, last = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
            for d, a, b in zip(owner[last > first].tolist(), first[last > first], last[last > first], strict=True):
                found.setdefault(d, set()).update(self.members[a:b].tolist())
        return found


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in PAIRS.split(", ")])


def _broadcast_search(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hashes = shared.value, WordHashes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words = [words_of(t) for t in text_bytes(batch.column(1).to_pylist())]
            rows = []
            for d, some in sorted(items.candidates(words, hashes).items()):
                for i, both, size in verified(words[d], [(i, items.words[i]) for i in sorted(some)]):
                    rows.append((ids[d], items.ids[i], both, size, both / size))
            yield _pairs(rows)

    return docs.mapInArrow(run, PAIRS)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _item_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, item) of item texts (digest, text)."""
    hashes = WordHashes()
    for batch in batches:
        words = [words_of(t) for t in text_bytes(batch.column(1).to_pylist())]
        kept = [i for i, w in enumerate(words) if w]
        keys, members, kinds = item_keys([words[i] for i in kept], hashes)
        digests = batch.column(0).take(pa.array([kept[m] for m in members.tolist()], pa.int64()))
        place = (keys >> np.uint64(32)).astype(np.int64)
        kind = np.where(place > 64 * HASHES, 64 * HASHES - place, place // HASHES)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind), digests], names=["key", "kind", "item"])


def _bitmap(signatures: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bitmap of all keys, put together from the tasks' parts; its size has a constant bound."""
    bits = _bits(signatures.count())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for batch in batches:
            own[positions(batch.column(0).to_numpy().view(np.uint64), bits)] = True
        packed = np.packbits(own).reshape(-1, 1 << (bits - 3 - 6))
        some = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

    def join(table: pa.Table) -> pa.Table:
        rows = np.stack([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    parts = signatures.select("key").mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(join, "part long, bits binary").collect()
    whole = np.zeros((64, 1 << (bits - 3 - 6)), np.uint8)
    for r in parts:
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(whole.ravel()).astype(bool), sorted(r.kind for r in signatures.select("kind").distinct().collect())


def _joined_search(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The search by joins: signatures by key, then candidates with both texts by digest."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    items = materialize(asked.where("text is not null").select("item_id", digest.alias("item"), "text"), "benchmark-items")
    texts = items.groupBy("item").agg(F.first("text").alias("text"))
    signatures = materialize(texts.mapInArrow(_item_signatures, "key long, kind long, item string"), "benchmark-signatures")
    bitmap, kinds = _bitmap(signatures)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            words = [words_of(t) for t in text_bytes(batch.column(1).to_pylist())]
            for owner, keys in document_keys(words, hashes, kinds, shared.value):
                once = np.unique(np.stack([owner.astype(np.uint64), keys]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(once[0].astype(np.int64))), pa.array(once[1].view(np.int64))], names=["doc", "key"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, text, short in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc, item, both, size) for _, both, size in verified(words_of(text.encode()), [(0, words_of(short.encode()))])]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "item", "n_shared", "n_item"])

    named = docs.where("text is not null").withColumn("doc", digest)
    met = named.select("doc", "text").mapInArrow(search, "doc string, key long").join(_small(signatures.select("key", "item")), "key")
    pairs = materialize(met.select("doc", "item").distinct(), "benchmark-candidates")
    wanted = _small(materialize(pairs.select("doc").distinct(), "benchmark-documents"))
    found = named.select("doc", "text").join(wanted, "doc", "left_semi").dropDuplicates(["doc"])
    both = pairs.join(found, "doc").join(texts.withColumnRenamed("text", "short"), "item").select("doc", "item", "text", "short")
    leaks = materialize(both.mapInArrow(verify, "doc string, item string, n_shared long, n_item long"), "benchmark-leaks")
    out = named.select("id", "doc").join(_small(leaks), "doc").join(_small(items.select("item", "item_id")), "item")
    return out.select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document that contains at least ``CONTAINMENT`` of an item."""
    session(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first().n
    if total > BLOCK_BYTES:
        return _joined_search(kept, asked)
    rows = asked.where("text is not null").orderBy("item_id", "text").collect()
    return _broadcast_search(kept, Items([(r.item_id, r.text) for r in rows]))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item of the benchmark; each row by its own text, whatever its id."""
    row = free_name(docs)
    rows = numbered(docs, name=row)
    leaks = materialize(find_leaks(rows, benchmark, id_col=row).select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return without_ids(rows, leaks, id_col=row).drop(row)
