"""Deleted interpolation: bigram and unigram maximum-likelihood estimates and a uniform floor, mixed by weights that depend on
how often the context was seen, learned by expectation-maximisation on held-out counts.

    P(w | h) = l2[b] * c(h, w) / c(h)  +  l1[b] * c(w) / N  +  l0[b] / (V + 1),      b = 0 if c(h) = 0, else 1 + floor(log2 c(h))

The training documents are dealt in two: the weights are fitted to the bigrams of one part ("deleted") under the counts of
the other; the final counts are those of both.

Flow of the data, so that no row is made per token:

1. *blocks*: tasks read texts once and write blocks of some MB of text as word numbers (per block) with 64-bit word hashes;
2. *counts*: each block sends its distinct words and bigrams, sorted by hash and cut by hash range, to buckets; a bucket sums
   them over the corpus and answers every block with the sums of its own keys.  A frequent word is one key of a block
   whatever its count, so buckets are even;
3. *weights*: held-out blocks meet their answers, and sum (context class, likelihood ratios) cells, a bounded table;
4. *scores*: every block meets its answers and scores its documents.

Tokens: A-Z lower-cased, words of anything but ASCII white space, then one end, which is also the first word's context.
Null text counts as empty.  Without training rows every probability is that of one unknown word.  Rows with equal or null ids stay rows; extra columns
are ignored.  Long texts are scored whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, partitions, power_of_two, session

#: Bytes of text of a block; parts of the documents.
BLOCK_BYTES = 8 << 20
#: Keys that a bucket gets at most on average: the number of buckets grows with the corpus, their size doesn't.
BUCKET_KEYS = 3 << 20
COUNTED, DELETED, UNSEEN = 0, 1, 2
#: The key of the end; no word holds a blank.
END = b" "
CLASSES, STEPS = 40, 4
EM_ROUNDS = 60
#: Weights (bigram, unigram, uniform) where there is nothing to learn from.
START = (0.4, 0.5, 0.1)

BLOCKS = "block long, part int, ids array<long>, lengths binary, vocabulary binary, tokens binary"
KEYS = "level int, bucket int, block long, part int, keys binary, counts binary"
ANSWERS = "level int, bucket int, block long, part int, counted binary, deleted binary, n_counted long, n_deleted long, v_counted long, v_all long"


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the high bytes of sorted or small numbers are long runs, which shuffles compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(data: bytes, dtype) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, len(data) // kind.itemsize).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash
    from pyspark import TaskContext

    held: dict[int, list] = {}
    size = dict.fromkeys((COUNTED, DELETED, UNSEEN), 0)
    number = TaskContext.get().partitionId() << 24

    def close(part: int) -> pa.RecordBatch:
        nonlocal number
        numbers, ids, lengths, tokens = _Numbers(), [], [], []
        end = numbers[END]
        for doc_id, text in held.pop(part):
            words = text.lower().split()
            got = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            tokens += [got, np.array([end], np.int32)]
            ids.append(doc_id)
            lengths.append(len(words) + 1)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers], np.uint64)
        row = [[number], [part], [ids], [packed(np.array(lengths, np.int32))], [packed(hashes)], [packed(np.concatenate(tokens))]]
        number, size[part] = number + 1, 0
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    for batch in batches:
        for doc_id, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            body = (text or "").encode("utf-8", "surrogatepass")
            held.setdefault(part, []).append((doc_id, body))
            size[part] += len(body) + 64
            if size[part] >= BLOCK_BYTES:
                yield close(part)
    for part in list(held):
        yield close(part)


class Block:
    """A block's arrays; ``words`` and ``pairs`` are its keys in the order in which buckets get and answer them."""

    def __init__(self, row: dict):
        self.ids, self.part, self.block = row["ids"], row["part"], row["block"]
        self.lengths = unpacked(row["lengths"], np.int32).astype(np.int64)
        self.hashes = unpacked(row["vocabulary"], np.uint64)
        self.tokens = unpacked(row["tokens"], np.int32).astype(np.int64)

    @cached_property
    def before(self) -> np.ndarray:
        before = np.empty_like(self.tokens)
        before[1:], before[:1] = self.tokens[:-1], 0  # the end is number 0 and closes each document
        return before

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, their counts, and each vocabulary number's place among them."""
        order = np.argsort(self.hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return self.hashes[order], np.bincount(self.tokens, minlength=len(order))[order], place

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, their counts, and each token's place among them."""
        codes, inverse, counts = np.unique(self.before * len(self.hashes) + self.tokens, return_inverse=True, return_counts=True)
        first, second = np.divmod(codes, len(self.hashes))
        keys = mixed(self.hashes[first], self.hashes[second])
        order = np.argsort(keys, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return keys[order], counts[order], place[inverse.ravel()]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C159E3779B9))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _send(buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for level, (keys, counts, _) in ((1, block.words()), (2, block.pairs())):
                    at = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
                    there = np.unique(at)
                    cuts = np.searchsorted(at, there)
                    ends = np.r_[cuts[1:], len(keys)]
                    counts = counts.astype(np.uint32)
                    pieces = [(packed(keys[i:j]), packed(counts[i:j])) for i, j in zip(cuts, ends, strict=True)]
                    n = len(there)
                    cols = [pa.array([level] * n, pa.int32()), pa.array(there, pa.int32()), pa.array([block.block] * n, pa.int64()), pa.array([block.part] * n, pa.int32()), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in KEYS.split(", ")])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """One bucket: sums its keys over all blocks, and answers each block's keys in their order."""
    part = table.column("part").to_numpy()
    keys = [unpacked(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [unpacked(x, np.uint32) for x in table.column("counts").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weight, parts = np.concatenate(counts).astype(np.float64), np.repeat(part, sizes)
    # Sums over the corpus take 64 bits; the planes of their high bytes are zeros, which compress away.
    counted = np.bincount(inverse, weight * (parts == COUNTED), len(distinct)).astype(np.uint64)
    deleted = np.bincount(inverse, weight * (parts == DELETED), len(distinct)).astype(np.uint64)
    ends = np.cumsum(sizes)
    places = [inverse[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    totals = [int(counted.sum()), int(deleted.sum()), int((counted > 0).sum()), int((counted + deleted > 0).sum())]
    rest = [0] * (len(keys) - 1)
    cols = [table.column(c) for c in ("level", "bucket", "block", "part")]
    cols += [pa.array([packed(counted[p]) for p in places], pa.binary()), pa.array([packed(deleted[p]) for p in places], pa.binary())]
    cols += [pa.array([t, *rest], pa.int64()) for t in totals]
    return pa.table(cols, names=[f.split()[0] for f in ANSWERS.split(", ")])


def _answers(answers: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the words and of the pairs: the counts in both parts, in the block's order of keys."""
    out = []
    for level in (1, 2):
        rows = sorted((r for r in answers.select(["level", "bucket", "counted", "deleted"]).to_pylist() if r["level"] == level), key=lambda r: r["bucket"])
        out.append([np.concatenate([unpacked(r[c], np.uint64) for r in rows] or [np.empty(0, np.uint64)]).astype(np.float64) for c in ("counted", "deleted")])
    return out[0], out[1]


def classes(context: np.ndarray) -> np.ndarray:
    """Context class by frequency: 0 unseen, then one class per octave."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _ratios(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: float, v: float) -> tuple[np.ndarray, np.ndarray]:
    """Bigram and unigram estimates as multiples of the uniform floor."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0) * (v + 1), word / max(n, 1) * (v + 1)


def _cells(n: float, v: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"class": [], "q2": [], "q1": [], "n": [], "x2": [], "x1": []}
        for row in left.to_pylist():
            block = Block(row)
            words, pairs = _answers(right)
            word = words[0][block.words()[2]]
            pair, context = pairs[0][block.pairs()[2]], word[block.before]
            x2, x1 = _ratios(pair, context, word[block.tokens], n, v)
            level = lambda x: np.where(x > 0, np.floor(STEPS * np.log2(np.maximum(x, 1e-300))), -9999).astype(np.int64)
            keys, inverse = np.unique(np.stack([classes(context), level(x2), level(x1)]), axis=1, return_inverse=True)
            inverse = inverse.ravel()
            for name, value in zip(("class", "q2", "q1"), keys, strict=True):
                out[name].append(value)
            for name, weight in (("n", None), ("x2", x2), ("x1", x1)):
                out[name].append(np.bincount(inverse, weight, keys.shape[1]).astype(np.float64))
        return pa.table({k: np.concatenate(v) for k, v in out.items()})

    return run


def learn(rows: list) -> np.ndarray:
    """Weights (class x [bigram, unigram, uniform]) by expectation-maximisation over cells (class, n, x2 sum, x1 sum)."""
    weights = np.tile(np.array(START), (CLASSES, 1))
    weights[0] = (0, START[1] + START[0], START[2])
    if not rows:
        return weights
    of = np.array([r["class"] for r in rows])
    n, x2, x1 = (np.array([r[k] for r in rows], np.float64) for k in ("n", "x2", "x1"))
    likelihood = np.stack([x2 / n, x1 / n, np.ones(len(n))], axis=1)
    for _ in range(EM_ROUNDS):
        share = weights[of] * likelihood
        share *= (n / share.sum(1))[:, None]
        total = np.stack([np.bincount(of, share[:, i], CLASSES) for i in range(3)], axis=1)
        # One token of the start weights for each class keeps rare classes defined.
        total += np.where(np.arange(CLASSES)[:, None] == 0, [0, 0.8, 0.2], START)
        weights = total / total.sum(1, keepdims=True)
    return weights


SCORES = "doc_id long, part int, n_tokens long, n_known long, base_score double, score double"


def _scores(n: float, v: float, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in SCORES.split(", ")]
        for row in left.to_pylist():
            block = Block(row)
            words, pairs = _answers(right)
            word = (words[0] + words[1])[block.words()[2]]
            pair, context = (pairs[0] + pairs[1])[block.pairs()[2]], word[block.before]
            own = word[block.tokens]
            x2, x1 = _ratios(pair, context, own, n, v)
            mix = weights[np.minimum(classes(context), CLASSES - 1)]
            score = np.log10((mix[:, 0] * x2 + mix[:, 1] * x1 + mix[:, 2]) / (v + 1))
            base = np.log10((own + 0.1) / (n + 0.1 * (v + 1)))
            starts = np.cumsum(block.lengths) - block.lengths
            sums = [np.add.reduceat(x, starts) for x in ((own > 0).astype(np.int64), base, score)]
            for c, x in zip(cols, (block.ids, [block.part] * len(block.ids), block.lengths, *sums), strict=True):
                c.extend(x if isinstance(x, list) else x.tolist())
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, held_out: int = 0, deleted: int = 1) -> DataFrame:
    """Scores all rows of ``docs``; learns from those whose fold isn't ``held_out``, the weights from the fold ``deleted``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = session(docs.sparkSession)
    own = fold(F.col(id_col), modulus)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.when(own == held_out, UNSEEN).when(own == deleted, DELETED).otherwise(COUNTED).alias("part"), F.col(text_col).cast("string").alias("text"))
    blocks = materialize(kept.mapInArrow(word_blocks, BLOCKS), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)).alias("n"), F.count("*").alias("blocks")).first()
    tokens, tasks = size.n // 4, max(partitions(spark), size.blocks)
    buckets = power_of_two(max(4 * partitions(spark), -(-tokens // BUCKET_KEYS)))
    sent = blocks.mapInArrow(_send(buckets), KEYS)
    # Tasks of a few buckets or about one block each, so that no task's input grows with the corpus.
    dealt = sent.repartition(max(partitions(spark), buckets // 2), "level", "bucket")
    answers = materialize(dealt.groupBy("level", "bucket").applyInArrow(_sum, ANSWERS), "lm-counts")
    totals = answers.where("level = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_counted", "n_deleted", "v_counted", "v_all"))).first()

    def meet(part: bool, run, schema: str) -> DataFrame:
        left, right = (x.where(F.col("part") == DELETED) if part else x for x in (blocks, answers.select("block", "part", "level", "bucket", "counted", "deleted")))
        left, right = (x.repartition(tasks, "block").groupBy("block") for x in (left, right))
        return left.cogroup(right).applyInArrow(run, schema)

    cells = meet(True, _cells(totals.n_counted, totals.v_counted), "class long, q2 long, q1 long, n double, x2 double, x1 double")
    rows = cells.groupBy("class", "q2", "q1").agg(*(F.sum(c).alias(c) for c in ("n", "x2", "x1"))).orderBy("class", "q2", "q1").collect()
    n = totals.n_counted + totals.n_deleted
    scores = meet(False, _scores(n, totals.v_all, learn(rows)), SCORES)
    return scores.select("doc_id", (F.col("part") == UNSEEN).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
