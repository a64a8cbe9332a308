"""Spelling variants by permuterm rotations.

A word is marked by a terminator and rotated to every place.  A rotation whose last letter is skipped is a prefix that all words share
which differ in that letter only, and it is, letter by letter, a whole rotation of the word that lacks the letter.  So all rotations are
written as (prefix, skipped letter), whole rotations with nothing skipped, sorted, and scanned: a run of equal prefixes holds a word's
replacements at one place, and in front of them the word without that place.  A run has at most one row per letter of the alphabet and
one more, whatever the corpus.  The scan emits each word's number of neighbours and its best neighbour, never the pairs of a run.

A deleted letter of a repeated letter ("boook") gives the same pair at each place of the repetition; it counts at the first.

Rotations of a word take the square of its length, so words of over ``LONG`` letters are told apart by hashes of their rotations, of which
equal ones are verified on the words.  Words are counted per task before they are shuffled.

Null texts have no words; a null doc_id counts as the empty string in the digest.  Repeated rows count as often as they are there.  Among
neighbours of equal counts the first in code-point order is the form.  Very long texts and words are processed whole.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, session

LEAST_LENGTH, LEAST_COUNT, CORRUPTED, TERMINATOR = 5, 3, 97, "$"
#: Letters of a word whose rotations are written as text; words that a task counts before it passes them on.
LONG, WORDS_KEPT = 64, 500_000
MAX_ROUNDS = 12

#: In Latin-1, letters of ASCII in lower case and all of U+00C0 to U+00FF; blanks for the rest.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0xC0 or 97 <= b <= 122 else 32 for b in range(256))


class _Words(dict):
    """Numbers of words, with the CRC-32 and the length in bytes of their UTF-8."""

    def __init__(self):
        self.words: list[bytes] = []
        self.crc: list[int] = []
        self.size: list[int] = []

    def __missing__(self, word: bytes) -> int:
        body = word if word.isascii() else word.decode("latin-1").encode()
        self[word] = n = len(self.words)
        self.words.append(word)
        self.crc.append(zlib.crc32(body))
        self.size.append(len(body))
        return n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the occurrences in (id, text), with the digest's deletions; a word comes up again at most once per ``WORDS_KEPT``."""
    words, total = _Words(), np.zeros(0, np.int64)
    shortened: Counter = Counter()
    zeros: dict[int, int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        kept = np.flatnonzero(total)
        names = [words.words[i].decode("latin-1") for i in kept.tolist()]
        for a, b in ((names, total[kept].tolist()), (list(shortened), list(shortened.values()))):
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Characters above U+00FF, and U+0080 to U+00BF, are no letters here.
            found = (text or "").encode("latin-1", "replace").translate(FOLD).split()
            own, counts = np.unique(np.fromiter(map(words.__getitem__, found), np.int64, len(found)), return_counts=True)
            if len(total) < len(words.words):
                total = np.r_[total, np.zeros(max(len(words.words) - len(total), len(total)), np.int64)]
            total[own] += counts
            # CRC-32 of id and word from that of the word: what stands before it is carried over as many zeros as the word has bytes.
            before = zlib.crc32(b":" if doc_id is None else b"%s:" % str(doc_id).encode())
            crc, size = np.array([words.crc[i] for i in own.tolist()], np.int64), np.array([words.size[i] for i in own.tolist()], np.int64)
            for length in np.unique(size).tolist():
                if length not in zeros:
                    zeros[length] = zlib.crc32(bytes(length))
                at = np.flatnonzero(size == length)
                digest = crc[at] ^ (zlib.crc32(bytes(length), before) ^ zeros[length])
                for k in at[digest % CORRUPTED == 0].tolist():
                    word, h = words.words[own[k]].decode("latin-1"), int(crc[k]) ^ zlib.crc32(bytes(length), before) ^ zeros[length]
                    total[own[k]] -= counts[k]
                    place = h % len(word)
                    shortened[word[:place] + word[place + 1 :]] += int(counts[k])
            if len(words.words) + len(shortened) >= WORDS_KEPT:
                yield from flush()
                words, total, shortened = _Words(), np.zeros(0, np.int64), Counter()
    yield from flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    kept = session(docs.sparkSession) and docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    words = kept.mapInArrow(counted, "word string, n long").where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skipped, n): all rotations of the marked words with their last letter skipped, and whole (skipped is empty)."""
    word, size = F.col("word"), F.length("word")
    after = lambda i: F.concat(F.substr(word, i + 1), F.lit(TERMINATOR))
    skipping = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(after(i), F.substr(word, F.lit(1), i - 1)).alias("prefix"), F.substr(word, i, F.lit(1)).alias("skipped")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.concat(after(i), F.substr(word, F.lit(1), i)).alias("prefix"), F.lit("").alias("skipped")))
    return words.select(F.explode(F.concat(skipping, whole)).alias("r"), "n").select("r.prefix", "r.skipped", "n")


NEAR = "word string, n_near long, form_n long, form string"


def _best(rows: list[tuple[str, int]]) -> tuple[str, int] | None:
    return min(rows, key=lambda r: (-r[1], r[0]), default=None)


def _run(prefix: str, skipped: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """What one run of equal prefixes says of its words: neighbours there, and the best of them."""
    behind, front = prefix.split(TERMINATOR)
    whole = [(front + behind, n) for c, n in zip(skipped, counts, strict=True) if not c]
    # A repeated letter's first place counts for the word that lacks it.
    rows = [(front + c + behind, n, not front.endswith(c)) for c, n in zip(skipped, counts, strict=True) if c]
    two = sorted(((w, n) for w, n, _ in rows), key=lambda r: (-r[1], r[0]))[:2]
    for word, n, first in rows:
        others = [r for r in two if r[0] != word] + (whole if first else [])
        best = _best(others)
        if best:
            yield word, len(rows) - 1 + (len(whole) if first else 0), best[1], best[0]
    for word, _ in whole:
        longer = [(w, n) for w, n, first in rows if first]
        best = _best(longer)
        if best:
            yield word, len(longer), best[1], best[0]


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted (prefix, skipped, n): rows of ``NEAR``, one for each word and run with neighbours."""
    held: pa.Table | None = None

    def emit(table: pa.Table) -> pa.RecordBatch:
        prefix = table.column("prefix").combine_chunks()
        same = pc.equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False) if len(prefix) > 1 else np.empty(0, bool)
        begin = np.flatnonzero(np.r_[True, ~same])
        end = np.r_[begin[1:], len(prefix)]
        wide = np.flatnonzero(end - begin > 1)
        kept = table.take(pa.array(np.flatnonzero(np.repeat(end - begin > 1, end - begin)), pa.int64()))
        names, skipped, counts = (kept.column(c).to_pylist() for c in ("prefix", "skipped", "n"))
        rows, at = [], 0
        for size in (end - begin)[wide].tolist():
            rows += _run(names[at], skipped[at : at + size], counts[at : at + size])
            at += size
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "form_n", "form"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        prefix = now.column("prefix").combine_chunks()
        last = prefix[-1]
        cut = len(prefix) - int(pc.sum(pc.equal(prefix, last)).as_py())
        held = now.slice(cut).combine_chunks()
        if cut:
            yield emit(now.slice(0, cut))
    if held is not None:
        yield emit(held)


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, number, skips) of long words' rotations, in linear time: hashes of the parts before and behind each place."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for number, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n = len(x)
            powers = np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)
            before = np.r_[np.uint64(0), np.cumsum(x * powers[:n], dtype=np.uint64)]
            places = np.arange(n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            # A letter left out: what is behind moves down by one place.
            lacking = before[:n] * base + (before[n] - before[1:])
            whole = np.full(n + 1, (before[n:] * base)[0], np.uint64)
            for hashes, size, skips in ((lacking ^ places[:n], n - 1, True), (whole ^ places, n, False)):
                mixed = (hashes ^ np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array([number] * len(mixed), pa.int64()), pa.array([skips] * len(mixed))], names=["hash", "number", "skips"])


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([one_edit(a, b) and max(len(a), len(b)) > LONG for a, b in zip(*(batch.column(c).to_pylist() for c in ("word", "form")), strict=True)], pa.bool_()))


def _long_neighbours(words: DataFrame) -> DataFrame:
    """``NEAR`` of pairs whose longer word has more than ``LONG`` letters."""
    long = materialize(words.where(F.length("word") >= LONG).withColumn("number", F.monotonically_increasing_id()), "long-words")
    hashed = long.select("number", "word").mapInArrow(_long_rotations, "hash long, number long, skips boolean")
    runs = hashed.groupBy("hash").agg(F.collect_set("number").alias("own")).where(F.size("own") > 1)
    pair = F.flatten(F.transform("own", lambda x: F.transform(F.filter("own", lambda y: y != x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = runs.select(F.explode(pair).alias("p")).select("p.*").distinct()
    left, right = long.select(F.col("number").alias("x"), "word"), long.select(F.col("number").alias("y"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    return pairs.join(left, "x").join(right, "y").select("word", F.lit(1).cast("long").alias("n_near"), "form_n", "form").mapInArrow(_verified, NEAR)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): the number of neighbours and the best, for words (word, n) that have any."""
    spark = words.sparkSession
    turned = rotations(words.where(F.length("word") <= LONG)).repartition(4 * partitions(spark), "prefix").sortWithinPartitions("prefix", "skipped")
    near = turned.mapInArrow(scanned, NEAR).unionByName(_long_neighbours(words))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form"))).alias("best")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by pointer doubling: counts double along a chain, so that few rounds suffice."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now
    raise RuntimeError(f"chains of forms did not end in {MAX_ROUNDS} rounds")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its form, the end of its chain of forms, and its neighbours."""
    words = materialize(word_counts(docs, id_col, text_col), "words")
    near = words.join(neighbours(words), "word", "left")
    is_form: Column = F.col("form_n") >= 2 * F.col("n")
    named = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    named = materialize(named, "forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
