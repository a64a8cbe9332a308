"""Language identification by nearest centroids.

A text becomes a vector of letter n-grams (1 to 3 letters, words bounded by blanks) hashed to ``DIMENSIONS``, damped
(1 + log of the count), weighted by inverse document frequency and scaled to length one.  Each language has ``CLUSTERS``
centroids found by spherical k-means on its training vectors; a text takes the language of the centroid with the
largest cosine.  A text farther from its centroid than nearly all training texts are is marked ``rejected``.

The classifier is fitted on a bounded sample: at most about ``SAMPLE`` labelled texts per language, ``SAMPLE_TOTAL`` in all, of the ``LABELS`` most frequent
languages, drawn row by row.  Every text, whole, is scored.

Null text or text without letters: ``und``, score 0, rejected.  Repeated rows stay rows, and extra columns are ignored.  Without training rows every text is ``und``; an empty table gives an empty result.  Ties between centroids
go to the language first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, session

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
SAMPLE, CLUSTERS, ROUNDS = 1500, 4, 15
#: Texts of all languages together that the classifier is fitted on, about at most; labels that are learned at most, the most frequent.
SAMPLE_TOTAL, LABELS = 12_000, 2_000
#: Share of training texts that may be farther from their centroid than the limit of rejection.
REJECT = 0.002
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Per code point: its lower-case letter, or a blank for anything that isn't one."""
    table = np.full(0x110000, 0x20, np.uint32)
    for block in (range(0xD800), range(0xE000, 0x323B0)):
        for c in block:
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low[0])
    return table


def counts(text: str) -> np.ndarray | None:
    """Damped counts of the hashed letter n-grams of a whole text; None if it has no letter."""
    letters = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = letters != 0x20
    if not word.any():
        return None
    # One blank before, between and after words.
    kept = letters[word | np.r_[False, word[:-1]]]
    kept = kept if kept[-1] != 0x20 else kept[:-1]
    codes = np.r_[np.uint32(0x20), kept, np.uint32(0x20)].astype(np.uint64)
    total = np.zeros(DIMENSIONS)
    for n in ORDERS:
        if len(codes) < n:
            break
        gram = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            gram = (gram ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((gram >> np.uint64(64 - 12)).astype(np.int64), minlength=DIMENSIONS)
    return np.log1p(total).astype(np.float32)


def scaled(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def centroids(rows: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first starts; ``rows`` have length one.  Fewer distinct rows than clusters: one each."""
    rows = rows.astype(np.float32)
    picks = [int(np.argmax(rows @ scaled(rows.mean(0))))]
    near = rows @ rows[picks[0]]
    while len(picks) < min(clusters, len(rows)):
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-6:
            break
        picks.append(i)
        near = np.maximum(near, rows @ rows[i])
    centres = rows[picks]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([scaled(rows[own == k].mean(0)) if (own == k).any() else centres[k] for k in range(len(centres))])
    return centres


def sample(docs: DataFrame, label: str, bound: int, total: int | None = None) -> DataFrame:
    """About ``bound`` rows at most of each label and ``total`` of all, rows drawn one by one; all rows of a label that has fewer.

    Only the ``LABELS`` most frequent labels are drawn from (of equally frequent ones the first in order), so that the bounds hold however
    many labels a dirty column has.  Rows with equal or null ids, and copies, are drawn apart.
    """
    sizes = docs.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    sizes = sizes.orderBy(F.desc("__n"), "__label").limit(LABELS)
    each = min(bound, max(1, total // max(1, sizes.count()))) if total else bound
    # A row's place in its table tells it from rows that are equal in all columns.
    rank = F.pmod(F.xxhash64(F.lit("sample"), F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranked = docs.withColumn("__rank", rank)
    return ranked.join(F.broadcast(sizes), ranked[label] == sizes["__label"]).where(F.col("__rank") * F.col("__n") < each).drop("__label", "__n", "__rank")


class Model:
    """idf, centroids with their languages, and each centroid's limit of rejection."""

    def __init__(self, vectors: np.ndarray, labels: list[str]):
        self.labels: list[str] = []
        self.idf = np.log((1 + len(labels)) / (1 + (vectors > 0).sum(0))).astype(np.float32) + np.float32(1)
        rows, of, parts = scaled(vectors * self.idf), np.array(labels), []
        for label in sorted(set(labels)):
            own = centroids(rows[of == label])
            parts.append(own)
            self.labels += [label] * len(own)
        self.centres = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), np.float32)
        nearest = rows @ self.centres.T if len(labels) else np.zeros((0, 0))
        best = nearest.argmax(1) if len(labels) else np.zeros(0, int)
        self.limits = np.array([np.quantile(nearest[best == k, k], REJECT) if (best == k).any() else 0.0 for k in range(len(self.labels))])

    def predict(self, vectors: np.ndarray) -> list[tuple[str, float, bool]]:
        cosines = scaled(vectors * self.idf) @ self.centres.T
        best = cosines.argmax(1)
        return [(self.labels[k], float(np.clip(c[k], 0, 1)), bool(c[k] < self.limits[k])) for k, c in zip(best.tolist(), cosines, strict=True)]


def fit(labelled: DataFrame, bound: int = SAMPLE) -> Model:
    """Fits on (id, text, lang); ``bound`` is about the largest number of texts per language that reach the driver as vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, v.astype(np.float16).tobytes()) for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t and (v := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "vector"])

    rows = sample(labelled, "lang", bound, total=SAMPLE_TOTAL).select("text", "lang").mapInArrow(run, "lang string, vector binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.vector)))
    vectors = np.stack([np.frombuffer(bytes(r.vector), np.float16) for r in rows]).astype(np.float32) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return Model(vectors, [r.lang for r in rows])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", modulus: int = 4, held_out: int = 2, bound: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (cosine, 0 to 1), rejected."""
    spark = session(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col), modulus) == held_out).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    shared = spark.sparkContext.broadcast(fit(kept.where("not held_out"), bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            vectors = [counts(t) if t and model.labels else None for t in batch.column(2).to_pylist()]
            some = [v for v in vectors if v is not None]
            found = iter(model.predict(np.stack(some)) if some else ())
            rows = [(UNKNOWN, 0.0, True) if v is None else next(found) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return kept.select("id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
