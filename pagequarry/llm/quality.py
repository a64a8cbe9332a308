"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on bootstrap draws of a bounded labelled sample; every path from a root is a conjunctive rule (``a <= x and
b > y``).  A logistic model with lasso penalty over the rules keeps few of them.  The result is compiled into one Spark
column: rules are comparisons of statistic columns, so scoring runs inside the JVM.  The statistics themselves are
computed once per text with numpy over its bytes.

Null text counts as empty.  Without labels of both kinds the score is the share of label 1 (1.0 if there are none).  Documents
without label, with a null or with contradicting labels: labels that aren't 0 or 1 are ignored; repeated ones count repeatedly.
Ties of a statistic with a rule's value go with ``<=``.  Long texts are measured whole; repeated rows stay rows, and a table's own
columns may have any names but those of ``COLUMNS``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import BROADCAST_IDS, fold, materialize, session, text_bytes
from .language import sample

#: Labelled rows per label that the classifier is fitted on, about at most.
SAMPLE = 6000
TREES, DEPTH, LEAF, CUTS = 24, 3, 8, 24
PENALTY, STEPS = 0.002, 600
THRESHOLD = 0.3

STATISTICS = ("n_bytes", "n_words", "mean_word", "longest_word", "distinct_words", "upper", "digits", "symbols", "other_bytes", "lines_per_word", "bars", "bangs", "marked_words", "repeats", "stops")
#: Column names of the statistics; the prefix keeps clear of a table's own columns.
COLUMNS = [f"__stat_{s}" for s in STATISTICS]

UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = DIGIT[48:58] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()|"]] = True


def statistics(text: bytes) -> tuple[float, ...]:
    """The values of ``STATISTICS`` for a whole text."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, int(seen[65:91].sum() + seen[97:123].sum()))
    lengths = len(text) - int(seen[32] + seen[9:14].sum())
    low = text.lower().split()
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:'\"?-)" for w in words)
    stops = int(seen[46] + seen[63])
    per = max(1, n)
    return (
        float(np.log1p(len(text))), float(np.log1p(n)), lengths / per, float(max(map(len, words), default=0)), len(set(low)) / per, seen[65:91].sum() / letters,
        seen[48:58].sum() / size, seen[SYMBOL].sum() / size, seen[128:].sum() / size, seen[10] / per, seen[124] / per, seen[33] / per, marked / per, repeats / per, stops / per,
    )


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` and a column for each statistic of its text."""
    sent = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if text_col in keep else [F.col(text_col)]))
    at, n = sent.columns.index(text_col), len(keep)
    out = StructType([*sent.schema.fields[:n], *(StructField(c, DoubleType()) for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in text_bytes(batch.column(at).to_pylist())]
            cols = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS)).T
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c) for c in cols)], names=out.names)

    return sent.mapInArrow(run, out)


@dataclass(frozen=True)
class Test:
    statistic: int
    above: bool
    value: float


@dataclass
class Rules:
    """Rules (tuples of tests), their weights and the intercept."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([reduce(np.logical_and, ((x[:, t.statistic] > t.value) == t.above for t in r)) for r in self.rules], axis=1).astype(np.float64) if self.rules else np.zeros((len(x), 0))

    def column(self) -> Column:
        """The probability of label 1 as a Spark column over the statistic columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [(F.col(COLUMNS[t.statistic]) > F.lit(t.value)) if t.above else (F.col(COLUMNS[t.statistic]) <= F.lit(t.value)) for t in rule]
            total = total + F.when(reduce(lambda a, b: a & b, tests), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> list[tuple[Test, ...]]:
    """Grows a tree by Gini gain over a random half of the statistics at each node; the paths to all its nodes but the root."""
    paths: list[tuple[Test, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        if path:
            paths.append(path)
        ones = y[rows].sum()
        if len(path) == depth or len(rows) < 2 * LEAF or ones in (0, len(rows)):
            return
        best = (1e-9, None)
        for s in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
            values = x[rows, s]
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1])):
                left = values <= cut
                n = left.sum()
                if not LEAF <= n <= len(rows) - LEAF:
                    continue
                a, b = y[rows][left].mean(), y[rows][~left].mean()
                gain = n * (len(rows) - n) * (a - b) ** 2 / len(rows)
                if gain > best[0]:
                    best = (gain, (int(s), float(cut), left))
        if best[1]:
            s, cut, left = best[1]
            grow(rows[left], (*path, Test(s, False, cut)))
            grow(rows[~left], (*path, Test(s, True, cut)))

    grow(np.arange(len(x)), ())
    return paths


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression with lasso penalty by accelerated proximal gradient steps; columns of ``z`` are 0 or 1."""
    design = np.c_[z, np.ones(len(z))]
    weight = weight / weight.sum()
    rate = 4.0 / max(1e-9, np.linalg.norm(design * np.sqrt(weight)[:, None], 2) ** 2)
    beta = np.zeros(design.shape[1])
    ahead, pace = beta.copy(), 1.0
    for _ in range(steps):
        grad = design.T @ (weight * (1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30))) - y))
        new = ahead - rate * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, beta, pace = new + (pace - 1) / faster * (new - beta), new, faster
    return beta[:-1], float(beta[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Rules:
    if not len(y):
        return Rules(intercept=30.0)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    if share in (1e-6, 1 - 1e-6):
        return Rules(intercept=float(np.log(share / (1 - share))))
    rng, rules = np.random.default_rng(seed), {}
    half = [np.flatnonzero(y == v) for v in (0, 1)]
    size = min(1500, max(map(len, half)))
    for _ in range(TREES):
        rows = np.concatenate([rng.choice(h, min(size, max(len(h), LEAF * 4))) for h in half])
        rules |= dict.fromkeys(tree_paths(x[rows], y[rows], rng))
    found = Rules(list(rules))
    z = found.matrix(x)
    weights, intercept = lasso(z, y, np.ones(len(y)))
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Rules([found.rules[i] for i in used], [float(weights[i]) for i in used], intercept)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = SAMPLE) -> Rules:
    """Fits on (id, text) joined to (doc_id, quality) whose fold isn't ``held_out``; about ``bound`` rows of each label at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and id is not null")
    chosen = sample(known.where(fold(F.col("id"), modulus) != held_out), "quality", bound)
    chosen = materialize(chosen, "quality-sample")
    small = chosen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(chosen) if small else chosen, "id").select("id", "quality", "text")
    # An id of many documents brings as many rows; they are drawn from too.
    counted = materialize(with_statistics(joined, ["id", "quality"]), "quality-rows")
    rows = sample(counted, "quality", 2 * bound).orderBy("id", *COLUMNS).collect()
    x = np.array([[r[c] for c in COLUMNS] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([float(r.quality) for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``)."""
    session(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rules = fit(kept, labels, modulus, held_out, bound)
    scored = with_statistics(kept, ["id"]).select(F.col("id").alias("doc_id"), (fold(F.col("id"), modulus) == held_out).alias("held_out"), rules.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold."""
    session(docs.sparkSession)
    threshold = options.pop("threshold", THRESHOLD)
    kept = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rules = fit(kept, labels, **options)
    return with_statistics(docs, docs.columns).where(rules.column() >= threshold).select(*docs.columns)
