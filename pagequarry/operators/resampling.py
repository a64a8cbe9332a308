"""Bootstrap intervals of means by the very resamples of a seeded generator, and whether two intervals overlap.

A resample draws places of a group's scores in their order.  The draws are those of a Mersenne Twister seeded by a key: the leading bits of
each 32-bit word, words beyond the group's size drawn anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import intervals

#: Draws of an interval, its seed, the least size of a group, and the most scores (8 bytes each) that one task holds; larger groups are
#: drawn from their histogram, by other random numbers.
DRAWS, SEED, LEAST, HELD = 1000, 42, 10, 250_000


def places(n: int, resamples: int, seed: int = SEED):
    """For each resample the ``n`` places drawn."""
    words, bits = np.random.RandomState([seed]), n.bit_length()
    kept = np.empty(0, np.int64)
    for _ in range(resamples):
        while len(kept) < n:
            fresh = words.randint(0, 1 << 32, max(1024, 2 * n), dtype=np.uint32).astype(np.int64) >> (32 - bits)
            kept = np.r_[kept, fresh[fresh < n]]
        yield kept[:n]
        kept = kept[n:]


def interval(scores: np.ndarray, draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """The bounds of the middle 95 % of the resamples' means, to two digits."""
    n = len(scores)
    means = sorted(float(scores[at].sum()) / n for at in places(n, draws, seed))
    return round(means[int(0.025 * draws)], 2), round(means[int(0.975 * draws) - 1], 2)


def ordered_intervals(rows: DataFrame, keys: list[str], order: str = "line_idx", draws: int = DRAWS, seed: int = SEED, least: int = LEAST, held: int = HELD) -> DataFrame:
    """(keys, n, mean, ci_low, ci_high) of ``total`` per group of at least ``least`` rows, scores in their ``order``.

    Groups of up to ``held`` rows are resampled exactly; larger ones by ``records.intervals``, never gathered.
    """
    sizes = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    sized = rows.select(*keys, "total", F.col(order).alias("__order")).join(sizes, same)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long, mean double, ci_low double, ci_high double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        scores = group.sort_values("__order")["total"].to_numpy(np.int64)
        low, high = interval(scores, draws, seed)
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "n": [len(scores)], "mean": [round(float(scores.sum()) / len(scores), 2)], "ci_low": [low], "ci_high": [high]})

    exact = sized.where(F.col("__n") <= held).select(*keys, "total", "__order").groupBy(*keys).applyInPandas(run, schema)
    return exact.unionByName(intervals(sized.where(F.col("__n") > held).select(*keys, "total"), keys, draws, seed, least))


def overlap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two intervals meet; null if a bound is unknown."""
    return (low <= other_high) & (other_low <= high)


def compare_with_intervals(rows: DataFrame, base: str, other: str, keys: tuple[str, ...] = (), order: str = "line_idx") -> DataFrame:
    """Two models side by side, over all rows or per group: averages (one digit), their difference, intervals, and whether these overlap."""
    chosen = rows.where(F.col("model").isin(base, other))
    found = chosen.groupBy("model", *keys).agg(F.bround(F.avg("total"), 1).alias("avg"))
    bounds = ordered_intervals(chosen, ["model", *keys], order).select("model", *keys, "ci_low", "ci_high")
    told = found.join(bounds, ["model", *keys], "left")
    side = lambda m, n: F.max(F.when(F.col("model") == m, F.struct("avg", "ci_low", "ci_high"))).alias(n)
    both = told.groupBy(*keys).agg(side(base, "a"), side(other, "b"))
    meet = overlap(F.col("a.ci_low"), F.col("a.ci_high"), F.col("b.ci_low"), F.col("b.ci_high"))
    return both.select(*keys, F.col("a.avg").alias("base_avg"), F.col("b.avg").alias("other_avg"), F.bround(F.col("b.avg") - F.col("a.avg"), 1).alias("delta"), F.col("a.ci_low").alias("base_low"), F.col("a.ci_high").alias("base_high"), F.col("b.ci_low").alias("other_low"), F.col("b.ci_high").alias("other_high"), meet.alias("overlap"))
