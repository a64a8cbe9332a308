"""Mixing sources to target weights by Poisson replication, with built-in Spark functions only.

A source with n of N rows and target weight w is repeated at a rate r = w * N / n on average.  Each row draws its number of copies
from a Poisson distribution with mean r by inversion: a uniform number from a hash of seed and id is compared with the
distribution's cumulated probabilities, which are computed once per source.  Rates over ``PIECE`` are drawn as the sum of several
draws with equal parts of the rate, so that no table of probabilities gets long.  Copies are exploded and shuffled
globally: they are dealt and sorted by a hash of seed, id and copy number.

A hot source is spread like any other: nothing is grouped but counts.  Weights are relative; sources without a weight get none,
and no ``weights`` at all means equal parts.  A null source is a source of its own.  Rows with equal ids draw equally; a null id
draws as the empty string.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

SEED = 2024
PIECE = 16.0
#: Cumulated probabilities that are kept: beyond them less than 2 ** -53 is left at a rate of ``PIECE``.
TERMS = 80
#: Sources whose rates are broadcast at most; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulated(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, term by term from exp(-rate)."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("a"))

    def step(s: Column, k: Column) -> Column:
        term = F.when(k == 0, F.exp(-rate)).otherwise(s["t"] * rate / k)
        return F.struct(term.alias("t"), (s["c"] + term).alias("c"), F.concat(s["a"], F.array(s["c"] + term)).alias("a"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, step, lambda s: s["a"])


def rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None) -> DataFrame:
    """(__source, __pieces, __cdf) per source; one row each."""
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("__n"))
    if weights is None:
        weighed = sizes.withColumn("__w", F.lit(1.0))
    else:
        chosen = F.lit(0.0)
        for name, w in weights.items():
            chosen = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(chosen)
        weighed = sizes.withColumn("__w", chosen)
    weighed = materialize(weighed, "source-sizes")
    total = weighed.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum("__w"), F.lit(0.0)).alias("w")).first()
    rate = F.col("__w") * F.lit(float(total.n)) / (F.lit(float(total.w) or 1.0) * F.col("__n"))
    split = weighed.select("__source", rate.alias("__rate")).withColumn("__pieces", F.greatest(F.lit(1), F.ceil(F.col("__rate") / PIECE)).cast("int"))
    return split.select("__source", "__pieces", cumulated(F.col("__rate") / F.col("__pieces")).alias("__cdf"))


def copies(doc_id: Column, seed: int) -> Column:
    """How often a row with ``__pieces`` and ``__cdf`` is repeated."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    draw = lambda j: F.size(F.filter(F.col("__cdf"), lambda c: c <= uniform(F.lit("copies"), F.lit(str(seed)), name, j.cast("string"))))
    one = F.array_size(F.filter(F.col("__cdf"), lambda c: c <= F.col("__u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__pieces")), F.lit(0), lambda n, j: n + draw(j))
    return one + F.when(F.col("__pieces") > 1, more).otherwise(F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None, seed: int = SEED, copy_col: str = "copy_no", key_col: str = "mix_key") -> DataFrame:
    """``docs`` with its rows repeated to the target weights, and the columns copy_no (from 1) and mix_key, in random order.

    Columns of ``docs`` that have the name of an added column are left out.
    """
    spark = docs.sparkSession
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (copy_col, key_col)]
    table = materialize(rates(docs, source, weights), "source-rates")
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    drawn = docs.join(table, docs[source].eqNullSafe(table["__source"])).withColumn("__u", uniform(F.lit("copies"), F.lit(str(seed)), name, F.lit("1")))
    counted = drawn.withColumn("__copies", copies(F.col(f"`{id_col}`"), seed)).where("__copies > 0")
    repeated = counted.select(*keep, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(copy_col))
    key = F.substring(F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), name, F.col(copy_col).cast("string")).cast("binary")), 1, 16)
    return repeated.withColumn(key_col, key).repartition(partitions(spark), key_col).sortWithinPartitions(key_col)
