"""Queries that curate: tiers, exports, near-duplicate pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..sources.tables import RESULTS_SQL, table
from .analysis_queries import _latest


def curation_tiers(spark, sf_dir):
    return C.tiers(_latest(spark, sf_dir)).select("line_idx", "item_id", "total", "tier")


def curation_tier_counts(spark, sf_dir):
    return C.tier_counts(_latest(spark, sf_dir))


def curation_sft_export(spark, sf_dir):
    return C.sft_rows(_latest(spark, sf_dir), 80)


def curation_exact_duplicates(spark, sf_dir):
    """Pages with the same text after lower-casing and collapsing white space: the first of them and how many there are."""
    text = F.regexp_replace(F.lower("html"), "\\s+", " ")
    return table(spark, sf_dir, "pages").groupBy(F.md5(text.cast("binary")).alias("digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))


def curation_near_duplicates(spark, sf_dir):
    """Near-duplicate pages by MinHash; the page with the best score of each cluster stays."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), (F.col("page_id") * 37 % 101).alias("score"))
    return C.deduplicate(pages)


def curation_near_duplicate_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("score"))
    return C.deduplicate(docs)


def curation_run(spark, sf_dir):
    """Pages with scores by their size: tiers, duplicates, repairs."""
    size = F.length("html")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), (size % 101).alias("total"), F.when(size % 13 == 0, "failed").otherwise("completed").alias("eval_status"))
    return C.curated(rows).groupBy("tier", "decision").agg(F.count("*").alias("n"), F.sum("total").alias("points"))


LATEST = f"WITH {RESULTS_SQL}, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY trial, item_id ORDER BY line_idx DESC) AS rn FROM results_raw) WHERE rn = 1), t AS (SELECT *, CASE WHEN total >= 80 THEN 'A' WHEN total >= 40 THEN 'B' ELSE 'C' END AS tier FROM latest WHERE eval_status = 'completed')"
ORACLES = {
    "curation_tiers": f"{LATEST} SELECT line_idx, item_id, total, tier FROM t",
    "curation_tier_counts": f"{LATEST} SELECT tier, count(*) AS n, CAST(sum(total) AS BIGINT) AS points, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM t), 1) AS percent FROM t GROUP BY tier",
    "curation_sft_export": f"{LATEST} SELECT item_id AS query, line_idx AS source_line, total AS score FROM t WHERE tier = 'A'",
    "curation_exact_duplicates": "SELECT md5(regexp_replace(lower(html), '\\s+', ' ', 'g')) AS digest, min(page_id) AS first_id, count(*) AS n FROM pages GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "curation_near_duplicates", "curation_near_duplicate_documents", "curation_run"]}
