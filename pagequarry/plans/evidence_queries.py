"""Queries over captured frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import image as I  # noqa: E741
from ..operators import evidence as E
from ..sources.staging import cut
from ..sources.tables import FRAMES_SQL, frames, table


def frame_evidence(spark, sf_dir):
    return E.evidence(frames(spark, sf_dir))


def frame_smoothness(spark, sf_dir):
    return E.smoothness(frames(spark, sf_dir))


def frame_outcomes(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("outcome", E.outcome()).groupBy("label", "outcome").agg(F.count("*").alias("n"))


def frame_keyframes(spark, sf_dir):
    return E.keyframes(frames(spark, sf_dir)).withColumn("diff_from_prev", F.bround("diff_from_prev", 6))


def frame_fps(spark, sf_dir):
    return E.fps_quality(frames(spark, sf_dir))


def frame_repair_selection(spark, sf_dir):
    return E.repair_frames(frames(spark, sf_dir))


def frame_pairs(spark, sf_dir):
    """Frames before and after (even and odd captures of a record), paired by label."""
    side = F.when(F.col("seq") % 2 == 0, "after").otherwise("before")
    return E.paired_frames(frames(spark, sf_dir).withColumn("side", side))


def frame_ssim(spark, sf_dir):
    """Structural difference of each page's raster to the page before it on the same host; only ids are sorted, images are joined."""
    pages = table(spark, sf_dir, "pages")
    images = cut(pages.select("page_id", I.raster("html").alias("frame")), "frames")
    order = W.partitionBy(F.regexp_extract("url", "//([^/]+)/", 1)).orderBy("page_id")
    ids = pages.select("page_id", F.lag("page_id").over(order).alias("last"))
    before = images.select(F.col("page_id").alias("last"), F.col("frame").alias("before"))
    both = ids.join(images, "page_id").join(before, "last", "left")
    changed = F.coalesce(F.md5("before") != F.md5("frame"), F.lit(True))
    return both.select("page_id", F.bround(I.frame_difference("before", "frame"), 6).alias("diff"), I.is_blank("frame").alias("blank"), changed.alias("changed"))


ANY = lambda test, limit: f"coalesce(bool_or(diff_from_prev > {limit}) FILTER ({test}), false)"
ORACLES = {
    "frame_evidence": f"""WITH {FRAMES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY record_id, layer ORDER BY seq) AS nth FROM frames)
      SELECT record_id, CASE WHEN count(*) FILTER (layer = 'observation') >= 2 THEN count(*) FILTER (layer = 'observation' AND nth > 1 AND diff_from_prev > 0.015) >= 2 ELSE false END AS animation_detected,
      CASE WHEN count(*) FILTER (layer = 'observation') >= 2 THEN round_even(count(*) FILTER (layer = 'observation' AND nth > 1 AND diff_from_prev > 0.015) / (count(*) FILTER (layer = 'observation') - 1), 2) ELSE 0.0 END AS frame_change_rate,
      {ANY("starts_with(label, 'after_click')", 0.01)} AS button_responsive, count(*) FILTER (starts_with(label, 'hover') AND diff_from_prev > 0.015) AS hover_effects_detected, {ANY("starts_with(label, 'keyboard')", 0.015)} AS keyboard_visual_change,
      count(*) FILTER (starts_with(label, 'form_')) > 0 AS form_probed, {ANY("label = 'form_submitted'", 0.01)} AS form_submit_changed, {ANY("label = 'after_drag'", 0.01)} AS drag_responsive, count(*) FILTER (layer = 'responsive') AS responsive_viewports_tested, count(*) AS frames FROM o GROUP BY record_id""",
    "frame_smoothness": f"""WITH {FRAMES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS nth FROM frames WHERE layer = 'deep'), c AS (SELECT record_id, count(*) FILTER (nth > 1 AND diff_from_prev > 0.015) AS changes FROM o GROUP BY 1)
      SELECT *, CASE WHEN changes >= 4 THEN 'smooth' WHEN changes >= 2 THEN 'partial' ELSE 'unresponsive' END AS verdict FROM c""",
    "frame_outcomes": f"""WITH {FRAMES_SQL} SELECT label, CASE WHEN ({" OR ".join(f"starts_with(label, '{p}')" for p in E.ACTION_PREFIXES)}) AND diff_from_prev <> 0 THEN CASE WHEN diff_from_prev >= 0.03 THEN 'responsive' WHEN diff_from_prev >= 0.015 THEN 'subtle' ELSE 'no change' END END AS outcome, count(*) AS n FROM frames GROUP BY 1, 2""",
    "frame_keyframes": f"""WITH {FRAMES_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY record_id) AS n, row_number() OVER (PARTITION BY record_id, split_part(label, '_', 1) ORDER BY seq) AS of_kind FROM frames), k AS (SELECT *, seq = 1 OR seq = n OR of_kind = 1 AS must FROM m),
      r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY must DESC, diff_from_prev DESC, seq DESC) AS rank FROM k) SELECT record_id, seq, label, round_even(diff_from_prev, 6) AS diff_from_prev FROM r WHERE n <= 14 OR must OR rank <= 14""",
    "frame_fps": f"""WITH {FRAMES_SQL}, o AS (SELECT *, row_number() OVER w AS nth, lag(digest) OVER w AS before FROM frames WHERE layer = 'observation' WINDOW w AS (PARTITION BY record_id ORDER BY seq)),
      c AS (SELECT record_id, count(*) FILTER (before IS NOT NULL AND before <> digest) AS changes FROM o WHERE nth <= 10 GROUP BY 1)
      SELECT *, CASE WHEN changes >= 7 THEN 'smooth' WHEN changes >= 4 THEN 'acceptable' WHEN changes >= 2 THEN 'choppy' ELSE 'frozen' END AS fps_quality FROM c""",
    "frame_repair_selection": f"""WITH {FRAMES_SQL}, p AS (SELECT *, CASE WHEN contains(label, 'stable') THEN 1 WHEN contains(label, 'idle_animation') THEN 2 WHEN contains(label, 'after_click') THEN 3 WHEN contains(label, 'keyboard') THEN 4
        WHEN contains(label, 'canvas_click') THEN 5 WHEN contains(label, 'scroll_bottom') THEN 6 WHEN contains(label, 'hover') THEN 7 WHEN contains(label, 'gameplay') THEN 8 ELSE 9 END AS priority FROM frames),
      named AS (SELECT record_id, seq, label, row_number() OVER (PARTITION BY record_id ORDER BY priority, seq) AS rank FROM p WHERE priority < 9),
      others AS (SELECT record_id, seq, label, row_number() OVER (PARTITION BY record_id ORDER BY diff_from_prev DESC, seq DESC) AS rank FROM p WHERE priority = 9),
      chosen AS (SELECT record_id, seq, label FROM named WHERE rank <= 5 UNION ALL
        SELECT o.record_id, seq, label FROM others o LEFT JOIN (SELECT record_id, count(*) AS n FROM named GROUP BY 1) c ON o.record_id = c.record_id WHERE rank <= 5 - coalesce(n, 0))
      SELECT record_id, seq, label, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS place FROM chosen""",
}
QUERIES = {name: globals()[name] for name in [*ORACLES, "frame_pairs", "frame_ssim"]}
