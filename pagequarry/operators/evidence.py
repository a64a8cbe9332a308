"""Evidence from captured frames: what moved, what answered, and which frames to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINOR, CLEAR, RESPONSE = 0.015, 0.03, 0.01
MAX_FRAMES, REPAIR_FRAMES = 14, 5
#: Labels of frames that follow an action.
ACTION_PREFIXES = ("after_click", "hover", "keyboard", "form_", "canvas_click", "after_drag", "select_", "range_", "checkbox_", "link_click")


def _starts(prefix: str) -> Column:
    return F.startswith("label", F.lit(prefix))


def evidence(frames: DataFrame) -> DataFrame:
    """Per record: animation, responsiveness by kind of frame, counts; one aggregation with map-side sums.

    The first observation frame has no predecessor: its change isn't counted.
    """
    watching, diff = F.col("layer") == "observation", F.col("diff_from_prev")
    first = F.min(F.when(watching, F.struct("seq", "diff_from_prev")))
    moved = F.count_if(watching & (diff > MINOR)) - F.when(first["diff_from_prev"] > MINOR, 1).otherwise(0)
    n = F.count_if(watching)
    any_over = lambda test, limit: F.coalesce(F.bool_or(F.when(test, diff > limit)), F.lit(False))
    return frames.groupBy("record_id").agg(
        F.when(n >= 2, moved >= 2).otherwise(False).alias("animation_detected"), F.when(n >= 2, F.bround(moved / (n - 1), 2)).otherwise(0.0).alias("frame_change_rate"),
        any_over(_starts("after_click"), RESPONSE).alias("button_responsive"), F.count_if(_starts("hover") & (diff > MINOR)).alias("hover_effects_detected"), any_over(_starts("keyboard"), MINOR).alias("keyboard_visual_change"),
        (F.count_if(_starts("form_")) > 0).alias("form_probed"), any_over(F.col("label") == "form_submitted", RESPONSE).alias("form_submit_changed"), any_over(F.col("label") == "after_drag", RESPONSE).alias("drag_responsive"),
        F.count_if(F.col("layer") == "responsive").alias("responsive_viewports_tested"), F.count("*").alias("frames"),
    )


def smoothness(frames: DataFrame) -> DataFrame:
    """Per record with deep frames: how often they changed after the first, and the verdict."""
    deep = frames.where("layer = 'deep'")
    first = F.min(F.struct("seq", "diff_from_prev"))
    changes = F.count_if(F.col("diff_from_prev") > MINOR) - F.when(first["diff_from_prev"] > MINOR, 1).otherwise(0)
    counted = deep.groupBy("record_id").agg(changes.alias("changes"))
    return counted.withColumn("verdict", F.when(F.col("changes") >= 4, "smooth").when(F.col("changes") >= 2, "partial").otherwise("unresponsive"))


def outcome() -> Column:
    """What an action's frame shows; null for other frames and without a difference."""
    action = _starts(ACTION_PREFIXES[0])
    for p in ACTION_PREFIXES[1:]:
        action = action | _starts(p)
    diff = F.col("diff_from_prev")
    return F.when(action & (diff != 0.0), F.when(diff >= CLEAR, "responsive").when(diff >= MINOR, "subtle").otherwise("no change"))


def keyframes(frames: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """The most telling frames per record: first, last, the first of each kind of label, then the largest changes up to ``most``.

    All frames of a record with ``most`` or fewer; more than ``most`` where the ones that must stay are more.  No record's frames are
    gathered: those that must stay come from aggregates, and of the others the ``most`` largest changes can matter at most, which Spark
    picks within partitions before it shuffles.
    """
    row = F.struct("seq", "label", "diff_from_prev")
    kind = F.substring_index("label", "_", 1)
    ends = frames.groupBy("record_id").agg(F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("b"))
    ends = ends.select("record_id", F.explode(F.array("a", "b")).alias("r"))
    kinds = frames.groupBy("record_id", kind.alias("kind")).agg(F.min_by(row, "seq").alias("r")).select("record_id", "r")
    largest = W.partitionBy("record_id").orderBy(F.desc("diff_from_prev"), F.desc("seq"))
    others = frames.withColumn("nth", F.row_number().over(largest)).where(F.col("nth") <= most).select("record_id", row.alias("r"))
    marked = ends.unionByName(kinds).withColumn("must", F.lit(True)).unionByName(others.withColumn("must", F.lit(False)))
    once = marked.groupBy("record_id", "r").agg(F.max("must").alias("must")).select("record_id", "r.*", "must")
    order = W.partitionBy("record_id").orderBy(F.desc("must"), F.desc("diff_from_prev"), F.desc("seq"))
    ranked = once.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("must") | (F.col("rank") <= most)).select("record_id", "seq", "label", "diff_from_prev")


def fps_quality(frames: DataFrame, samples: int = 10) -> DataFrame:
    """Per record: how many of its first ``samples`` observation frames show another image (``digest``) than the one before, and the class."""
    order = W.partitionBy("record_id").orderBy("seq")
    first = frames.where("layer = 'observation'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= samples)
    watched = first.withColumn("before", F.lag("digest").over(order))
    counted = watched.groupBy("record_id").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("digest"))).alias("changes"))
    c = F.col("changes")
    return counted.withColumn("fps_quality", F.when(c >= 7, "smooth").when(c >= 4, "acceptable").when(c >= 2, "choppy").otherwise("frozen"))


#: Parts of labels in the order in which frames are chosen for a repair.
REPAIR_PRIORITY = ("stable", "idle_animation", "after_click", "keyboard", "canvas_click", "scroll_bottom", "hover", "gameplay")


def repair_frames(frames: DataFrame, most: int = REPAIR_FRAMES) -> DataFrame:
    """Up to ``most`` frames for a repair prompt, in order: all whose label holds the first part, then the second and so on; the rest
    by the largest change, later ones first.  Short sequences are whole.  Only the best ``most`` of each partition are shuffled."""
    priority = F.lit(len(REPAIR_PRIORITY))
    for i, part in reversed(list(enumerate(REPAIR_PRIORITY))):
        priority = F.when(F.contains("label", F.lit(part)), i).otherwise(priority)
    rest = F.col("priority") == len(REPAIR_PRIORITY)
    order = ("priority", F.when(rest, -F.col("diff_from_prev")), F.when(rest, -F.col("seq")).otherwise(F.col("seq")))
    ranked = frames.withColumn("priority", priority).withColumn("rank", F.row_number().over(W.partitionBy("record_id").orderBy(*order)))
    place = F.row_number().over(W.partitionBy("record_id").orderBy("seq")).cast("long")
    return ranked.where(F.col("rank") <= most).select("record_id", "seq", "label", place.alias("place"))


#: Label prefixes in the order in which frames are paired.
PAIR_PRIORITY = ("stable", "after_click", "keyboard", "idle_animation", "scroll_bottom", "canvas_click", "hover", "gameplay")


def paired_frames(frames: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` (before, after) pairs of a record's frames (record_id, side, seq, label).

    Labels of a prefix are paired greedily in order, prefix by prefix (a label stands for its last frame); then all frames whose label
    is unused are paired by position.  A record brings its labels to its task, each with its last and its first ``most`` frames.
    """
    keys = ["record_id", "side", "label"]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("seq"))
    firsts = frames.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("seq")).alias("firsts"))
    labels = frames.groupBy(*keys).agg(F.max("seq").alias("last")).join(firsts, keys)

    def run(group):
        import pandas as pd

        sides = []
        for side in ("before", "after"):
            own = group[group["side"] == side]
            sides.append(sorted(([int(x) for x in f], label, int(last)) for label, last, f in own[["label", "last", "firsts"]].itertuples(index=False)))
        before, after = ([(label, last) for _, label, last in x] for x in sides)
        pairs = []
        for prefix in PAIR_PRIORITY:
            for b in [x for x in before if x[0].startswith(prefix)]:
                match = next((a for a in after if a[0] == b[0] or a[0].startswith(prefix)), None)
                if match is None or len(pairs) >= most:
                    continue
                pairs.append((b, match))
                before.remove(b)
                after.remove(match)
        unused = [{label for label, _ in x} for x in (before, after)]
        rest = [sorted((seq, label) for f, label, _ in x for seq in f if label in u) for x, u in zip(sides, unused, strict=True)]
        pairs += [((b[1], b[0]), (a[1], a[0])) for b, a in zip(*rest, strict=False)][: most - len(pairs)]
        rows = [(group["record_id"].iloc[0], i, b[0], b[1], a[0], a[1]) for i, (b, a) in enumerate(pairs)]
        return pd.DataFrame(rows, columns=["record_id", "pair", "before_label", "before_seq", "after_label", "after_seq"])

    return labels.groupBy("record_id").applyInPandas(run, "record_id long, pair long, before_label string, before_seq long, after_label string, after_seq long")
