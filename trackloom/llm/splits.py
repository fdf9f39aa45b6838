"""Problem 2: splits that keep related records together.

Records are vertices of a graph whose edges are shared link values; its components come from random-mate
contraction (``components``). Components are then laid end to end by weight, in hash order per source,
and the split of a component is the one whose share of the line holds its middle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clip_name, clip_of_frame, frame_name, split_name
from ..session import Scratch
from .components import linked_groups

SLOT_GROUPS = 20_000  # groups of one source in one slot of its line


def clip_groups(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(record_id, group_id)`` of records with a clip_key: those whose clip_key names one clip, however spelled, are one group. A null clip_key, or one without a name, gives no row."""
    named = records.select("record_id", F.col("clip_key").alias("spelled"), clip_name(F.col("clip_key")).alias("clip")).filter("clip <> ''")
    return linked_groups(named, "record_id", ["spelled", "clip"], scratch)


def straddling(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``record_id`` of records whose group has records in two or more assigned splits, in any spelling. Null splits neither count nor appear."""
    split = records.select("record_id", split_name(F.col("assigned_split")).alias("split")).filter("split <> ''")
    member = clip_groups(records, scratch).join(split, "record_id")
    torn = member.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("group_id")
    return member.join(torn, "group_id", "left_semi").select("record_id").distinct()


def related_groups(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(record_id, source, group_id)`` of every record: records of one clip or of one source frame are one group, directly or by way of others.

    A null clip_key takes the clip of the record's source frame; a record that names nothing is a group of its own.
    A null source is "". Equal checksums don't link: they chain most clips into one group, which no ratio survives.
    """
    frame = frame_name(F.col("source_key"))
    base = records.select("record_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.nullif(clip_name(F.col("clip_key")), F.lit("")), clip_of_frame(frame), F.lit("")).alias("clip"), frame.alias("frame"))
    base = scratch.cut(base)
    return linked_groups(base.select("record_id", "clip", "frame"), "record_id", ["clip", "frame"], scratch).join(base.select("record_id", "source"), "record_id")


def assign_splits(records: DataFrame, targets: DataFrame, scratch: Scratch, slot_groups: int = SLOT_GROUPS) -> DataFrame:
    """``(record_id, source, group_id, new_split)`` for every record.

    All records of one group of ``related_groups`` get one split: clips and source frames stay whole. Ratios are met overall and within each source (a group counts for the source that holds most of
    it), to within half the group on each cut. Groups beyond half the least ratio of their source lie first,
    the largest in front, and so in the largest split. Ratios need not add up to one; null or negative ones
    count as nought. More than 1,000 targets are refused. A source's line is cut into slots of about
    ``slot_groups`` groups, which doesn't change the order of groups in it.
    """
    with Scratch(records.sparkSession) as inner:
        grouped = scratch.cut(related_groups(records, inner))
    weights = grouped.groupBy("group_id", "source").agg(F.count("*").alias("n"))
    groups = weights.groupBy("group_id").agg(F.max_by("source", F.struct("n", "source")).alias("home"), F.sum("n").alias("n"))
    named = targets.filter("split_name IS NOT NULL").limit(1001).collect()
    if len(named) > 1000:
        raise ValueError("more than 1,000 split targets")
    ratios = sorted(((max(r["ratio"] or 0.0, 0.0), r["split_name"]) for r in named), key=lambda r: (-r[0], r[1]))
    whole = sum(r for r, _ in ratios) or 1.0
    least = min((r for r, _ in ratios if r > 0), default=1.0) / whole
    totals = groups.groupBy("home").agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    # Large groups first (there are fewer than 2 / least of them in a source), the others in order of their hash: a slot is a range of it.
    large = F.col("n") > F.col("total") * least / 2
    slots = F.greatest(F.ceil(F.col("groups") / slot_groups), F.lit(1))
    hashed = F.conv(F.substring(F.md5(F.col("group_id").cast("string")), 1, 8), 16, 10).cast("long")
    placed = groups.join(totals, "home").withColumn("hash", F.when(large, F.lit(-1)).otherwise(hashed)).withColumn("slot", F.when(large, F.lit(-1)).otherwise(F.shiftright(F.col("hash") * slots, 32)))
    placed = scratch.cut(placed)
    line = Window.partitionBy("home").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("home", "slot").agg(F.sum("n").alias("w")).withColumn("start", F.coalesce(F.sum("w").over(line), F.lit(0))).drop("w")
    inside = Window.partitionBy("home", "slot").orderBy("hash", F.when(F.col("slot") < 0, -F.col("n")), "group_id").rowsBetween(Window.unboundedPreceding, -1)
    middle = placed.join(starts, ["home", "slot"]).withColumn("at", (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("n") / 2) / F.col("total"))
    chosen, upto = None, 0.0
    for ratio, name in ratios:
        upto += ratio / whole
        chosen = F.when(F.col("at") < upto, F.lit(name)) if chosen is None else chosen.when(F.col("at") < upto, F.lit(name))
    label = chosen.otherwise(F.lit(ratios[-1][1])) if ratios else F.lit(None).cast("string")
    return grouped.join(middle.select("group_id", label.alias("new_split")), "group_id").select("record_id", "source", "group_id", "new_split")


def split_report(assigned: DataFrame) -> DataFrame:
    """Records and share per source (and overall, as ``*``) and split."""
    counts = assigned.rollup("new_split", "source").agg(F.count("*").alias("records")).filter("new_split IS NOT NULL")
    per = counts.select(F.coalesce("source", F.lit("*")).alias("source"), "new_split", "records")
    return per.withColumn("share", F.round(F.col("records") / F.sum("records").over(Window.partitionBy("source")), 4))
