"""Problem 4: one best record per duplicate group, by iterative truth discovery.

Sources vote for field values; a vote weighs as its source is reliable for that field, and a source is as
reliable as its votes agree with the winners. Both are estimated in turn until they settle. Groups with
the same pattern of votes (who agrees with whom, whatever the values) are one row with a count, so the
rounds run over a table of patterns, not over the claims.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import checksum, clip_name, frame_name, split_name
from ..session import Scratch
from .components import linked_groups

FIELDS = ("boxes", "ignored_objects", "file_size", "frame", "checksum", "clip", "original_split", "assigned_split")
ROUNDS, DAMPED = 100, 20  # from round DAMPED on a weight goes half the way, so that no two rounds swap for ever
TOLERANCE = 1e-3


def good_boxes(boxes: F.Column) -> F.Column:
    """Boxes that can be: finite, of some size, inside the picture; in one order, rounded to 4 places. Null stays null."""
    def good(b):
        w, h = b["w"], b["h"]
        fits = (b["x"] - w / 2 >= -0.001) & (b["x"] + w / 2 <= 1.001) & (b["y"] - h / 2 >= -0.001) & (b["y"] + h / 2 <= 1.001)
        return F.coalesce((w > 0) & (h > 0) & fits, F.lit(False))

    rounded = F.transform(F.filter(boxes, good), lambda b: F.struct(*[F.round(b[c], 4).alias(c) for c in "xywh"]))
    return F.array_distinct(F.array_sort(rounded))


def box_text(boxes: F.Column) -> F.Column:
    """``x y w h`` of each box with four places, joined by "; "; "[]" for none."""
    text = F.array_join(F.transform(boxes, lambda b: F.format_string("%.4f %.4f %.4f %.4f", *[b[c] for c in "xywh"])), "; ")
    return F.when(F.size(boxes) == 0, "[]").otherwise(text)


def text_boxes(text: str) -> F.Column:
    """The boxes of a ``box_text`` column."""
    numbers = f"transform(split({text}, '; '), t -> transform(split(t, ' '), v -> cast(v as double)))"
    return F.expr(f"if({text} = '[]', array(), transform({numbers}, v -> named_struct('x', v[0], 'y', v[1], 'w', v[2], 'h', v[3])))")


def image_members(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(record_id, group_id)``: records with the same source frame, or the same checksum and size, directly or by way of others; group_id is the least record_id. A record with neither is a group of its own, a record_id that stands twice a row each."""
    keyed = scratch.cut(records.select("record_id", frame_name(F.col("source_key")).alias("frame"), checksum(F.col("image_hash")).alias("checksum")))
    return linked_groups(keyed, "record_id", ["frame", "checksum"], scratch)


def _values() -> dict[str, F.Column]:
    return {
        "boxes": box_text(good_boxes(F.col("boxes"))),
        "ignored_objects": F.regexp_extract(F.col("ignored_objects").cast("string"), "^[0-9]+$", 0),
        "file_size": F.regexp_extract(F.col("file_size").cast("string"), "^[1-9][0-9]*$", 0),
        "frame": frame_name(F.col("source_key")), "checksum": checksum(F.col("image_hash")), "clip": clip_name(F.col("clip_key")),
        "original_split": split_name(F.col("original_split")), "assigned_split": split_name(F.col("assigned_split")),
    }


def _read(records: DataFrame, members: DataFrame) -> DataFrame:
    """Every record once, with its group, the group's ``copies`` and its values made readable: what all later steps read. Null, invalid and unreadable values are null; a list without a possible box is "[]"."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("copies"))
    values = [F.nullif(v, F.lit("")).alias(f) for f, v in _values().items()]
    row = records.select("record_id", F.coalesce("source", F.lit("")).alias("source"), "scanned_at", "image", *values)
    return row.join(members.join(sizes, "group_id"), "record_id")


def _claims(read: DataFrame) -> DataFrame:
    """``group_id, field, value, source, n, latest`` of shared images: who claims what, repeated claims counted before they move."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    claims = read.filter("copies > 1").select("group_id", "source", "scanned_at", fields.alias("c")).select("group_id", "c.field", "c.value", "source", "scanned_at").filter("value IS NOT NULL")
    return claims.groupBy("group_id", "field", "value", "source").agg(F.count("*").alias("n"), F.max("scanned_at").alias("latest"))


def _ranked_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.col("short_name").alias("source")).agg(F.min("priority").alias("priority"))


def _boxed() -> F.Column:
    """False for an empty box list, which loses to any boxes."""
    return ~((F.col("field") == "boxes") & (F.col("value") == "[]"))


def source_weights(claims: DataFrame, sources: DataFrame, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``field, source, weight`` by turns of weighted votes and agreement, until no weight moves by more than ``tolerance``. Weights start equal. Weights that still move after ``rounds`` are an error, never a result.

    Every claim counts: votes are exact, and those of groups with one value, which agree in every round, come as
    one sum per field and source. A round's winner is chosen as in ``chosen_values``: boxes before none, score,
    trust, the latest, the greatest value. The last two enter a pattern as the order of its values.
    """
    inner = Scratch(scratch.spark)
    ranks = _ranked_sources(sources)
    # Laid out once for both steps: a group's claims on a field are few, as they are counted (sources times values).
    laid = claims.repartition("group_id", "field").join(ranks, "source", "left")
    by_value = laid.groupBy("group_id", "field", "value").agg(
        F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"), F.max(-F.coalesce("priority", F.lit(1 << 30))).alias("trust"), F.max("latest").alias("latest")
    )
    # In rising order of the last ties: the later place in the pattern wins them.
    value = F.struct("latest", "value", F.struct(_boxed().alias("boxed"), "trust", "by").alias("vote"))
    patterns = by_value.groupBy("group_id", "field").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["vote"]).alias("pattern"))
    patterns = inner.cut(patterns.groupBy("field", "pattern").agg(F.count("*").alias("groups")).withColumn("pid", F.xxhash64("field", "pattern")))
    agreed = patterns.filter("size(pattern) = 1").select("field", "groups", F.explode(F.col("pattern")[0]["by"]).alias("b"))
    agreed = inner.cut(agreed.groupBy("field", "b.source").agg(F.sum(F.col("groups") * F.col("b.n")).alias("agreed")))
    split = patterns.filter("size(pattern) > 1").select("field", "pid", "groups", F.posexplode("pattern").alias("vid", "vote"))
    table = inner.cut(split.select("field", "pid", "groups", "vid", "vote.boxed", "vote.trust", F.explode("vote.by").alias("b")).select("field", "pid", "groups", "vid", "boxed", "trust", "b.source", "b.n"))
    weights = scratch.cut(table.select("field", "source").distinct().withColumn("weight", F.lit(1.0)))
    best = Window.partitionBy("field", "pid").orderBy(F.desc("boxed"), F.desc(F.round("score", 9)), F.desc("trust"), F.desc("vid"))
    for turn in range(rounds):
        scores = table.join(weights, ["field", "source"]).groupBy("field", "pid", "vid").agg(F.sum(F.col("n") * F.col("weight")).alias("score"), F.max("boxed").alias("boxed"), F.max("trust").alias("trust"))
        winners = scores.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select("field", "pid", F.col("vid").alias("won"))
        judged = table.join(winners, ["field", "pid"]).groupBy("field", "source").agg(
            F.sum(F.when(F.col("vid") != F.col("won"), F.col("groups") * F.col("n")).otherwise(0)).alias("wrong"), F.sum(F.col("groups") * F.col("n")).alias("all")
        )
        every = F.col("all") + F.coalesce("agreed", F.lit(0))
        new = judged.join(agreed, ["field", "source"], "left").select("field", "source", (-F.log((F.col("wrong") + 1) / (every + 2))).alias("weight"))
        new = new.withColumn("weight", F.col("weight") / F.max("weight").over(Window.partitionBy("field")))
        if turn >= DAMPED:
            new = new.join(weights.withColumnRenamed("weight", "old"), ["field", "source"]).select("field", "source", ((F.col("weight") + F.col("old")) / 2).alias("weight"))
        new = scratch.cut(new)
        moved = new.join(weights.withColumnRenamed("weight", "old"), ["field", "source"]).agg(F.max(F.abs(F.col("weight") - F.col("old")))).first()[0]
        scratch.drop(weights)
        weights = new
        if moved is None or moved <= tolerance:
            inner.close()
            return weights
    raise RuntimeError(f"weights still move by {moved} after {rounds} rounds")


def chosen_values(read: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``group_id, field, value, support, latest`` of shared images.

    The value with the greatest weight of votes wins its field; then the most trusted source's (priority in
    ``sources``, unknown ones last), the latest, the greatest. An empty box list loses to any boxes. A field
    that nobody claims has no row. Whatever a group's size, claims are counted before they move.
    """
    claims = scratch.cut(_claims(read))
    weights = source_weights(claims, sources, scratch)
    ranks = _ranked_sources(sources)
    weighed = claims.repartition("group_id").join(weights, ["field", "source"], "left").join(ranks, "source", "left")
    scored = weighed.groupBy("group_id", "field", "value").agg(
        F.sum(F.col("n") * F.coalesce("weight", F.lit(1.0))).alias("score"), F.sum("n").alias("votes"), F.max(-F.coalesce("priority", F.lit(1 << 30))).alias("trust"), F.max("latest").alias("latest")
    )
    order = F.struct(_boxed().alias("boxed"), F.round("score", 9).alias("score"), "trust", "latest", "value")
    return scored.groupBy("group_id", "field").agg(F.max_by("value", order).alias("value"), (F.max_by("votes", order) / F.sum("votes")).alias("support"), F.max("latest").alias("latest"))


def survivors(records: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per image: ``group_id, copies``, the fields, ``image`` (the path of the most trusted source's latest copy), ``support`` (least share of the votes behind a chosen value) and ``latest`` scan.

    Values are chosen as in ``chosen_values``; a field that nobody claims is null. Singles keep their own
    values, with support 1. No row is capped or dropped. ``sources`` is a dimension (a row per source, small by nature).
    """
    with Scratch(records.sparkSession) as inner:
        read = scratch.cut(_read(records, image_members(records, inner)))
    chosen = chosen_values(read, sources, scratch)
    wide = chosen.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS], F.round(F.min("support"), 4).alias("support"), F.max("latest").alias("latest"))
    typed = [text_boxes("boxes").alias("boxes"), F.col("ignored_objects").cast("int").alias("ignored_objects"), F.col("file_size").cast("long").alias("file_size")]
    plain = ["frame", "checksum", "clip", "original_split", "assigned_split", "image", "support", "latest"]
    paths = read.filter("copies > 1").join(_ranked_sources(sources), "source", "left")
    best = F.struct(-F.coalesce("priority", F.lit(1 << 30)), "scanned_at", "image")
    paths = paths.groupBy("group_id").agg(F.max("copies").alias("copies"), F.max_by("image", F.when(F.col("image").isNotNull(), best)).alias("image"))
    groups = paths.join(wide, "group_id", "left").select("group_id", "copies", *typed, *plain)
    own = read.filter("copies = 1").withColumn("support", F.lit(1.0)).withColumn("latest", F.col("scanned_at"))
    return groups.unionByName(own.select("group_id", "copies", *typed, *plain))


def duplicate_members(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(group_id, record_id)`` of the images for which ``survivors`` builds one record from two or more."""
    with Scratch(records.sparkSession) as inner:
        members = scratch.cut(image_members(records, inner))
    shared = members.groupBy("group_id").agg(F.count("*").alias("copies")).filter("copies > 1").select("group_id")
    return members.join(shared, "group_id", "left_semi").select("group_id", "record_id").distinct()
