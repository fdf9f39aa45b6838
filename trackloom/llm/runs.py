"""Problem 1: runs of one state in ordered event sequences.

Row numbers within (entity) minus row numbers within (entity, value) stay constant along a run of equal
canonical values; runs are the groups of that difference, aggregated to count and duration.

A sequence is cut into blocks of frames, so that one hot entity is spread over many tasks. Runs inside a
block are final; only the pieces that touch a block's edge (a few per block) go through the same steps
once more and are joined across edges. The result doesn't depend on the block size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tracks import status_name
from ..session import Scratch

BLOCK_FRAMES = 16384
MAX_STEP = 5
KEYS = ["stream_id", "track_id"]


def _pieces(events: DataFrame, keys: list[str], max_step: int) -> DataFrame:
    """Adds ``stretch`` and ``island``: events of one status without a jump, by row-number difference.

    ``events``: keys, status, first_frame, last_frame, base (frame at which the count was nought; null
    where unknown or of no account), part (0, or what must not be joined).
    """
    seq = Window.partitionBy(*keys).orderBy("first_frame")
    jump = F.coalesce(F.col("first_frame") - F.lag("last_frame").over(seq) > max_step, F.lit(False)) | F.coalesce(F.col("part") != F.lag("part").over(seq), F.lit(False))
    stretched = events.withColumn("stretch", F.sum(jump.cast("long")).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "stretch").orderBy("first_frame")
    of_value = Window.partitionBy(*keys, "stretch", "status").orderBy("first_frame")
    return stretched.withColumn("island", F.row_number().over(within) - F.row_number().over(of_value))


def _close(events: DataFrame, keys: list[str], back: F.Column) -> DataFrame:
    """Runs inside the islands: a null base takes the one before, where ``back`` also the one after."""
    of = Window.partitionBy(*keys, "stretch", "status", "island").orderBy("first_frame")
    before = F.last("base", ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("base", ignorenulls=True).over(of.rowsBetween(0, Window.unboundedFollowing))
    filled = events.withColumn("base", F.coalesce(before, F.when(back, after)))
    of_base = Window.partitionBy(*keys, "stretch", "status", "island", "base").orderBy("first_frame")
    return filled.withColumn("run", F.row_number().over(of) - F.row_number().over(of_base))


def runs(tracks: DataFrame, scratch: Scratch, max_step: int = MAX_STEP, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """One row per run of one state: ``stream_id, track_id, status, base, first_frame, last_frame, frames``.

    A run goes on while the status means the same, the frame rises by at most ``max_step`` and, if the
    status isn't ``observed``, the missing count rises as the frame does. A null count fits any: it takes
    the base of the count before it in its stretch of equal status, else of the one after.

    Null keys or frames are left out. Deliveries of one frame count once (the one with a count, then the
    least row_id). An unknown status is a state of its own, by its spelling without case and space. Extra
    columns are ignored; an empty table gives no rows.
    """
    events = tracks.filter(F.col("track_id").isNotNull() & F.col("stream_id").isNotNull() & F.col("frame_index").isNotNull()).select(
        *KEYS, F.floor(F.col("frame_index") / block_frames).alias("block"), F.col("frame_index").alias("first_frame"),
        F.coalesce(status_name(F.col("status")), F.lit("")).alias("status"), F.col("missing_frames").alias("missing"), "row_id",
    )
    keys = [*KEYS, "block"]
    order = Window.partitionBy(*keys).orderBy("first_frame", F.col("missing").asc_nulls_last(), "row_id")
    once = events.withColumn("again", F.coalesce(F.lag("first_frame").over(order) == F.col("first_frame"), F.lit(False))).filter("NOT again")
    once = once.select(
        *keys, "status", "first_frame", F.col("first_frame").alias("last_frame"), F.lit(0).alias("part"),
        F.when(F.col("status") != "observed", F.col("first_frame") - F.col("missing")).alias("base"),
    )
    cut = _pieces(once, keys, max_step)
    block = Window.partitionBy(*keys)
    island = Window.partitionBy(*keys, "stretch", "status", "island")
    cut = cut.withColumn("edge", (F.min("first_frame").over(island) == F.min("first_frame").over(block)) | (F.max("first_frame").over(island) == F.max("first_frame").over(block)))
    local = _close(cut, keys, ~F.col("edge")).groupBy(*keys, "edge", "stretch", "island", "status", "base", "run").agg(
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.count("*").alias("frames")
    )
    local = scratch.cut(local)  # read twice: what lies inside a block, and what touches its edges
    out = [*KEYS, "status", "base", "first_frame", "last_frame", "frames"]
    # Pieces at edges: two islands of one block must not be joined past the runs that lie between them.
    edges = local.filter("edge").select(*out, "block", F.struct("stretch", "island", "status").alias("place"))
    seq = Window.partitionBy(*KEYS).orderBy("first_frame")
    apart = (F.col("block") == F.lag("block").over(seq)) & (F.col("place") != F.lag("place").over(seq))
    edges = edges.withColumn("part", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    joined = _close(_pieces(edges, KEYS, max_step), KEYS, F.lit(True)).groupBy(*KEYS, "stretch", "island", "status", "base", "run").agg(
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.sum("frames").alias("frames")
    )
    return local.filter("NOT edge").select(*out).unionByName(joined.select(*out))


def with_duration(found: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``duration_s``: frames from first to last at the stream's own rate, the slope of ts_s over frame_index; null where a stream has fewer than two times."""
    rate = frames.groupBy("stream_id").agg(F.regr_slope("ts_s", F.col("frame_index").cast("double")).alias("s_per_frame"))
    return found.join(rate, "stream_id", "left").withColumn("duration_s", F.round((F.col("last_frame") - F.col("first_frame")) * F.col("s_per_frame"), 4)).drop("s_per_frame")
