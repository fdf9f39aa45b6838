"""Derived sequence analytics over tracks: trails, runs of predictions, events, smoothing, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import carried, haloed

KEYS = ["stream_id", "track_id"]


def trails(tracks: DataFrame, length: int = 30) -> DataFrame:
    """Centers of the last ``length`` (at least 2) consecutive frames of each shown track; a trail begins anew after a frame without the track."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    island = tracks.withColumn("_i", F.col("frame_index") - F.row_number().over(w))
    last = Window.partitionBy(*KEYS, "_i").orderBy("frame_index").rowsBetween(-(max(2, length) - 1), 0)
    return island.withColumn("trail", F.collect_list(F.struct("cx", "cy")).over(last)).drop("_i")


def lost(tracks: DataFrame, longest: int = 5) -> DataFrame:
    """``ball_lost`` on each frame of a predicted run beyond ``longest`` frames, and where a track turns absent."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    predicted = F.col("status") == "predicted"
    group = tracks.withColumn("_g", F.sum((~predicted).cast("int")).over(w))
    run = F.sum(F.when(predicted, 1).otherwise(0)).over(Window.partitionBy(*KEYS, "_g").orderBy("frame_index"))
    gone = (F.col("status") == "absent") & (F.lag("status").over(w) != "absent")
    return group.withColumn("run", run).withColumn("ball_lost", F.coalesce((predicted & (F.col("run") > longest)) | gone, F.lit(False))).drop("_g")


def bounce_shape(tracks: DataFrame, half: int = 5) -> DataFrame:
    """Observed rows in the middle of a low point of the picture's y (down is up): y above all before and none after higher, all above nought. A repeated candidate within the least gap is for ``bounces``."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    before, after = w.rowsBetween(-half, -1), w.rowsBetween(1, half)
    seen = tracks.filter("status = 'observed'")
    shape = (F.count("cy").over(before) == half) & (F.count("cy").over(after) == half) & (F.col("cy") > F.max("cy").over(before)) & (F.col("cy") >= F.max("cy").over(after)) & (F.min("cy").over(w.rowsBetween(-half, half)) > 0)
    decided = F.lead("frame_index", half).over(w)
    return seen.withColumn("bounce", shape).withColumn("decided_at", decided).filter("bounce").select(*KEYS, "frame_index", "decided_at", "cy")


def folded(rows: DataFrame, keys: list[str], order: str, values: list[str], schema: str, begin: Callable[[], Callable]) -> DataFrame:
    """A fold along each sequence, in time linear in its length: ``begin()`` gives a fresh function for a sequence, which takes a row's (order, *values) and returns the columns after ``keys, order``, or None to leave the row out.

    Rows come sorted by the shuffle and stream through a task; only the fold's own state is held.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    types = [kinds.get(c.split()[1], pa.list_(pa.string())) for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, take = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            for key, rest in zip(zip(*columns[: len(keys)]), zip(*columns[len(keys) :])):
                if key != current:
                    current, take = key, begin()
                got = take(*rest)
                if got is not None:
                    out.append((*key, rest[0], *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.select(*keys, order, *values).repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(work, schema)


def bounces(tracks: DataFrame, half: int = 5, least_gap: int = 15) -> DataFrame:
    """Candidates at least ``least_gap`` frames after the last one kept, by a fold over a track's few candidates."""

    def begin() -> Callable:
        last: list[int] = []

        def take(at: int) -> tuple | None:
            if last and at - last[0] < least_gap:
                return None
            last[:] = [at]
            return ()

        return take

    shape = bounce_shape(tracks, half).select(*KEYS, F.col("decided_at").alias("frame_index"))
    return folded(shape, KEYS, "frame_index", [], "stream_id string, track_id long, frame_index long", begin)


def smoothed_points(points: DataFrame, keys: list[str], alpha: float = 0.35) -> DataFrame:
    """Exponential mean of x and y along each point's frames (``keys``: stream_id and a whole number); it never expires. Rows without x or y leave it as it is and have no row."""

    def begin() -> Callable:
        at: list[float] = []

        def take(_, x: float | None, y: float | None) -> tuple | None:
            if x is None or y is None:
                return None
            at[:] = [alpha * x + (1 - alpha) * at[0], alpha * y + (1 - alpha) * at[1]] if at else [x, y]
            return tuple(at)

        return take

    return folded(points, keys, "frame_index", ["x", "y"], f"{keys[0]} string, {keys[1]} long, frame_index long, sx double, sy double", begin)


def leave_side(tracks: DataFrame, frames: DataFrame, margin: float = 12.0) -> DataFrame:
    """The side of the picture at which a track was last seen before it turned absent; left, right, top, bottom in that order, null inside."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    last_x, last_y = (F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for c in ("cx", "cy"))
    turned = (F.col("status") == "absent") & (F.lag("status").over(w) != "absent")
    gone = tracks.withColumns({"px": last_x, "py": last_y, "_t": turned}).filter("_t").join(frames.select("stream_id", "frame_index", "width", "height"), ["stream_id", "frame_index"])
    side = F.when(F.col("px") <= margin, "left").when(F.col("px") >= F.col("width") - margin, "right").when(F.col("py") <= margin, "top").when(F.col("py") >= F.col("height") - margin, "bottom")
    return gone.select(*KEYS, "frame_index", side.alias("side"))


def measured_velocity(tracks: DataFrame) -> DataFrame:
    """Center against the observed one before, per frame between them."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index")
    gap = F.greatest(F.lit(1), F.col("frame_index") - F.lag("frame_index").over(w))
    return tracks.filter("status = 'observed'").select(*KEYS, "frame_index", ((F.col("cx") - F.lag("cx").over(w)) / gap).alias("mvx"), ((F.col("cy") - F.lag("cy").over(w)) / gap).alias("mvy"))


def smoothed(tracks: DataFrame, window: int = 3) -> DataFrame:
    """Mean of the last ``window`` centers, predicted ones too."""
    w = Window.partitionBy(*KEYS).orderBy("frame_index").rowsBetween(-(window - 1), 0)
    return tracks.select(*KEYS, "frame_index", F.avg("cx").over(w).alias("mx"), F.avg("cy").over(w).alias("my"))


def cached(values: DataFrame, value: str, longest: int = 30) -> DataFrame:
    """A homography (or any value) that is used again for up to ``longest`` frames: status homography, cached or unavailable; none before the first."""
    held = carried(values, ["stream_id"], "frame_index", F.when(F.col(value).isNotNull(), F.struct(F.col("frame_index").alias("at"), F.col(value).alias("v"))), "_held")
    age = F.col("frame_index") - F.col("_held.at")
    status = F.when(F.col("_held").isNull(), "none").when(age == 0, "homography").when(age <= longest, "cached").otherwise("unavailable")
    return held.withColumn("used", F.when(age <= longest, F.col("_held.v"))).withColumn("projection_status", status).drop("_held")


def rolling_rate(frames: DataFrame, length: int = 30) -> DataFrame:
    """``fps``: mean of the last ``length`` rates from frame to frame; frames without a time are left out, steps that don't rise count for nothing."""
    timed = frames.filter("ts_s IS NOT NULL").select("stream_id", "frame_index", "ts_s")
    spread, keys = haloed(timed, ["stream_id"], "frame_index", length)
    w = Window.partitionBy(*keys).orderBy("frame_index")
    step = F.col("ts_s") - F.lag("ts_s").over(w)
    rated = spread.withColumn("_r", F.when(step > 0, 1 / step))
    return rated.withColumn("fps", F.avg("_r").over(w.rowsBetween(-(length - 1), 0))).filter("NOT halo").select("stream_id", "frame_index", "fps")


def kalman_smooth(tracks: DataFrame, process_noise: float = 12.0, measurement_noise: float = 4.0) -> DataFrame:
    """Constant-velocity filter along each track: positions after each frame, predicted where nothing was observed; null until something was. Covariance is shared by both axes."""
    q, r = process_noise**2, measurement_noise**2

    def begin() -> Callable:
        state: list[float] = []

        def take(_, mx: float | None, my: float | None) -> tuple:
            if not state:
                if mx is not None:
                    state[:] = [mx, my, 0.0, 0.0, 100.0, 0.0, 100.0]
                return mx, my
            x, y, vx, vy, a, b, c = state
            x, y, a, b, c = x + vx, y + vy, a + 2 * b + c + q / 4, b + c + q / 2, c + q
            if mx is not None:
                g, k = a / (a + r), b / (a + r)
                x, y, vx, vy = x + g * (mx - x), y + g * (my - y), vx + k * (mx - x), vy + k * (my - y)
                a, b, c = a * r / (a + r), b * r / (a + r), c - b * k
            state[:] = [x, y, vx, vy, a, b, c]
            return x, y

        return take

    return folded(tracks, KEYS, "frame_index", ["cx", "cy"], "stream_id string, track_id long, frame_index long, sx double, sy double", begin)
