"""Latency, throughput, gates and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency(timings: DataFrame, warmup: int = 20, by: list[str] | None = None) -> DataFrame:
    """mean, p50, p95 (linear interpolation) and frames a second of ``ms`` from ``frame_index`` >= warmup on."""
    agg = [F.avg("ms").alias("mean_ms"), F.percentile("ms", F.lit(0.5)).alias("p50_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"), (1000 / F.avg("ms")).alias("fps")]
    return timings.filter(F.col("frame_index") >= warmup).groupBy(*(by or [])).agg(*agg)


def latency_report(timings: DataFrame, warmup: int = 20, by: list[str] | None = None) -> DataFrame:
    """Figures of the pipeline (``ms``) from ``frame_index`` >= warmup on, and of the detector (``detector_ms``) over those of them it wasn't skipped on; 0 where it never ran."""
    ran = F.when(~F.col("detector_skipped"), F.col("detector_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = F.avg("ms")
    return timings.filter(F.col("frame_index") >= warmup).groupBy(*(by or [])).agg(
        F.count("ms").alias("measured_frames"), mean.alias("pipeline_ms_mean"), F.percentile("ms", F.lit(0.5)).alias("pipeline_ms_p50"), F.percentile("ms", F.lit(0.95)).alias("pipeline_ms_p95"), (1000 / mean).alias("throughput_fps"),
        zero(F.avg(ran)).alias("detector_ms_mean"), zero(F.percentile(ran, F.lit(0.95))).alias("detector_ms_p95"),
    )


def throughput(frames: DataFrame) -> DataFrame:
    """Frames, seconds from the first to the last time, and frames a second of each stream; null without two times."""
    span = F.max("ts_s") - F.min("ts_s")
    return frames.groupBy("stream_id").agg(F.count("*").alias("processed"), span.alias("elapsed_s"), F.when(span > 0, F.count("*") / span).alias("fps"))


def stream_metadata(frames: DataFrame) -> DataFrame:
    """One row a stream, as its container would state it: frames, first and last index, picture size (the most frequent), and rate by the slope of time over index; 30 where there are no two times."""
    sizes = frames.groupBy("stream_id", "width", "height").agg(F.count("*").alias("n")).groupBy("stream_id").agg(F.max_by(F.struct("width", "height"), F.struct("n", "width", "height")).alias("s"))
    slope = F.regr_slope("ts_s", F.col("frame_index").cast("double"))
    own = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.when(slope > 0, 1 / slope).otherwise(30.0).alias("fps"))
    return own.join(sizes, "stream_id").select("stream_id", "frames", "first_frame", "last_frame", "s.width", "s.height", "fps")


def compare(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two trackers (keys ``by``, frame_index, x, y; one row a frame) side by side: frames that both, only one or the other have, and how far apart they are."""
    both = a.select(*by, "frame_index", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select(*by, "frame_index", F.col("x").alias("bx"), F.col("y").alias("by")), [*by, "frame_index"], "full")
    in_a, in_b = F.col("ax").isNotNull(), F.col("bx").isNotNull()
    far = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return both.groupBy(*by).agg(F.count_if(in_a & in_b).alias("both"), F.count_if(in_a & ~in_b).alias("only_a"), F.count_if(in_b & ~in_a).alias("only_b"), F.avg(far).alias("mean_distance"), F.max(far).alias("max_distance"))


def stop_at_failure(runs: DataFrame, fail_fast: bool) -> DataFrame:
    """Runs (position, stream_id, status) of a batch as its policy leaves them: all of them, or up to the first failure (the others are ``not_run``)."""
    if not fail_fast:
        return runs
    first = runs.filter("status = 'failed'").agg(F.min("position").alias("_stop"))
    return runs.crossJoin(F.broadcast(first)).withColumn("status", F.when(F.col("position") > F.col("_stop"), "not_run").otherwise(F.col("status"))).drop("_stop")


def run_metadata(report: DataFrame, values: dict[str, str | int | float | bool | None]) -> DataFrame:
    """One JSON line per row of a benchmark or export report, with the run's own values (paths, sizes, arguments) and when it was made (UTC)."""
    own = [F.lit(v).alias(k) for k, v in values.items()]
    made = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at")
    return report.select(F.to_json(F.struct(made, *own, *report.columns), {"ignoreNullFields": "false"}).alias("value"))


def gate(current: DataFrame, baseline: DataFrame, map50_drop: float = 0.015, recall_drop: float = 0.02) -> DataFrame:
    """Joins two tables of (model, map50, recall); a drop beyond a limit rejects. Missing figures count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = current.alias("c").join(baseline.alias("b"), "model")
    drops = both.select("model", (zero(F.col("b.map50")) - zero(F.col("c.map50"))).alias("map50_drop"), (zero(F.col("b.recall")) - zero(F.col("c.recall"))).alias("recall_drop"))
    return drops.withColumn("accepted", ~((F.col("map50_drop") > map50_drop) | (F.col("recall_drop") > recall_drop)))


def todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Streams that lack an output: both outputs must stand in ``done`` (stream_id, kind)."""
    whole = done.groupBy("stream_id").agg(F.countDistinct("kind").alias("n")).filter("n >= 2")
    return wanted.join(whole, "stream_id", "left_anti")


def frame_counts(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Detections per frame before and after suppression."""
    a = raw.groupBy("stream_id", "frame_index").agg(F.count("*").alias("raw"))
    b = kept.groupBy("stream_id", "frame_index").agg(F.count("*").alias("kept"))
    return a.join(b, ["stream_id", "frame_index"], "left").select("stream_id", "frame_index", "raw", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("raw") - F.coalesce("kept", F.lit(0))).alias("removed"))


def status_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("stream_id", "frame_index").agg(F.count_if(F.col("status") == "observed").alias("observed"), F.count_if(F.col("status") == "predicted").alias("predicted"))


def best_detection(detections: DataFrame) -> DataFrame:
    """The most confident detection of each frame, the first on ties."""
    best = F.max_by(F.struct("det_idx", "cx", "cy", "confidence"), F.struct("confidence", -F.col("det_idx")))
    return detections.groupBy("stream_id", "frame_index").agg(best.alias("b")).select("stream_id", "frame_index", "b.*")


def batch_summary(runs: DataFrame) -> DataFrame:
    """Succeeded, skipped and failed runs of (stream_id, status), and the exit code: 1 if any failed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "skipped", "failed")]
    return runs.agg(*counts, F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("exit_code"))
