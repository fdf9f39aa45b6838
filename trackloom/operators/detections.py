"""Detection post-processing: filters, tiers, top-k, greedy suppression, sampling, raw output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inside
from .blocks import numbered

FRAME = ["stream_id", "frame_index"]


def distinct(detections: DataFrame) -> DataFrame:
    """Deliveries of one detection once: the least source of each (stream, frame, det_idx)."""
    w = Window.partitionBy(*FRAME, "det_idx").orderBy(F.asc_nulls_last("source"), "x1", "y1")
    return detections.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def keep(detections: DataFrame, class_id: int = 0, threshold: float = 0.15, exclude: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Confidence at least the threshold, the wanted class, center not in the excluded region (edges belong to it)."""
    out = detections.filter((F.col("confidence") >= threshold) & (F.col("class_id") == class_id))
    return out.filter(~inside(F.col("cx"), F.col("cy"), exclude)) if exclude else out


def tiers(detections: DataFrame, high: float, low: float) -> DataFrame:
    return detections.withColumn("tier", F.when(F.col("confidence") >= high, "high").when(F.col("confidence") >= low, "low").otherwise("none"))


def top_k(detections: DataFrame, k: int) -> DataFrame:
    """The k most confident of each frame; ties by det_idx."""
    return detections.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "det_idx"))).filter(F.col("rank") <= k)


_BOX = "named_struct('o', -confidence, 'det_idx', det_idx, 'x1', x1, 'y1', y1, 'x2', x2, 'y2', y2, 'cx', cx, 'cy', cy, 'confidence', confidence)"
_INTER = "greatest(0D, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0D, least(k.y2, b.y2) - greatest(k.y1, b.y1))"
_AREAS = "greatest(0D, k.x2 - k.x1) * greatest(0D, k.y2 - k.y1) + greatest(0D, b.x2 - b.x1) * greatest(0D, b.y2 - b.y1)"


def _greedy(detections: DataFrame, clash: str) -> DataFrame:
    """Most confident first; a box that clashes with any kept one goes. One fold over a frame's few boxes, on the JVM."""
    boxes = detections.groupBy(*FRAME).agg(F.expr(f"array_sort(collect_list({_BOX}))").alias("boxes"))
    kept = f"aggregate(boxes, slice(boxes, 1, 0), (kept, b) -> if(exists(kept, k -> {clash}), kept, concat(kept, array(b))))"
    return boxes.select(*FRAME, F.expr(f"inline({kept})")).drop("o")


def deduplicate(detections: DataFrame, iou: float = 0.20, center_scale: float = 0.75, center_px: float = 6.0) -> DataFrame:
    """Greedy suppression by overlap (at least ``iou``) or center distance (at most the larger of ``center_px`` and ``center_scale`` times the longest side)."""
    side = "greatest(1D, k.x2 - k.x1, k.y2 - k.y1, b.x2 - b.x1, b.y2 - b.y1)"
    over = f"({_INTER}) >= {iou}D * (({_AREAS}) - ({_INTER})) AND ({_AREAS}) - ({_INTER}) > 0"
    return _greedy(detections, f"({over}) OR sqrt(pow(k.cx - b.cx, 2) + pow(k.cy - b.cy, 2)) <= greatest({center_px}D, {center_scale}D * {side})")


def nms(detections: DataFrame, iou: float = 0.5) -> DataFrame:
    """Non-maximum suppression: boxes that overlap a kept one by more than ``iou`` go."""
    return _greedy(detections, f"({_INTER}) > {iou}D * (({_AREAS}) - ({_INTER}))")


def sampled(frames: DataFrame, interval: int) -> DataFrame:
    """``detector_skipped``: the detector runs on every interval-th processed frame of a stream, counted, not by index."""
    return numbered(frames.select(*FRAME), ["stream_id"], "frame_index").select(*FRAME, ((F.col("n") - 1) % max(1, interval) != 0).alias("detector_skipped"))


def none(frames: DataFrame) -> DataFrame:
    """The detector that finds nothing: no rows, with the columns of detections."""
    return frames.select(*FRAME, *[F.lit(None).cast(t).alias(n) for n, t in (("det_idx", "int"), *((c, "double") for c in ("x1", "y1", "x2", "y2", "cx", "cy", "confidence")), ("source", "string"), ("class_id", "int"))]).filter(F.lit(False))


DETECTIONS = "stream_id string, frame_index long, det_idx int, x1 double, y1 double, x2 double, y2 double, cx double, cy double, confidence double, source string, class_id int"
BACKENDS: dict[str, Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]] = {"null": lambda: lambda rows: rows.iloc[:0]}


def detect(frames: DataFrame, backend: str | Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], source: str = "detector") -> DataFrame:
    """Detections of a pluggable detector over batches of ``frames`` (any columns). ``backend`` is a name in ``BACKENDS`` (``null`` finds nothing; others are for the user to add) or a function that is called once a task, to load what it needs, and gives a function from a batch of frames to its boxes.

    Boxes: stream_id, frame_index, x1, y1, x2, y2, confidence, class_id; center, det_idx (in the order given) and source are added. An unknown name fails.
    """
    if isinstance(backend, str):
        if backend not in BACKENDS:
            raise ValueError(f"unknown detector {backend!r}, known: {sorted(BACKENDS)}")
        backend = BACKENDS[backend]
    names = [c.split()[0] for c in DETECTIONS.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = backend()
        for rows in batches:
            out = found(rows)
            if len(out):
                number = out.groupby(["stream_id", "frame_index"], sort=False).cumcount()
                yield out.assign(det_idx=number, cx=(out["x1"] + out["x2"]) / 2, cy=(out["y1"] + out["y2"]) / 2, source=source)[names]

    return frames.mapInPandas(work, DETECTIONS)


def guarded(detections: DataFrame, failed: DataFrame, strict: bool = True) -> DataFrame:
    """Detections of a detector that fails: from a stream's first failure on (stream_id, frame_index in ``failed``) it gives nothing more. ``strict`` stops the run at a failure instead."""
    first = failed.groupBy("stream_id").agg(F.min("frame_index").alias("_off"))
    joined = detections.join(first, "stream_id", "left")
    if strict:
        stop = F.when(F.col("_off").isNotNull(), F.raise_error(F.concat(F.lit("the detector failed in "), "stream_id"))).otherwise(F.lit(True))
        return joined.filter(stop).drop("_off")
    return joined.filter("_off IS NULL OR frame_index < _off").drop("_off")


def as_rows(heads: DataFrame) -> DataFrame:
    """Raw two-dimensional outputs (stream_id, frame_index, ``head`` array<array<double>>) -> one row per candidate: ``row, output``.

    Rows of six are finished candidates; else a head with fewer rows than columns, and at most 256 of them, has
    candidates in its columns and is turned. A dimension of one around the head must be gone.
    """
    rows, columns = F.size("head"), F.size(F.get("head", F.lit(0)))
    turned = (columns != 6) & (rows < columns) & (rows <= 256)
    across = F.expr("transform(sequence(0, size(head[0]) - 1), c -> transform(head, r -> r[c]))")
    return heads.filter("size(head) > 0").select(*FRAME, F.posexplode(F.when(turned, across).otherwise(F.col("head"))).alias("row", "output"))


def decode_scores(raw: DataFrame, threshold: float) -> DataFrame:
    """Rows (stream, frame, row, output array): six numbers are box, confidence, class; more are x, y, w, h and class scores, of which the first largest counts. Fewer than five fail."""
    scores = F.slice("output", F.lit(5), F.size("output") - 4)
    best = F.array_max(scores)
    done = F.size("output") == 6
    o = lambda i: F.get("output", F.lit(i))
    checked = F.when(F.size("output") < 5, F.raise_error("an output row has fewer than five numbers")).otherwise(0)
    out = raw.select(
        *FRAME, "row", checked.alias("_ok"), *[F.when(done, o(i)).otherwise(e).alias(n) for i, (n, e) in enumerate([("x1", o(0) - o(2) / 2), ("y1", o(1) - o(3) / 2), ("x2", o(0) + o(2) / 2), ("y2", o(1) + o(3) / 2)])],
        F.when(done, o(4)).otherwise(best).alias("confidence"), F.when(done, o(5)).otherwise(F.array_position(scores, best) - 1).cast("int").alias("class_id"),
    )
    return out.filter((F.col("_ok") == 0) & (F.col("confidence") >= threshold)).drop("_ok")
