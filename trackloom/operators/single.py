"""The single-object tracker: one ball per stream, nearest detection within a jump, short gaps predicted."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK
from .tracker import names, pieced, spine

OUTPUT = "stream_id string, frame_index long, status string, cx double, cy double, confidence double, vx double, vy double, missing_frames int, drop_reason string"


class Ball:
    """State of one stream. After a loss the next detection counts whatever its place, and meets the old filter state."""

    def __init__(self, least: float = 0.25, jump: float = 180.0, horizon: int = 3, window: int = 3, process: float = 15.0, measurement: float = 2.0):
        self.least, self.jump, self.horizon, self.q, self.r = least, jump, horizon, process**2, measurement**2
        self.state: list[float] | None = None  # x, y, vx, vy and the covariance that both axes share
        self.history: deque = deque(maxlen=window)
        self.missing, self.confidence = 0, 0.0

    def predict(self) -> None:
        x, y, vx, vy, a, b, c = self.state
        self.state = [x + vx, y + vy, vx, vy, a + 2 * b + c + self.q / 4, b + c + self.q / 2, c + self.q]

    def absorb(self, mx: float, my: float) -> None:
        if self.state is None:
            self.state = [mx, my, 0.0, 0.0, 100.0, 0.0, 100.0]
            return
        x, y, vx, vy, a, b, c = self.state
        g, k = a / (a + self.r), b / (a + self.r)
        self.state = [x + g * (mx - x), y + g * (my - y), vx + k * (mx - x), vy + k * (my - y), (1 - g) * a, (1 - g) * b, c - k * b]

    def frame(self, det: np.ndarray) -> tuple:
        good = det[det[:, 4] >= self.least]
        reason, pick = ("no_detection" if not len(det) else "low_conf" if not len(good) else None), None
        if len(good) and not self.history:
            pick = good[good[:, 4].argmax()]
        elif len(good):
            far = np.hypot(good[:, 0] - self.state[0], good[:, 1] - self.state[1])
            if far.min() <= self.jump:
                pick = good[far.argmin()]
            else:
                reason = "large_jump"
        if pick is not None:
            if self.history:
                self.predict()
            self.absorb(pick[0], pick[1])
            self.missing, self.confidence = 0, float(pick[4])
            self.history.append(self.state[:2])
            return "observed", *np.mean(self.history, 0).tolist(), self.confidence, *self.state[2:4], 0, None
        if not self.history:
            self.missing = 0
            return "absent", None, None, 0.0, None, None, 0, reason
        self.missing += 1
        if self.missing > self.horizon:
            self.history.clear()
            return "absent", None, None, 0.0, None, None, self.missing, reason
        self.predict()
        self.history.append(self.state[:2])
        faded = self.confidence * max(0.0, 1 - self.missing / (self.horizon + 1))
        return "predicted", *np.mean(self.history, 0).tolist(), faded, *self.state[2:4], self.missing, reason


def run(frames: DataFrame, detections: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per frame: observed, predicted or absent, the smoothed center and why no detection was taken.

    The filter's state outlives a loss (the next detection is blended with it), so a stream can't be cut where
    the ball is lost: the longest stream bounds the run time. Only frames with a usable detection, or up to
    ``horizon`` frames after one, take part in the fold; the others are absent and spread by blocks.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ball, current = None, None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if ball is None or (r.stream_id, r.piece) != current:
                    ball, current = Ball(), (r.stream_id, r.piece)
                det = np.zeros((0, 5)) if r.det is None else np.asarray(r.det, float).reshape(-1, 5)
                rows.append((r.stream_id, r.frame_index, *ball.frame(det)))
            if rows:
                yield pd.DataFrame(rows, columns=names(OUTPUT))

    fields = Ball()
    laid = pieced(spine(frames, detections), fields.horizon + 1, fields.least, block).drop("det_conf")
    # Pieces of one stream share the filter's state: all that isn't idle is one piece.
    laid = laid.withColumn("piece", F.when(F.col("piece") >= 0, 0).otherwise(F.col("piece")))
    return laid.repartition("stream_id", "piece").sortWithinPartitions("stream_id", "piece", "frame_index").mapInPandas(work, OUTPUT)
