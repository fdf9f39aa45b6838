"""The tracker as a Structured Streaming operator: keyed state per stream, the same step as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import SHIPPED, TrackerConfig
from ..operators.tracker import COLUMNS, TRACKS, State, names, step, track_rows

STATE = "rows array<double>, next_id bigint, preferred bigint, last_frame bigint"


class TrackerProcessor(StatefulProcessor):
    """Frames of a micro-batch are sorted; a frame at or before the last one seen is late and dropped.

    State is bounded by ``max_tracks`` and expires by frame count. A frame with a negative width resets the
    stream. Gaps must be rows (a spine): without rows nothing fires.
    """

    def __init__(self, config: TrackerConfig = SHIPPED):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ([], 1, -1, -1)
        state, last = State(np.array(held[0], float).reshape(-1, len(COLUMNS)), held[1], held[2]), held[3]
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("frame_index", kind="stable").itertuples(index=False):
            if r.frame_index <= last:
                continue
            last = r.frame_index
            if r.width < 0:
                state = State(next_id=1)
                continue
            det = np.zeros(0) if r.det is None else np.asarray(r.det, float)
            state, shown, _ = step(state, det, float(r.width), float(r.height), r.dx, r.dy, self.config)
            out.extend(track_rows(key[0], r.frame_index, shown, float(r.width), float(r.height), self.config))
        self.state.update((state.rows.ravel().tolist(), state.next_id, state.preferred, int(last)))
        yield pd.DataFrame(out, columns=names(TRACKS))

    def close(self) -> None:
        pass


def track_stream(spine: DataFrame, config: TrackerConfig = SHIPPED) -> DataFrame:
    """``spine`` (stream_id, frame_index, width, height, dx, dy, det) as a stream -> shown tracks. Needs the RocksDB state store."""
    return spine.groupBy("stream_id").transformWithStateInPandas(TrackerProcessor(config), outputStructType=TRACKS, outputMode="Append", timeMode="None")


def gap_windows(frames: DataFrame, watermark: str = "10 seconds", width: str = "10 seconds") -> DataFrame:
    """Frames per stream and time window of a stream of frames, late ones within the watermark counted."""
    from pyspark.sql import functions as F

    return frames.withWatermark("ingested_at", watermark).groupBy("stream_id", F.window("ingested_at", width)).agg(F.count("*").alias("frames"))
