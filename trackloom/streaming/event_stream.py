"""Candidate events as a Structured Streaming operator: keyed state per stream, the same step as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import COLUMNS, EVENTS, Watch, watch_rows

STATE = "active boolean, run bigint, bounced bigint, x double, y double, heights array<double>, last_frame bigint"


class EventProcessor(StatefulProcessor):
    """Frames of a micro-batch are sorted; a frame at or before the last one seen is late and dropped. A frame with a negative width clears the stream's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watch, last = Watch(), None
        if self.state.exists():
            watch.active, watch.run, watch.bounced, x, y, heights, last = self.state.get()
            watch.at = None if x is None else (x, y)
            watch.heights.extend(heights)
        out: list[tuple] = []
        batch = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        for at in range(len(batch)):
            row = batch.iloc[at : at + 1]
            frame = int(row["frame_index"].iloc[0])
            if last is not None and frame <= last:
                continue
            last = frame
            if row["width"].iloc[0] < 0:
                watch.clear()
                continue
            out += watch_rows(watch, row)
        x, y = watch.at or (None, None)
        self.state.update((watch.active, watch.run, watch.bounced, x, y, list(watch.heights), last))
        yield pd.DataFrame(out, columns=["stream_id", "frame_index", "events"])

    def close(self) -> None:
        pass


def event_stream(rows: DataFrame) -> DataFrame:
    """A stream of frames (``stream_id, frame_index, status, cx, cy, width, height, projection_status``) -> their events. Needs the RocksDB state store."""
    return rows.select(*COLUMNS).groupBy("stream_id").transformWithStateInPandas(EventProcessor(), outputStructType=EVENTS, outputMode="Append", timeMode="None")
