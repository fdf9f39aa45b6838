"""Blocks, folds and events on drawn sequences, whatever the block size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import blocks, detections, events, metrics, sequences


def drawn(seed, n=300):
    rng = random.Random(seed)
    return [(s, f, rng.random() if rng.random() < 0.2 else None, "x", 5) for s in "ab" for f in sorted(rng.sample(range(-50, 900), n))]


SCHEMA = "stream_id string, frame_index long, v double, _block string, n int"


@pytest.mark.parametrize("block", [1, 7, 100, 16384])
def test_blocks_change_nothing(spark, block):
    rows = drawn(3)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).drop("_block", "n")
    place = {(r.stream_id, r.frame_index): r.n for r in blocks.numbered(df, ["stream_id"], "frame_index", "n", block).collect()}
    last = {(r.stream_id, r.frame_index): r.w for r in blocks.carried(df, ["stream_id"], "frame_index", F.col("v"), "w", block).collect()}
    spread, keys = blocks.haloed(df, ["stream_id"], "frame_index", 3, block)
    own = [r for r in spread.collect() if not r.halo]
    for s in "ab":
        mine, held = sorted(r[1:3] for r in rows if r[0] == s), None
        for i, (f, v) in enumerate(mine):
            held = v if v is not None else held
            assert place[s, f] == i + 1 and last[s, f] == held
    assert len(own) == len(rows) and keys == ["stream_id", "part"]
    by = {}
    for r in spread.collect():
        by.setdefault((r.stream_id, r.part), []).append((r.frame_index, r.halo))
    for (s, _), part in by.items():
        if all(halo for _, halo in part):  # behind the last block
            continue
        part.sort()
        frames = sorted(r[1] for r in rows if r[0] == s)
        at = [frames.index(f) for f, _ in part]
        assert at == list(range(at[0], at[-1] + 1)) and sum(h for _, h in part) == min(3, at[[h for _, h in part].index(False)])
    assert blocks.numbered(df.limit(0), ["stream_id"], "frame_index").count() == 0 and blocks.carried(df.limit(0), ["stream_id"], "frame_index", F.col("v"), "w").count() == 0


def test_filter_is_linear_and_right(spark):
    rng = random.Random(2)
    rows = [("s", t, f, rng.gauss(5 * f, 1) if rng.random() < 0.7 else None) for t in (1, 2) for f in range(400)]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "stream_id string, track_id long, frame_index long, cx double, cy double")
    got = {(r.track_id, r.frame_index): r.sx for r in sequences.kalman_smooth(df).collect()}
    for t in (1, 2):
        m, p, q, r = None, np.eye(2) * 100, 144 * np.array([[0.25, 0.5], [0.5, 1]]), 16
        a = np.array([[1.0, 1], [0, 1]])
        for _, track, f, z in rows:
            if track != t:
                continue
            if m is None:
                m = None if z is None else np.array([z, 0.0])
            else:
                m, p = a @ m, a @ p @ a.T + q
                if z is not None:
                    k = p[:, 0] / (p[0, 0] + r)
                    m, p = m + k * (z - m[0]), p - np.outer(k, p[0])
            assert got[t, f] == pytest.approx(None if m is None else m[0], abs=1e-6)
    assert sequences.kalman_smooth(df.limit(0)).count() == 0 and sequences.smoothed_points(df.limit(0).withColumnsRenamed({"cx": "x", "cy": "y"}), ["stream_id", "track_id"]).count() == 0


FRAMES = "stream_id string, frame_index long, status string, cx double, cy double, width int, height int, projection_status string"


def scene():
    y = [10, 20, 30, 40, 50, 60, 50, 40, 30, 20, 10, 9]
    rows = [("s", i, "observed", 100.0, float(v), 640, 480, "homography") for i, v in enumerate(y)]
    rows += [("s", 12 + i, "predicted", 5.0, 20.0, 640, 480, "cached") for i in range(7)]
    rows += [("s", 19, "absent", None, None, 640, 480, "unavailable"), ("s", 20, "absent", None, None, 640, 480, None), ("s", 21, None, None, None, 640, 480, None), ("s", 22, "observed", 1.0, float("nan"), 640, 480, "none")]
    return rows


def test_events(spark):
    df = spark.createDataFrame(scene(), FRAMES)
    got = {r.frame_index: r.events for r in events.events(df).collect()}
    assert got[9] == ["ball_seen"] and got[10] == ["ball_seen", "bounce_candidate"] and got[11] == ["ball_seen"]
    assert got[16] == [] and got[17] == got[18] == ["ball_lost"] and got[19] == ["ball_lost", "leave_view_left", "projection_unavailable"] and got[20] == ["projection_unavailable"] and got[21] == ["ball_missing"] and got[22] == ["ball_seen", "projection_unavailable"]
    flags = {r.frame_index: (r.seen, r.missing, r.projection_unavailable) for r in events.flags(df).collect()}
    assert flags[0] == (True, False, False) and flags[21] == (False, True, False) and flags[20] == (False, False, True)
    assert events.events(df.limit(0)).count() == 0


def test_event_stream_equals_batch(spark, tmp_path):
    from trackloom.streaming.event_stream import event_stream

    df = spark.createDataFrame(scene(), FRAMES)
    for part, keep in enumerate(("frame_index < 8", "frame_index >= 8")):
        df.filter(keep).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={part}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = event_stream(source).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("told").collect())) == sorted(map(tuple, events.events(df).collect()))


def test_small_operators(spark):
    f = spark.createDataFrame([("s", 0, 0.0), ("s", 1, 0.5), ("t", 0, None)], "stream_id string, frame_index long, ts_s double")
    assert {r.stream_id: r.fps for r in metrics.throughput(f).collect()} == {"s": 4.0, "t": None}
    assert detections.none(f).count() == 0 and metrics.throughput(f.limit(0)).count() == 0
    heads = spark.createDataFrame([("s", 0, [[1.0, 2.0, 3.0]] * 2), ("s", 1, [[1.0] * 6, [2.0] * 6]), ("s", 2, []), ("s", 3, None)], "stream_id string, frame_index long, head array<array<double>>")
    assert sorted((r.frame_index, r.row, r.output) for r in detections.as_rows(heads).collect()) == [(0, 0, [1.0, 1.0]), (0, 1, [2.0, 2.0]), (0, 2, [3.0, 3.0]), (1, 0, [1.0] * 6), (1, 1, [2.0] * 6)]
    d, failed = f.select("stream_id", "frame_index"), spark.createDataFrame([("s", 1)], "stream_id string, frame_index long")
    assert sorted(map(tuple, detections.guarded(d, failed, False).collect())) == [("s", 0), ("t", 0)]
    with pytest.raises(Exception, match="failed in s"):
        detections.guarded(d, failed).collect()
    runs = spark.createDataFrame([(1, "a", "succeeded"), (2, "b", "failed"), (3, "c", "failed")], "position int, stream_id string, status string")
    assert sorted(r.status for r in metrics.stop_at_failure(runs, True).collect()) == ["failed", "not_run", "succeeded"] and metrics.stop_at_failure(runs, False) is runs
    line = metrics.run_metadata(runs.limit(1), {"model": "m", "size": 3}).first().value
    assert '"model":"m"' in line and '"created_at":"2' in line
    a = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 1, 0.0, 0.0)], "stream_id string, frame_index long, x double, y double")
    b = spark.createDataFrame([("s", 0, 3.0, 4.0), ("s", 2, 0.0, 0.0)], "stream_id string, frame_index long, x double, y double")
    assert tuple(metrics.compare(a, b, ["stream_id"]).first()) == ("s", 1, 1, 1, 5.0, 5.0)
    times = spark.createDataFrame([(i, float(i), 2.0, i % 2 == 0) for i in range(10)], "frame_index long, ms double, detector_ms double, detector_skipped boolean")
    r = metrics.latency_report(times, 5).first()
    assert r.measured_frames == 5 and r.pipeline_ms_mean == 7 and r.detector_ms_mean == 2
    box = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 8.0, 5.0, 5.0), (9, None, None, None, None, 5.0, 6.0)], "id long, x1 double, y1 double, x2 double, y2 double, cx double, cy double")
    c = [F.col(n) for n in ("id", "x1", "y1", "x2", "y2", "cx", "cy")]
    u, v = G.anchor(c[1], c[3], c[4], c[5], c[6])
    colour, radius = G.marker(*c[:5])
    assert sorted(map(tuple, box.select(u, v, colour, radius, G.timestamp(c[0], F.lit(0.0))).collect())) == [(5.0, 6.0, 1, 7, 9 / 30), (20.0, 8.0, 0, 15, 1 / 30)]
