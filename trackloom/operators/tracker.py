"""Multi-object tracking: one pure step per frame, shared by the grouped-map and the streaming driver.

State of a stream is a table of tracks, one NumPy column per field; a step moves all tracks at once and
resolves the one-to-one matches greedily by cost. Inside a stream the state is sequential, but it is empty
once no detection was kept for longer than a track can be missing: there a stream is cut into pieces, which
are the unit of parallelism. Ids are counted in each piece and moved on by the tracks made before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SHIPPED, TrackerConfig
from ..session import Scratch
from .blocks import BLOCK

COLUMNS = ("id", "x", "y", "vx", "vy", "pa", "pb", "pc", "w", "h", "conf", "age", "hits", "missing", "seen", "lx", "ly", "ax", "ay", "af", "rx", "ry", "rf", "moving", "still")
INDEX = {name: i for i, name in enumerate(COLUMNS)}
TRACKS = (
    "stream_id string, frame_index long, track_id long, status string, cx double, cy double, x1 double, y1 double, x2 double, y2 double, confidence double, vx double, vy double, "
    "missing_frames int, source string, age int, hits int, confirmed boolean, motion_confirmed boolean, stationary_frames int"
)
COUNTS = (
    "input_detections", "high_conf_detections", "low_conf_detections", "high_conf_matches", "low_conf_recoveries", "created_tracks", "removed_tracks", "retained_tracks", "emitted_tracks", "eligible_tracks",
    "output_limited_tracks", "physical_gate_rejections", "impact_recoveries", "motion_unconfirmed_tracks", "stationary_suppressed_tracks",
)
STATES = "array<struct<track_id:long,center:array<double>,velocity:array<double>,missing_frames:int,motion_confirmed:boolean,observed_this_frame:boolean>>"
# What a piece gives: shown tracks (kind T), one row of counts a frame (D) and at its end the tracks made (E, in track_id).
PIECES = f"kind string, piece long, {TRACKS}, " + ", ".join(f"{c} int" for c in COUNTS) + f", camera_motion_dx double, camera_motion_dy double, track_states {STATES}"


@dataclass
class State:
    """Tracks of one stream (rows of ``COLUMNS``), the next id and the track that was shown last."""

    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, len(COLUMNS))))
    next_id: int = 1
    preferred: int = -1


def _col(rows: np.ndarray, name: str) -> np.ndarray:
    return rows[:, INDEX[name]]


def _match(rows: np.ndarray, which: np.ndarray, det: np.ndarray, s: float, c: TrackerConfig) -> tuple[list[tuple[int, int, bool]], int]:
    """Greedy one-to-one matches (track, detection, impact) of the tracks ``which`` with detections (cx, cy, w, h, conf), and how many pairs were too fast."""
    if not len(which) or not len(det):
        return [], 0
    t = rows[which]
    get = lambda name: t[:, INDEX[name]][:, None]
    dx, dy, conf = det[:, 0][None], det[:, 1][None], det[:, 4][None]
    speed, elapsed = np.hypot(get("vx"), get("vy")), np.maximum(1, get("missing") + 1)
    gate = np.minimum(c.max_gate_px * s, c.base_gate_px * s + speed * c.velocity_gate_scale + get("missing") * c.gate_growth_px * s)
    gate = np.where(get("hits") < c.min_hits, np.maximum(gate, c.tentative_gate_px * s), gate)
    far, step = np.hypot(dx - get("x"), dy - get("y")), np.hypot(dx - get("lx"), dy - get("ly"))
    too_fast = step > c.max_speed_px_per_frame * s * elapsed if c.max_speed_px_per_frame > 0 else np.zeros(far.shape, bool)
    reach = np.minimum(1.5 * c.impact_recovery_gate_px, c.impact_recovery_gate_px + elapsed * c.gate_growth_px) * s
    impact = (far > gate) & (get("moving") > 0) & (conf >= c.high_conf) & (np.maximum(speed, step / elapsed) >= c.impact_recovery_min_speed_px * s) & (step <= reach)
    size = np.abs(np.log(np.maximum(det[:, 2], 1)[None] / np.maximum(get("w"), 1))) + np.abs(np.log(np.maximum(det[:, 3], 1)[None] / np.maximum(get("h"), 1)))
    cost = np.where(impact, 1 + step / np.maximum(reach, 1), far / np.maximum(gate, 1)) + 0.08 * size - 0.10 * conf
    ti, di = np.nonzero(((far <= gate) | impact) & ~too_fast)
    free_t, free_d, out = np.ones(len(which), bool), np.ones(len(det), bool), []
    for k in np.lexsort((di, ti, cost[ti, di])):
        a, b = ti[k], di[k]
        if free_t[a] and free_d[b]:
            free_t[a] = free_d[b] = False
            out.append((int(which[a]), int(b), bool(impact[a, b])))
    return out, int(too_fast.sum())


def _absorb(rows: np.ndarray, matches: list[tuple[int, int, bool]], det: np.ndarray, s: float, c: TrackerConfig) -> None:
    """Update the matched tracks with their detections, all at once."""
    if not matches:
        return
    k, d, impact = (np.array(x) for x in zip(*matches))
    t, m = rows[k], det[d]
    v = {name: t[:, i] for name, i in INDEX.items()}
    cx, cy = m[:, 0], m[:, 1]
    elapsed = np.maximum(1, v["missing"] + 1)
    measured = (cx - v["lx"]) / elapsed, (cy - v["ly"]) / elapsed
    v["af"] += elapsed
    v["rf"] += elapsed
    moved = np.ones(len(k), bool)
    for px, py, frames in (("ax", "ay", "af"), ("rx", "ry", "rf")):
        gone = np.hypot(cx - v[px], cy - v[py])
        moved &= (gone > c.motion_threshold_px * s) & (gone / np.maximum(v[frames], 1) >= c.min_motion_speed_px * s)
    v["moving"][moved] = 1
    v["still"][:] = np.where(moved, 0, v["still"] + 1)
    for px, py, frames in (("ax", "ay", "af"), ("rx", "ry", "rf")):
        v[px][moved], v[py][moved], v[frames][moved] = cx[moved], cy[moved], 0
    v["lx"][:], v["ly"][:] = cx, cy
    total = v["pa"] + c.measurement_noise**2
    gain, drift = v["pa"] / total, v["pb"] / total
    ex, ey = cx - v["x"], cy - v["y"]
    v["x"] += gain * ex
    v["y"] += gain * ey
    v["vx"][:] = np.where(impact, measured[0], v["vx"] + drift * ex)
    v["vy"][:] = np.where(impact, measured[1], v["vy"] + drift * ey)
    v["pc"] -= drift * v["pb"]
    v["pa"] *= 1 - gain
    v["pb"] *= 1 - gain
    v["w"][:] = 0.7 * np.maximum(1, m[:, 2]) + 0.3 * v["w"]
    v["h"][:] = 0.7 * np.maximum(1, m[:, 3]) + 0.3 * v["h"]
    v["conf"][:] = m[:, 4]
    v["hits"] += 1
    v["missing"][:] = 0
    v["seen"][:] = 1
    rows[k] = t


def step(state: State, det: np.ndarray, width: float, height: float, dx: float = 0.0, dy: float = 0.0, config: TrackerConfig = SHIPPED) -> tuple[State, np.ndarray, dict[str, int]]:
    """One frame: ``det`` rows (cx, cy, w, h, confidence) by falling confidence -> new state, shown tracks by id (rows of ``COLUMNS``), counts."""
    c, s = config, max(0.25, width / config.reference_frame_width)
    if not len(state.rows) and not len(det):
        return State(state.rows, state.next_id), state.rows, dict.fromkeys(COUNTS, 0)
    rows = state.rows.copy()
    det = det.reshape(-1, 5)
    high, low = det[det[:, 4] >= c.high_conf], det[(det[:, 4] >= c.low_conf) & (det[:, 4] < c.high_conf)]
    # The picture's own motion moves state and anchor, but not the raw anchor; then predict.
    for x, y in (("x", "y"), ("lx", "ly"), ("ax", "ay")):
        rows[:, INDEX[x]] += dx
        rows[:, INDEX[y]] += dy
    rows[:, INDEX["x"]] += _col(rows, "vx")
    rows[:, INDEX["y"]] += _col(rows, "vy")
    q = c.process_noise**2
    a, b, p = (_col(rows, n).copy() for n in ("pa", "pb", "pc"))
    rows[:, INDEX["pa"]], rows[:, INDEX["pb"]], rows[:, INDEX["pc"]] = a + 2 * b + p + q / 4, b + p + q / 2, p + q
    rows[:, INDEX["age"]] += 1
    rows[:, INDEX["seen"]] = 0
    first, fast1 = _match(rows, np.arange(len(rows)), high, s, c)
    _absorb(rows, first, high, s, c)
    second, fast2 = _match(rows, np.flatnonzero(_col(rows, "seen") == 0), low, s, c)
    _absorb(rows, second, low, s, c)
    lost = _col(rows, "seen") == 0
    rows[lost, INDEX["missing"]] += 1
    rows[lost, INDEX["conf"]] *= c.confidence_decay
    rows[lost, INDEX["vx"]] *= c.prediction_velocity_decay
    rows[lost, INDEX["vy"]] *= c.prediction_velocity_decay
    stale = _col(rows, "missing") > c.max_missing_frames
    if c.require_motion_confirmation:
        stale |= (_col(rows, "moving") == 0) & (_col(rows, "age") > c.unconfirmed_max_frames)
    rows = rows[~stale]
    fresh = np.setdiff1d(np.arange(len(high)), [d for _, d, _ in first])[: max(0, c.max_tracks - len(rows))]
    new = np.zeros((len(fresh), len(COLUMNS)))
    if len(fresh):
        m = high[fresh]
        for name, value in {
            "id": state.next_id + np.arange(len(fresh)), "x": m[:, 0], "y": m[:, 1], "lx": m[:, 0], "ly": m[:, 1], "ax": m[:, 0], "ay": m[:, 1], "rx": m[:, 0], "ry": m[:, 1], "pa": 100.0, "pc": 100.0,
            "w": np.maximum(1, m[:, 2]), "h": np.maximum(1, m[:, 3]), "conf": m[:, 4], "age": 1, "hits": 1, "seen": 1, "moving": 0 if c.require_motion_confirmation else 1,
        }.items():
            new[:, INDEX[name]] = value
        rows = np.vstack([rows, new])
    v = {name: rows[:, i] for name, i in INDEX.items()}
    speed = np.hypot(v["vx"], v["vy"]) / s
    horizon = np.full(len(rows), c.max_predict_frames)
    if c.fast_prediction_speed_px > 0:
        horizon = np.where(speed >= c.fast_prediction_speed_px, np.minimum(horizon, c.fast_max_predict_frames), horizon)
    inside = (v["x"] >= 0) & (v["x"] <= width) & (v["y"] >= 0) & (v["y"] <= height)
    reliable = (v["seen"] > 0) | ((v["conf"] >= c.prediction_min_confidence) & (v["missing"] <= horizon) & inside)
    shown = reliable & (v["missing"] <= c.max_predict_frames)
    if not c.emit_tentative:
        shown &= v["hits"] >= c.min_hits
    if c.require_motion_confirmation:
        shown &= v["moving"] > 0
    if c.max_stationary_frames:
        shown &= v["still"] <= c.max_stationary_frames
    eligible = np.flatnonzero(shown)
    picked, preferred = eligible, state.preferred
    if c.max_output_tracks and len(eligible) > c.max_output_tracks:
        score = 3.0 * v["seen"] + 2.0 * v["conf"] + 0.25 * np.minimum(speed / 10, 3) + 0.5 * (v["id"] == state.preferred) + 0.02 * np.minimum(v["hits"], 10) - 0.25 * v["missing"] - 0.12 * v["still"]
        picked = eligible[np.argsort(-score[eligible], kind="stable")][: c.max_output_tracks]
    if not len(eligible):
        preferred = -1
    elif c.max_output_tracks == 1:
        preferred = int(v["id"][picked[0]])
    out = rows[np.sort(picked)]
    impacts = sum(x for _, _, x in first) + sum(x for _, _, x in second)
    values = (
        len(det), len(high), len(low), len(first), len(second), len(fresh), int(stale.sum()), len(rows), len(out), len(eligible), len(eligible) - len(picked), fast1 + fast2, impacts,
        int((v["moving"] == 0).sum()), int((v["still"] > c.max_stationary_frames).sum()) if c.max_stationary_frames else 0,
    )
    return State(rows, state.next_id + len(fresh), preferred), out, dict(zip(COUNTS, values))


def track_rows(stream_id: str, frame_index: int, out: np.ndarray, width: float, height: float, config: TrackerConfig = SHIPPED) -> list[tuple]:
    """Shown tracks as output rows; boxes are clipped to the picture, centers aren't."""
    rows = []
    for r in out:
        v = dict(zip(COLUMNS, r.tolist()))
        seen = v["seen"] > 0
        clip = lambda p, top: min(max(p, 0.0), top)
        box = clip(v["x"] - v["w"] / 2, width), clip(v["y"] - v["h"] / 2, height), clip(v["x"] + v["w"] / 2, width), clip(v["y"] + v["h"] / 2, height)
        rows.append((
            stream_id, frame_index, int(v["id"]), "observed" if seen else "predicted", v["x"], v["y"], *box, v["conf"], v["vx"], v["vy"], int(v["missing"]), "detector" if seen else "prediction",
            int(v["age"]), int(v["hits"]), v["hits"] >= config.min_hits, v["moving"] > 0, int(v["still"]),
        ))
    return rows


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def spine(frames: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per frame with its picture, its motion (null: none) and its detections by falling confidence. Frames without detections stay: the tracker moves on every frame."""
    boxes = F.struct((-F.col("confidence")).alias("o"), "det_idx", "cx", "cy", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), "confidence")
    per = kept.groupBy("stream_id", "frame_index").agg(F.array_sort(F.collect_list(boxes)).alias("d"))
    flat = F.flatten(F.transform("d", lambda b: F.array(b["cx"], b["cy"], b["w"], b["h"], b["confidence"])))
    base = frames.select("stream_id", "frame_index", "width", "height", F.coalesce("cam_dx", F.lit(0.0)).alias("dx"), F.coalesce("cam_dy", F.lit(0.0)).alias("dy"))
    return base.join(per, ["stream_id", "frame_index"], "left").select("stream_id", "frame_index", "width", "height", "dx", "dy", flat.alias("det"), F.transform("d", lambda b: b["confidence"]).alias("det_conf"))


def states(state: State) -> list[dict]:
    """All tracks of a stream as the diagnostics show them."""
    out = []
    for r in state.rows:
        v = dict(zip(COLUMNS, r.tolist()))
        out.append({
            "track_id": int(v["id"]), "center": [round(v["x"], 3), round(v["y"], 3)], "velocity": [round(v["vx"], 3), round(v["vy"], 3)], "missing_frames": int(v["missing"]), "motion_confirmed": v["moving"] > 0,
            "observed_this_frame": v["seen"] > 0,
        })
    return out


def pieced(rows: DataFrame, longest: int, least: float, block: int = BLOCK) -> DataFrame:
    """Adds ``piece`` to a spine. A piece begins at a frame with a detection of at least ``least`` after more than ``longest`` frames without one; frames with nothing to follow get negative pieces, by blocks.

    Frames are counted as rows, as the trackers do. No window is longer than a block of ``block`` frame indices.
    """
    keys = ["stream_id", "_block"]
    inner = Window.partitionBy(*keys).orderBy("frame_index")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    good = F.exists("det_conf", lambda c: c >= least)
    cut = rows.withColumn("_block", F.floor(F.col("frame_index") / block)).withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_i", F.row_number().over(inner))
    cut = cut.withColumn("_last", F.max(F.when(F.col("_good"), F.col("_i"))).over(before)).withColumn("_new", F.col("_good") & (F.col("_i") - F.col("_last") > longest))
    ends = cut.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.when(F.col("_good"), F.col("_i"))).alias("first"), F.max(F.when(F.col("_good"), F.col("_i"))).alias("last"), F.max(F.when(F.col("_new"), F.col("_i"))).alias("new"))
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_at", F.coalesce(F.sum("c").over(earlier), F.lit(0))).withColumn("_seen", F.max(F.col("_at") + F.col("last")).over(earlier))
    # The first detection of a block is judged by the last one of any block before.
    opens = F.coalesce(F.col("_at") + F.col("first") - F.col("_seen") > longest, F.lit(True)) & F.col("first").isNotNull()
    ends = ends.withColumn("_opens", F.when(opens, F.col("first")))
    ends = ends.withColumn("_held", F.max(F.col("_at") + F.coalesce("new", "_opens")).over(earlier)).select(*keys, "_at", "_seen", "_opens", "_held")
    both = cut.join(ends, keys)
    start = F.when(F.col("_new") | (F.col("_i") == F.col("_opens")), F.col("_at") + F.col("_i"))
    begun = F.coalesce(F.max(start).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_held")
    idle = ~F.col("_good") & F.coalesce(F.col("_at") + F.col("_i") - F.coalesce(F.col("_at") + F.col("_last"), "_seen") > longest, F.lit(True))
    return both.withColumn("piece", F.when(idle, -1 - F.col("_block")).otherwise(begun)).select(*rows.columns, "piece")


def track(frames: DataFrame, kept: DataFrame, scratch: Scratch, config: TrackerConfig = SHIPPED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Shown tracks, and per frame the 18 diagnostics, of all streams in one pass; ``kept`` are detections after suppression.

    Frames come sorted by the shuffle and stream through a task in Arrow batches; only the state of one piece
    is held. A frame index below nought, or one that stands twice in a stream, is a frame like any other, in order.
    A stream without detections gives diagnostics alone; empty tables give none.
    """
    fields = dict(c.split(" ", 1) for c in PIECES.split(", "))
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    two = pa.list_(pa.float64())
    shown_states = pa.list_(pa.struct([("track_id", pa.int64()), ("center", two), ("velocity", two), ("missing_frames", pa.int32()), ("motion_confirmed", pa.bool_()), ("observed_this_frame", pa.bool_())]))
    types = [kinds.get(t, shown_states) for t in fields.values()]
    tracks, counts = len(names(TRACKS)), len(COUNTS) + 3

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, rows = State(), None, []

        def end() -> None:
            if current is not None and state.next_id > 1:
                rows.append(("E", current[1], current[0], None, state.next_id - 1, *[None] * (tracks - 3 + counts)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(fields))

        for part in batches:
            for r in part.to_pylist():
                key = r["stream_id"], r["piece"]
                if key != current:
                    end()
                    state, current = State(), key
                det = np.zeros(0) if r["det"] is None else np.asarray(r["det"], float)
                width, height = float(r["width"]), float(r["height"])
                state, out, found = step(state, det, width, height, r["dx"], r["dy"], config)
                rows += [("T", key[1], *t, *[None] * counts) for t in track_rows(key[0], r["frame_index"], out, width, height, config)]
                rows.append(("D", key[1], key[0], r["frame_index"], *[None] * (tracks - 2), *found.values(), r["dx"], r["dy"], states(state)))
            if len(rows) > 20_000:
                yield batch()
                rows.clear()
        end()
        if rows:
            yield batch()

    laid = pieced(spine(frames, kept), config.max_missing_frames + 1, config.low_conf, block)
    done = scratch.cut(laid.drop("det_conf").repartition("stream_id", "piece").sortWithinPartitions("stream_id", "piece", "frame_index").mapInArrow(work, PIECES))
    earlier = Window.partitionBy("stream_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    made = done.filter("kind = 'E'").select("stream_id", "piece", F.coalesce(F.sum("track_id").over(earlier), F.lit(0)).alias("_made"))
    on = done.join(made, ["stream_id", "piece"], "left").withColumn("_made", F.coalesce("_made", F.lit(0)))
    moved = F.transform("track_states", lambda t: t.withField("track_id", t["track_id"] + F.col("_made")))
    shown = on.filter("kind = 'T'").withColumn("track_id", F.col("track_id") + F.col("_made")).select(*names(TRACKS))
    return shown, on.filter("kind = 'D'").withColumn("track_states", moved).select("stream_id", "frame_index", *COUNTS, "camera_motion_dx", "camera_motion_dy", "track_states")
