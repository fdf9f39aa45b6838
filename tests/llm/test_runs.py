import random

import pytest

from trackloom.llm import runs
from trackloom.session import Scratch

SCHEMA = "row_id long, stream_id string, track_id long, frame_index long, status string, missing_frames int, block int, part int, run string"


def brute(rows):
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (str(r[1]), r[2] or 0, r[3], r[5] is None, r[5] or 0, r[0])):
        if r[2] is not None:
            seen.setdefault((r[1], r[2], r[3]), r)
    tracks = {}
    for (s, t, f), r in sorted(seen.items()):
        tracks.setdefault((s, t), []).append((f, r[4].strip().lower().split(".")[-1], r[5]))
    for key, events in tracks.items():
        islands, last = [], None
        for f, status, m in events:
            if last is None or f - last[0] > 5 or status != last[1]:
                islands.append([])
            islands[-1].append([f, f - m if status != "observed" and m is not None else None])
            last = (f, status)
        for island in islands:
            base = None
            for e in island:
                base = e[1] = base if e[1] is None else e[1]
            for e in reversed(island):
                base = e[1] = base if e[1] is None else e[1]
            group = [island[0]]
            for e in island[1:]:
                if e[1] != group[-1][1]:
                    out.append((*key, group[0][0], group[-1][0], len(group)))
                    group = []
                group.append(e)
            out.append((*key, group[0][0], group[-1][0], len(group)))
    return sorted(out)


@pytest.mark.parametrize("block", [7, 16384])
def test_equals_brute_force_at_any_block_size(spark, block):
    rng, rows = random.Random(9), []
    for t in range(12):
        f = missing = 0
        for _ in range(80):
            f += rng.choice([1, 1, 1, 1, 2, 3, 6])
            status = rng.choice(["observed", "predicted", "predicted", "absent"]) if rng.random() < 0.4 else (rows[-1][4].strip().lower().split(".")[-1] if rows else "observed")
            missing = 0 if status == "observed" else rng.choice([missing + 1, missing + 1, f % 9])
            spelled = rng.choice([status, status.upper(), f" {status}", f"BallStatus.{status.upper()}"])
            rows.append((len(rows), "s", t, f, spelled, None if rng.random() < 0.2 else missing, 1, 1, "x"))
            if rng.random() < 0.1:
                rows.append((len(rows), *rows[-1][1:]))
    rows.append((99999, "s", None, 5, "absent", 0, 1, 1, "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.stream_id, r.track_id, r.first_frame, r.last_frame, r.frames) for r in runs.runs(df, Scratch(spark), block_frames=block).collect())
    assert got == brute(rows)


def test_empty_and_null(spark):
    assert runs.runs(spark.createDataFrame([], SCHEMA), Scratch(spark)).count() == 0
    one = spark.createDataFrame([(1, "s", 1, 4, None, None, 1, 1, "x"), (2, "s", 1, 5, None, None, 1, 1, "x")], SCHEMA)
    assert [(r.first_frame, r.last_frame, r.frames) for r in runs.runs(one, Scratch(spark)).collect()] == [(4, 5, 2)]
    frames = spark.createDataFrame([("s", 0, 0.0), ("s", 10, 1.0), ("s", 11, None)], "stream_id string, frame_index long, ts_s double")
    assert runs.with_duration(runs.runs(one, Scratch(spark)), frames).first().duration_s == 0.1
