from itertools import combinations

import pytest

from trackloom.operators import detections as D

SCHEMA = "stream_id string, frame_index long, det_idx int, x1 double, y1 double, x2 double, y2 double, cx double, cy double, confidence double, source string, class_id int, extra string"


def box(i, cx, cy, side, conf, frame=0, cls=0):
    return ("s", frame, i, cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2, cx, cy, conf, "t", cls, None)


def test_nested_boxes_go_separate_ones_stay(spark):
    df = spark.createDataFrame([box(0, 100.0, 100.0, 20.0, 0.9), box(1, 100.0, 100.0, 12.0, 0.7), box(2, 300.0, 100.0, 20.0, 0.8)], SCHEMA)
    assert [r.det_idx for r in D.deduplicate(df).orderBy("det_idx").collect()] == [0, 2]


def test_no_two_kept_boxes_clash(spark):
    import random

    rng = random.Random(4)
    rows = [box(i, rng.uniform(0, 200), rng.uniform(0, 200), rng.choice([8.0, 14.0, 30.0]), round(rng.random(), 2), frame) for frame in range(20) for i in range(12)]
    kept = D.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()

    def clash(a, b):
        inter = max(0, min(a.x2, b.x2) - max(a.x1, b.x1)) * max(0, min(a.y2, b.y2) - max(a.y1, b.y1))
        union = (a.x2 - a.x1) ** 2 + (b.x2 - b.x1) ** 2 - inter
        return inter / union >= 0.2 or ((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) ** 0.5 <= max(6, 0.75 * max(a.x2 - a.x1, b.x2 - b.x1))

    for f in range(20):
        own = [k for k in kept if k.frame_index == f]
        assert own and not any(clash(a, b) for a, b in combinations(own, 2))
        gone = [r for r in rows if r[1] == f and r[2] not in {k.det_idx for k in own}]
        assert all(any(k.confidence >= g[9] for k in own) for g in gone)


def test_empty_ties_and_top_k(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.deduplicate(none).count() == D.nms(none).count() == D.top_k(none, 3).count() == 0
    tied = spark.createDataFrame([box(i, 100.0 * i, 50.0, 8.0, 0.5) for i in range(4)], SCHEMA)
    assert sorted(r.det_idx for r in D.top_k(tied, 2).collect()) == [0, 1]
    twice = spark.createDataFrame([box(0, 10.0, 10.0, 4.0, 0.5)] * 2, SCHEMA)
    assert D.distinct(twice).count() == 1


def test_raw_output(spark):
    schema = "stream_id string, frame_index long, row int, output array<double>"
    df = spark.createDataFrame([("s", 0, 0, [1.0, 2.0, 3.0, 4.0, 0.9, 5.0]), ("s", 0, 1, [10.0, 10.0, 4.0, 4.0, 0.1, 0.7, 0.7]), ("s", 0, 2, [10.0, 10.0, 4.0, 4.0, 0.05])], schema)
    rows = D.decode_scores(df, 0.08).orderBy("row").collect()
    assert [(r.row, r.class_id, r.x1) for r in rows] == [(0, 5, 1.0), (1, 1, 8.0)]
    with pytest.raises(Exception, match="fewer than five"):
        D.decode_scores(spark.createDataFrame([("s", 0, 0, [1.0, 2.0])], schema), 0.1).collect()


def test_pluggable_detector(spark):
    import pandas as pd

    frames = spark.createDataFrame([("s", i, "x") for i in range(5)], "stream_id string, frame_index long, pixels string")

    def load():
        def found(rows):
            own = rows[rows["frame_index"] % 2 == 0][["stream_id", "frame_index"]]
            return pd.concat([own, own]).assign(x1=0.0, y1=0.0, x2=4.0, y2=2.0, confidence=0.5, class_id=0)

        return found

    got = sorted((r.frame_index, r.det_idx, r.cx, r.cy, r.source) for r in D.detect(frames, load).collect())
    assert got == [(i, k, 2.0, 1.0, "detector") for i in (0, 2, 4) for k in (0, 1)]
    assert D.detect(frames, "null").count() == 0 and D.detect(frames.limit(0), load).count() == 0
    with pytest.raises(ValueError):
        D.detect(frames, "none such")
