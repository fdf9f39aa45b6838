import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import court
from trackloom.operators.single import Ball

H = np.array([[0.016, 0.001, -1.0], [0.0005, 0.05, -2.0], [0.00001, 0.0002, 1.0]])


def seen(kps, wrong=None):
    out = []
    for k in kps:
        p = np.linalg.inv(H) @ [*court.POINTS[k], 1.0]
        x, y = p[:2] / p[2]
        out.append(("s", k, float(x) + (400.0 if k == wrong else 0.0) + 400, float(y) + 400))
    return out


def test_fit_and_gates(spark):
    schema = "stream_id string, kp int, x double, y double"
    one = lambda rows: court.fit(spark.createDataFrame(rows, schema)).collect()
    r = one([*seen(range(14)), ("s", 99, 1.0, 1.0)])[0]
    assert r.status == "accepted" and r.points == 14 and r.mean_error_px < 0.1
    off = one(seen(range(14), wrong=5))[0]
    assert off.inlier_ratio == round(13 / 14, 3)
    few = seen([0, 2, 5, 8, 11, 13], wrong=5)  # one gross error among six points: seen through, but it counts in the mean error
    h, near = court.robust(np.array([x[2:] for x in few]), np.array([court.POINTS[x[1]] for x in few]), 1.5)
    assert near.tolist() == [True, True, False, True, True, True] and abs(h - np.array(r.h).reshape(3, 3)).max() < 1e-6
    assert one(few)[0].status == "rejected_reproj_error" and one(few)[0].h is None
    assert one(seen([0, 1, 2]))[0].status == "too_few" and one(seen([0, 3, 6, 8, 11]))[0].status == "missing_left_right_coverage" and one(seen([0, 1, 2, 3, 5]))[0].status == "missing_near_far_coverage"
    assert one([]) == []


def test_projection_inverts_and_zones(spark):
    h = [F.lit(float(v)) for v in H.ravel()]
    df = spark.createDataFrame([(1, 12.0, 20.0), (2, 0.5, 43.0), (3, 10.0, 5.0)], "i int, u double, v double")
    x, y = G.unproject(h, F.col("u"), F.col("v"))
    back = df.select("i", "u", "v", x.alias("x"), y.alias("y")).select("i", "u", "v", *[c.alias(n) for n, c in zip("pq", G.project(h, F.col("x"), F.col("y")))])
    assert all(abs(r.u - r.p) < 1e-6 and abs(r.v - r.q) < 1e-6 for r in back.collect())
    z = G.zone(F.col("u"), F.col("v"))
    assert [r[0] for r in df.orderBy("i").select(z["zone"]).collect()] == ["far_nvz", "near_left_service", "far_right_service"]
    none = G.zone(F.lit(None).cast("double"), F.lit(1.0))
    assert tuple(spark.range(1).select(none["zone"], none["is_in_court"]).first()) == ("unknown", False)


def test_single_ball():
    ball = Ball()
    d = lambda x, y, c=0.9: np.array([[x, y, 8, 8, c]], float)
    assert ball.frame(np.zeros((0, 5)))[0::7] == ("absent", "no_detection")
    assert ball.frame(d(100, 100, 0.1))[7] == "low_conf"
    assert ball.frame(d(100, 100))[:3] == ("observed", 100.0, 100.0)
    ball.frame(d(110, 100))
    assert ball.frame(d(900, 100))[0::7] == ("predicted", "large_jump")
    states = [ball.frame(np.zeros((0, 5)))[0] for _ in range(4)]
    assert states == ["predicted", "predicted", "absent", "absent"]
    assert ball.frame(d(900, 100))[0] == "observed"


def test_observations_and_calibration(spark):
    text = "court:\n  keypoints_14:\n    0: [0, 0]\n    3: [5.5, 6]\n    1: [0, 2]\n"
    k = court.calibration(spark, text, "s")
    o = court.observations(k.unionByName(k.limit(1)), "calibration_file").first()
    assert o.visible_indices == [1, 3] and o.num_visible == 2 and not o.is_reliable and o.keypoints[3].x == 5.5 and set(o.confidences.values()) == {1.0}
    assert court.calibration(spark, "", "s").count() == 0 and court.observations(k.limit(0)).count() == 0
    assert court.lines(spark).count() == 19 and court.lines(spark, "short_end").count() == 19 and court.lines(spark, "top").count() == 11
