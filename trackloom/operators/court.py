"""Court calibration: keypoints, coverage, homography fit with its gates, reprojection error."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import parse

LENGTH, WIDTH = 44.0, 20.0
# The 14 court points in feet, by index.
POINTS = {
    0: (0.0, 0.0), 1: (10.0, 0.0), 2: (20.0, 0.0), 3: (0.0, 15.0), 4: (10.0, 15.0), 5: (20.0, 15.0), 6: (0.0, 22.0), 7: (20.0, 22.0), 8: (0.0, 29.0), 9: (10.0, 29.0), 10: (20.0, 29.0), 11: (0.0, 44.0), 12: (10.0, 44.0), 13: (20.0, 44.0),
}
# Lines of the court drawn from the side, from above and from a short end, as pairs of points; status words of a fit.
LINES = {
    "side": ((0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (8, 9), (9, 10), (11, 12), (12, 13), (2, 5), (5, 7), (7, 10), (10, 13), (1, 4), (9, 12), (0, 3), (3, 6), (6, 8), (8, 11)),
    "top": ((0, 2), (11, 13), (0, 11), (2, 13), (6, 7), (3, 5), (8, 10), (1, 4), (9, 12), (3, 8), (5, 10)),
}
LINES["short_end"] = LINES["side"]
FIT = "stream_id string, points int, status string, h array<double>, inlier_ratio double, mean_error_px double, max_error_px double, area_px double"


def layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, x, y) for i, (x, y) in POINTS.items()], "kp int, court_x double, court_y double")


def lines(spark: SparkSession, view: str = "side") -> DataFrame:
    """Ends of the court's lines in feet, as ``view`` (side, top, short_end) draws them."""
    return spark.createDataFrame([(i, a, b, *POINTS[a], *POINTS[b]) for i, (a, b) in enumerate(LINES[view])], "line int, a int, b int, x1 double, y1 double, x2 double, y2 double")


def observations(keypoints: DataFrame, source: str = "none") -> DataFrame:
    """Keypoints (stream_id, kp, x, y, perhaps confidence) as one observation per stream: ``keypoints``, ``confidences`` (1.0 where none is given), ``visible_indices``, ``num_visible``, ``is_reliable`` (four or more) and its ``source`` (detector, manual, calibration_file, none). A repeated keypoint counts by its mean."""
    confidence = F.coalesce("confidence", F.lit(1.0)) if "confidence" in keypoints.columns else F.lit(1.0)
    once = keypoints.filter("kp IS NOT NULL").groupBy("stream_id", "kp").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(confidence).alias("c"))
    all_of = once.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "c"))).alias("p"))
    points = F.map_from_entries(F.transform("p", lambda k: F.struct(k["kp"], F.struct(k["x"].alias("x"), k["y"].alias("y")))))
    sure = F.map_from_entries(F.transform("p", lambda k: F.struct(k["kp"], k["c"])))
    return all_of.select("stream_id", points.alias("keypoints"), sure.alias("confidences"), F.transform("p", lambda k: k["kp"]).alias("visible_indices"), F.size("p").alias("num_visible"), (F.size("p") >= 4).alias("is_reliable"), F.lit(source).alias("source"))


def calibration(spark: SparkSession, text: str, stream_id: str) -> DataFrame:
    """Keypoints of a calibration text: ``court: keypoints_14: {index or name: [x, y]}``; points at (0, 0) are placeholders and go, an empty text gives none."""
    data = parse(text) if text.strip() else {}
    points = (data.get("court") or {}).get("keypoints_14") or {k: v for k, v in data.items() if str(k).isdigit()}
    rows = [(stream_id, int(k), float(v[0]), float(v[1])) for k, v in points.items() if str(k).isdigit() and isinstance(v, list) and len(v) == 2]
    return spark.createDataFrame([r for r in rows if r[2] > 0 or r[3] > 0], "stream_id string, kp int, x double, y double")


def placed(keypoints: DataFrame) -> DataFrame:
    """Keypoints (stream_id, kp, x, y) with their court points; unknown indices and the (0, 0) placeholder go."""
    return keypoints.filter((F.col("x") > 0) | (F.col("y") > 0)).join(F.broadcast(layout(keypoints.sparkSession)), "kp")


def coverage(keypoints: DataFrame) -> DataFrame:
    """Per stream: number of points and whether they stand left and right, near and far."""
    p = placed(keypoints)
    return p.groupBy("stream_id").agg(
        F.countDistinct("kp").alias("points"), (F.max((F.col("court_x") < 10).cast("int")) * F.max((F.col("court_x") > 10).cast("int")) > 0).alias("left_right"), (F.max((F.col("court_y") < 22).cast("int")) * F.max((F.col("court_y") > 22).cast("int")) > 0).alias("near_far")
    )


def _hull_area(p: np.ndarray) -> float:
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(points):
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and np.cross(out[-1] - out[-2], q - out[-2]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(half(p) + half(p[::-1]))
    x, y = hull[:, 0], hull[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def _solve(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Direct linear transform on centred and scaled points."""

    def norm(p):
        c, s = p.mean(0), np.sqrt(2) / max(1e-9, np.linalg.norm(p - p.mean(0), axis=1).mean())
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = norm(src), norm(dst)
    s, d = (np.column_stack([p, np.ones(len(p))]) @ t.T for p, t in ((src, a), (dst, b)))
    zero = np.zeros_like(s)
    rows = np.vstack([np.hstack([s, zero, -d[:, :1] * s]), np.hstack([zero, s, -d[:, 1:2] * s])])
    h = np.linalg.inv(b) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2]


def _moved(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        q = np.column_stack([p, np.ones(len(p))]) @ np.swapaxes(h, -1, -2)
        return q[..., :2] / q[..., 2:]


def robust(src: np.ndarray, dst: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A plane and the points that it brings within ``threshold``: of all planes through four points (there are at most 1,001 of them) the one that fits most points, then the one with the least error over these; fitted anew to its points."""
    choices = np.array(list(combinations(range(len(src)), 4)))
    planes = []
    for four in choices:
        try:
            h = _solve(src[four], dst[four])
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(h).all():
            planes.append(h)
    if not planes:
        return np.full((3, 3), np.nan), np.zeros(len(src), bool)
    far = np.nan_to_num(np.linalg.norm(_moved(np.array(planes), src) - dst, axis=2), nan=np.inf)
    near = far <= threshold
    best = np.lexsort((np.where(near, far, 0).sum(1), -near.sum(1)))[0]
    own = near[best]
    if own.sum() < 4:
        return planes[best], own
    for _ in range(3):
        h = _solve(src[own], dst[own])
        again = np.linalg.norm(_moved(h, src) - dst, axis=1) <= threshold
        if again.sum() < own.sum() or (again == own).all():
            break
        own = again
    return h, own


def fit(keypoints: DataFrame, threshold_ft: float = 1.5, least_area: float = 5000.0, least_inliers: float = 0.5, most_error: float = 8.0) -> DataFrame:
    """Homography per stream, picture to court, with the reason where there is none.

    At least four points, on both sides and both ends, not on a line (condition at most 1e5), hull of at
    least ``least_area``; the plane that brings most points within ``threshold_ft`` (``robust``); then determinant,
    inlier ratio and mean reprojection error in pixels. A repeated keypoint counts by its mean.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.groupby("kp", as_index=False)[["x", "y", "court_x", "court_y"]].mean()
        src, dst, n = pdf[["x", "y"]].to_numpy(), pdf[["court_x", "court_y"]].to_numpy(), len(pdf)
        row = {"points": n, "status": "", "h": None, "inlier_ratio": 0.0, "mean_error_px": None, "max_error_px": None, "area_px": 0.0}
        sides = [(dst[:, 0] < 10).any() and (dst[:, 0] > 10).any(), (dst[:, 1] < 22).any() and (dst[:, 1] > 22).any()]
        if n < 4:
            row["status"] = "too_few"
        elif not sides[0]:
            row["status"] = "missing_left_right_coverage"
        elif not sides[1]:
            row["status"] = "missing_near_far_coverage"
        else:
            s = np.linalg.svd(src - src.mean(0), compute_uv=False)
            row["area_px"] = _hull_area(src) if s[1] > 1e-9 else 0.0
            if s[0] / (s[1] + 1e-10) > 1e5:
                row["status"] = "collinear_points"
            elif row["area_px"] < least_area:
                row["status"] = "area_too_small"
            else:
                row |= gates(src, dst)
        return pd.DataFrame([row])

    def gates(src: np.ndarray, dst: np.ndarray) -> dict:
        h, near = robust(src, dst, threshold_ft)
        if not np.isfinite(h).all() or abs(np.linalg.det(h)) < 1e-6:
            return {"status": "rejected"}
        error = np.linalg.norm(_moved(np.linalg.inv(h), dst) - src, axis=1)
        out = {"inlier_ratio": round(float(near.mean()), 3), "mean_error_px": round(float(error.mean()), 2), "max_error_px": round(float(error.max()), 2)}
        if out["inlier_ratio"] < least_inliers:
            return out | {"status": "rejected"}
        good = error.mean() <= most_error
        return out | {"status": "accepted" if good else "rejected_reproj_error", "h": h.ravel().tolist() if good else None}

    def keyed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return one(pdf).assign(stream_id=key[0])[[c.split()[0] for c in FIT.split(", ")]]

    return placed(keypoints).groupBy("stream_id").applyInPandas(keyed, FIT)


def mini_pixel(x: Column, y: Column, width: int, height: int, sideways: bool = False, padding: int = 10) -> tuple[Column, Column]:
    """Court feet to pixels of a drawing of the court, truncated to whole ones."""
    across, down = (LENGTH, WIDTH) if sideways else (WIDTH, LENGTH)
    room_w, room_h = width - 2 * padding, height - 2 * padding
    tall = room_w / room_h > across / down
    w, h = (int(room_h * across / down), room_h) if tall else (room_w, int(room_w * down / across))
    u, v = (y, F.lit(WIDTH) - x) if sideways else (x, y)
    return (padding + (room_w - w) // 2 + u * (w / across)).cast("int"), (padding + (room_h - h) // 2 + v * (h / down)).cast("int")


def search_region(cx: Column, cy: Column, width: Column, height: Column, radius: float = 120.0, least: float = 60.0) -> Column:
    """The region around a point in which to look next: clipped to the picture, widened about its middle to the least side, one decimal."""

    def side(c: Column, top: Column) -> tuple[Column, Column]:
        lo, hi = F.greatest(c - radius, F.lit(0.0)), F.least(c + radius, top.cast("double"))
        middle = (lo + hi) / 2
        return F.when(hi - lo < least, F.greatest(middle - least / 2, F.lit(0.0))).otherwise(lo), F.when(hi - lo < least, F.least(middle + least / 2, top.cast("double"))).otherwise(hi)

    (x1, x2), (y1, y2) = side(cx, width), side(cy, height)
    return F.array(*[F.bround(v, 1) for v in (x1, y1, x2, y2)])
