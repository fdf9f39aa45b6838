"""Boxes, gates and planes as column expressions, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union has no area."""
    shared = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def size_penalty(w: Column, h: Column, track_w: Column, track_h: Column) -> Column:
    """How far two box sizes are apart, on a log scale; sides count as at least one pixel."""
    one = F.lit(1.0)
    return F.abs(F.log(F.greatest(w, one) / F.greatest(track_w, one))) + F.abs(F.log(F.greatest(h, one) / F.greatest(track_h, one)))


def xyxy(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def letterbox(width: Column, height: Column, side: int) -> dict[str, Column]:
    """Scale and padding that put a picture into a square of ``side``; sizes round half to even."""
    scale = F.least(side / width, side / height)
    w, h = F.bround(width * scale).cast("int"), F.bround(height * scale).cast("int")
    return {"scale": scale, "left": F.bround((side - w) / 2 - 0.1).cast("int"), "top": F.bround((side - h) / 2 - 0.1).cast("int")}


def unletterbox(value: Column, pad: Column, scale: Column, limit: Column, offset: float = 0.0) -> Column:
    """A coordinate of the square back in the picture, clipped to it."""
    return F.least(F.greatest((value - pad) / scale + offset, F.lit(0.0)), limit.cast("double"))


def inside(cx: Column, cy: Column, region: tuple[float, float, float, float]) -> Column:
    return cx.between(region[0], region[2]) & cy.between(region[1], region[3])


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, pad: float = 0.1) -> Column:
    """A region padded by a share of its sides and clipped to the picture; null where nothing is left."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    zero = F.lit(0.0)
    box = F.struct(F.greatest(x1 - px, zero).alias("x1"), F.greatest(y1 - py, zero).alias("y1"), F.least(x2 + px, width.cast("double")).alias("x2"), F.least(y2 + py, height.cast("double")).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def project(h: list[Column], x: Column, y: Column, length: float = 44.0, width: float = 20.0, margin: float = 20.0) -> tuple[Column, Column]:
    """Perspective projection by nine numbers, row by row; null where it falls beyond the court and its margin."""
    w = h[6] * x + h[7] * y + h[8]
    u, v = (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
    near = (F.abs(w) > 1e-12) & u.between(-margin, width + margin) & v.between(-margin, length + margin)
    return F.when(near, u), F.when(near, v)


def unproject(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse projection, by cofactors (a common factor falls out of the division)."""
    a, b, c, d, e, f, g, i, j = h
    u = (e * j - f * i) * x + (c * i - b * j) * y + (b * f - c * e)
    v = (f * g - d * j) * x + (a * j - c * g) * y + (c * d - a * f)
    w = (d * i - e * g) * x + (b * g - a * i) * y + (a * e - b * d)
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    far = F.abs(w / det) < 1e-8
    return F.when(~far, u / w), F.when(~far, v / w)


def zone(x: Column, y: Column) -> Column:
    """zone, is_in_court, is_nvz of a court point in feet; ``unknown`` for null, ``out_of_court`` beyond a tenth of a foot."""
    # Court of 20 by 44 feet, non-volley lines at 15 and 29, net at 22, middle line at 10.
    side = F.when(x < 10, "left_service").otherwise("right_service")
    out = (x < -0.1) | (x > 20.1) | (y < -0.1) | (y > 44.1)
    name = F.when(x.isNull() | y.isNull(), "unknown").when(out, "out_of_court").when(y < 15, F.concat(F.lit("far_"), side)).when(y < 22, "far_nvz").when(y < 29, "near_nvz").otherwise(F.concat(F.lit("near_"), side))
    return F.struct(name.alias("zone"), (~name.isin("unknown", "out_of_court")).alias("is_in_court"), name.isin("far_nvz", "near_nvz").alias("is_nvz"))


def foot(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Middle of a box's lower edge; null where a side is."""
    return (x1 + x2) / 2, F.when(x1.isNotNull() & x2.isNotNull(), y2)


def anchor(x1: Column, x2: Column, y2: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """The point that is projected: the middle of the box's lower edge, else the center, else null."""
    u, v = foot(x1, x2, y2)
    boxed = u.isNotNull() & v.isNotNull()
    return F.when(boxed, u).otherwise(cx), F.when(boxed, v).otherwise(cy)


def camera_gate(dx: Column, dy: Column, inliers: Column | None = None, least_inliers: int = 20, most_shift: float = 80.0) -> tuple[Column, Column, Column]:
    """Whether a frame's camera motion counts, and what is left of it: enough inliers (where they are known) and not beyond ``most_shift`` (0: no limit). Null motion doesn't count."""
    counts = F.lit(True) if most_shift == 0 else F.hypot(dx, dy) <= most_shift
    if inliers is not None:
        counts = counts & (inliers >= least_inliers)
    counts = F.coalesce(counts & dx.isNotNull() & dy.isNotNull(), F.lit(False))
    return counts, F.when(counts, dx).otherwise(0.0), F.when(counts, dy).otherwise(0.0)


def marker(track_id: Column, x1: Column, y1: Column, x2: Column, y2: Column, colours: int = 7) -> tuple[Column, Column]:
    """Number of a track's colour, and the radius of its mark: half the longest side, from 5 to 15 whole pixels, 7 without a box."""
    half = (F.greatest(F.bround(x2) - F.bround(x1), F.bround(y2) - F.bround(y1)) / 2).cast("int")
    return F.pmod(F.coalesce(track_id, F.lit(0)) - 1, F.lit(colours)), F.when(x1.isNull(), 7).otherwise(F.greatest(F.lit(5), F.least(F.lit(15), half)))


def timestamp(frame_index: Column, fps: Column) -> Column:
    """Seconds of a frame; a rate of nought or none counts as 30."""
    return frame_index / F.when(fps > 0, fps).otherwise(30.0)
