"""Queries over the test tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.tracks import status_name
from ..operators import cleaning, court, detections, events, metrics, sequences, single, spikes, tracker
from ..operators.blocks import haloed
from ..session import Scratch, table
from ..sources import files
from .sql import ORACLE

KEYS = ["stream_id", "frame_index"]


def _tracks(spark, d):
    """Deliveries once, fields flat, statuses in one spelling."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id", "track_id", "frame_index").orderBy("row_id")
    once = table(spark, d, "ball_tracks").filter("track_id IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    at = lambda c, i: F.get(c, F.lit(i))
    return once.select("stream_id", "track_id", "frame_index", status_name(F.col("status")).alias("status"), at("center", 0).alias("cx"), at("center", 1).alias("cy"), at("velocity", 0).alias("vx"), at("velocity", 1).alias("vy"), "confidence", "missing_frames")


def _finite(tracks):
    return tracks.filter("cx IS NOT NULL AND NOT isnan(cx) AND NOT isnan(cy) AND abs(cx) < 1e12 AND abs(cy) < 1e12")


def _det(spark, d):
    return detections.distinct(table(spark, d, "detections"))


def _kept(spark, d):
    return detections.deduplicate(detections.keep(_det(spark, d)))


def p5_found(spark, d):
    return spikes.spikes(table(spark, d, "ball_tracks"), table(spark, d, "frames"), Scratch(spark)).select("stream_id", "track_id", "frame_index")


def p5_spikes(spark, d):
    return spikes.spikes(table(spark, d, "ball_tracks"), table(spark, d, "frames"), Scratch(spark))


def det_conf_tiers(spark, d):
    return detections.tiers(_det(spark, d), 0.25, 0.15).groupBy("stream_id", "tier").agg(F.count("*").alias("n"))


def det_filter(spark, d):
    return detections.keep(_det(spark, d), 0, 0.15, (100.0, 100.0, 400.0, 300.0)).select(*KEYS, "det_idx", "confidence")


def det_box_forms(spark, d):
    x1, y1, x2, y2 = G.xyxy(F.col("cx"), F.col("cy"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return _det(spark, d).select(*KEYS, "det_idx", *[F.round(c, 4).alias(n) for n, c in {"bx1": x1, "by1": y1, "bx2": x2, "by2": y2, "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}.items()])


def det_letterbox(spark, d):
    j = _det(spark, d).join(table(spark, d, "frames").select(*KEYS, "width", "height"), KEYS)
    p = G.letterbox(F.col("width"), F.col("height"), 640)
    x = G.unletterbox(F.col("cx") * p["scale"] + p["left"], p["left"], p["scale"], F.col("width"))
    y = G.unletterbox(F.col("cy") * p["scale"] + p["top"], p["top"], p["scale"], F.col("height"))
    return j.select(*KEYS, "det_idx", p["left"].alias("pad_left"), p["top"].alias("pad_top"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


def det_crop(spark, d):
    j = _det(spark, d).join(table(spark, d, "frames").select(*KEYS, "width", "height"), KEYS)
    c = G.crop(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("width"), F.col("height"))
    return j.select(*KEYS, "det_idx", *[F.round(c[n], 4).alias(n) for n in ("x1", "y1", "x2", "y2")])


def det_topk_per_frame(spark, d):
    return detections.top_k(_det(spark, d), 3).select(*KEYS, "det_idx", "rank")


def det_decode(spark, d):
    """Heads of a frame: candidates in columns (few rows, many columns), turned and decoded."""
    row = F.struct("det_idx", F.array("cx", "cy", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "confidence", F.col("confidence") * F.col("class_id") * 2, F.lit(0.01)).alias("v"))
    whole = _det(spark, d).groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["v"]).alias("rows"))
    # Padded to 300 candidates of no score, as a head has them, and laid with one row per number.
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * 7), 300 - F.size("rows"))
    head = F.expr("transform(sequence(0, 6), c -> transform(full, r -> r[c]))")
    heads = whole.withColumn("full", F.concat("rows", pad)).select(*KEYS, head.alias("head"))
    return detections.decode_scores(detections.as_rows(heads), 0.15).select(*KEYS, "row", F.round("x1", 4).alias("x1"), F.round("y2", 4).alias("y2"), F.round("confidence", 6).alias("confidence"), "class_id")


def det_none(spark, d):
    """The detector that finds nothing, seen from the frames: no frame has a detection."""
    return table(spark, d, "frames").join(detections.none(table(spark, d, "frames")).groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"))


def det_failure(spark, d):
    """Detections up to a stream's first failure; an inference that returns a box below 4 px counts as failed here."""
    det = _det(spark, d)
    return detections.guarded(det, det.filter("x2 - x1 < 4"), strict=False).groupBy("stream_id").agg(F.count("*").alias("n"), F.max("frame_index").alias("last_frame"))


def frame_sampling(spark, d):
    return detections.sampled(table(spark, d, "frames"), 3)


def frame_range(spark, d):
    return files.frame_range(table(spark, d, "frames"), 50, 100).select(*KEYS, "width")


def frame_spine_gaps(spark, d):
    per = _det(spark, d).groupBy(*KEYS).agg(F.count("*").alias("n"))
    return table(spark, d, "frames").join(per, KEYS, "left").groupBy("stream_id").agg(F.count("*").alias("frames"), F.count_if(F.col("n").isNull()).alias("empty_frames"), F.coalesce(F.sum("n"), F.lit(0)).alias("detections"))


def pair_metrics(spark, d):
    a = _det(spark, d).select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in ("det_idx", "x1", "y1", "x2", "y2", "cx", "cy")])
    b = _det(spark, d).select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in ("det_idx", "x1", "y1", "x2", "y2", "cx", "cy")])
    j = a.join(b, KEYS).filter("a_det_idx < b_det_idx")
    box = lambda s: tuple(F.col(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2"))
    penalty = G.size_penalty(F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1"), F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"))
    return j.select(*KEYS, "a_det_idx", "b_det_idx", F.round(G.iou(box("a"), box("b")), 6).alias("iou"), F.round(G.distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy")), 4).alias("distance"), F.round(penalty, 5).alias("size_penalty"))


def dedup_greedy(spark, d):
    return _kept(spark, d).select(*KEYS, "det_idx")


def nms_iou(spark, d):
    return detections.nms(detections.keep(_det(spark, d))).select(*KEYS, "det_idx")


def frame_counters(spark, d):
    return metrics.frame_counts(detections.keep(_det(spark, d)), _kept(spark, d))


def camera_gate(spark, d):
    """The gate by shift, by shift and inliers (a frame's width in tens of pixels stands for its inliers), and without a limit."""
    dx, dy, inliers = F.col("cam_dx"), F.col("cam_dy"), F.col("width") / 100
    a, b, c = G.camera_gate(dx, dy, most_shift=3.0), G.camera_gate(dx, dy, inliers, 15, 3.0), G.camera_gate(dx, dy, most_shift=0)
    return table(spark, d, "frames").select(*KEYS, a[0].alias("applied"), a[1].alias("dx"), a[2].alias("dy"), b[0].alias("sure"), c[0].alias("free"), c[1].alias("free_dx"))


def gated_candidates(spark, d):
    """Candidate pairs of each frame's detections with those of the frame before, within the base gate."""
    now, before = _det(spark, d), _det(spark, d)
    a = before.select("stream_id", (F.col("frame_index") + 1).alias("frame_index"), F.col("det_idx").alias("prev_idx"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    j = now.join(a, KEYS).withColumn("distance", G.distance(F.col("cx"), F.col("cy"), F.col("px"), F.col("py"))).filter("distance <= 55")
    return j.select(*KEYS, "det_idx", "prev_idx", F.round("distance", 4).alias("distance"))


def association_anti(spark, d):
    """Detections that no one of the frame before reaches: those that may start tracks."""
    reached = gated_candidates(spark, d).select(*KEYS, "det_idx").distinct()
    return _det(spark, d).join(reached, [*KEYS, "det_idx"], "left_anti").filter("confidence >= 0.25").select(*KEYS, "det_idx")


def _tracker(spark, d):
    return tracker.track(table(spark, d, "frames"), _kept(spark, d), Scratch(spark))


def track_multi(spark, d):
    rounded = {c: F.round(c, 4) for c in ("cx", "cy", "x1", "y1", "x2", "y2", "vx", "vy")} | {"confidence": F.round("confidence", 6)}
    return _tracker(spark, d)[0].withColumns(rounded)


def track_diagnostics(spark, d):
    line = lambda s: F.concat_ws(" ", s["track_id"], *[F.format_string("%.3f", s[c][i] + 0.0) for c in ("center", "velocity") for i in (0, 1)], s["missing_frames"], s["motion_confirmed"], s["observed_this_frame"])
    return _tracker(spark, d)[1].withColumn("track_states", F.array_join(F.transform("track_states", line), "; "))


def frame_results_json(spark, d):
    """Lines of frames with their diagnostics, read back field by field."""
    t = _finite(_tracks(spark, d)).withColumn("hits", F.lit(1))
    camera = table(spark, d, "frames").select(*KEYS, "cam_dx")
    lines = files.frame_json(table(spark, d, "frames"), _kept(spark, d).withColumn("source", F.lit("detector")), t, camera)
    schema = "frame_index bigint, timestamp double, ball_detections array<struct<bbox:array<double>,center:array<double>,confidence:double,source:string>>, ball_tracks array<struct<track_id:bigint,status:string,center:array<double>,velocity:array<double>,roi:array<double>,hits:int>>, ball_track struct<track_id:bigint,confidence:double>, diagnostics struct<cam_dx:double>, width int"
    j = lines.select("stream_id", F.from_json("value", schema).alias("j"), (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"roi":null'), F.lit("")))).alias("nulls"))
    first = F.get("j.ball_tracks", F.lit(0))
    best = F.get("j.ball_detections", F.lit(0))
    return j.select(
        "stream_id", "j.frame_index", F.size("j.ball_detections").alias("detections"), F.size("j.ball_tracks").alias("tracks"), F.col("j.ball_track.track_id").alias("single"), F.round("j.ball_track.confidence", 6).alias("single_confidence"), first["status"].alias("status"), F.round(first["center"][0], 4).alias("cx"),
        F.round(first["velocity"][1], 4).alias("vy"), F.round(best["bbox"][2], 4).alias("x2"), best["source"].alias("source"), F.round("j.timestamp", 4).alias("timestamp"), F.round("j.diagnostics.cam_dx", 6).alias("cam_dx"), F.col("j.width").alias("width"), (F.col("nulls") / 10).cast("int").alias("nulls"),
    )


def track_trails(spark, d):
    return sequences.trails(_finite(_tracks(spark, d)), 30).select("stream_id", "track_id", "frame_index", F.size("trail").alias("points"), F.array_join(F.transform("trail", lambda p: F.format_string("%.3f %.3f", p["cx"], p["cy"])), "; ").alias("trail"))


def status_counts(spark, d):
    return metrics.status_counts(_tracks(spark, d))


def lost_events(spark, d):
    return sequences.lost(_tracks(spark, d)).filter("ball_lost").select("stream_id", "track_id", "frame_index")


def bounce_candidates(spark, d):
    return sequences.bounce_shape(_finite(_tracks(spark, d))).select("stream_id", "track_id", "frame_index", "decided_at")


def bounce_events(spark, d):
    return sequences.bounces(_finite(_tracks(spark, d)))


def leave_side(spark, d):
    return sequences.leave_side(_tracks(spark, d), table(spark, d, "frames"))


def confidence_decay(spark, d):
    return _tracks(spark, d).filter("missing_frames IS NOT NULL AND confidence IS NOT NULL").select("stream_id", "track_id", "frame_index", F.round(F.col("confidence") * F.pow(F.lit(0.82), F.col("missing_frames")), 6).alias("decayed"), F.round(F.col("confidence") * F.greatest(F.lit(0.0), 1 - F.col("missing_frames") / 4), 6).alias("linear"))


def velocity_lag(spark, d):
    v = sequences.measured_velocity(_finite(_tracks(spark, d)))
    return v.select("stream_id", "track_id", "frame_index", "mvx", "mvy")


def moving_average(spark, d):
    v = sequences.smoothed(_finite(_tracks(spark, d)))
    return v.select("stream_id", "track_id", "frame_index", F.round("mx", 4).alias("mx"), F.round("my", 4).alias("my"))


def kalman_smooth(spark, d):
    rows = _finite(_tracks(spark, d)).withColumn("cx", F.when(F.col("status") == "observed", F.col("cx"))).withColumn("cy", F.when(F.col("status") == "observed", F.col("cy")))
    started = rows.filter("status IN ('observed', 'predicted')")
    v = sequences.kalman_smooth(started)
    return v.select("stream_id", "track_id", "frame_index", F.round("sx", 3).alias("sx"), F.round("sy", 3).alias("sy"))


def track_metrics(spark, d):
    """Observed share, longest gap and mean age of tracks per stream."""
    t = _tracks(spark, d)
    return t.groupBy("stream_id").agg(F.countDistinct("track_id").alias("tracks"), F.round(F.count_if(F.col("status") == "observed") / F.count("*"), 6).alias("observed_share"), F.max("missing_frames").alias("longest_gap"))


# Fixed test plane: picture pixels to court feet.
PLANE = (0.016, 0.001, -1.0, 0.0005, 0.05, -2.0, 0.00001, 0.0002, 1.0)


def homography_project(spark, d):
    u, v = G.project([F.lit(x) for x in PLANE], F.col("cx"), F.col("y2"))
    return _det(spark, d).select(*KEYS, "det_idx", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


def homography_inverse(spark, d):
    x, y = G.unproject([F.lit(x) for x in PLANE], F.col("cx") / 100, F.col("cy") / 30)
    return _det(spark, d).select(*KEYS, "det_idx", F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


def zone_classify(spark, d):
    u, v = G.project([F.lit(x) for x in PLANE], F.col("cx"), F.col("y2"))
    z = G.zone(F.col("u"), F.col("v"))
    return _det(spark, d).select(*KEYS, "det_idx", u.alias("u"), v.alias("v")).select(*KEYS, "det_idx", z["zone"].alias("zone"), z["is_in_court"].alias("is_in_court"), z["is_nvz"].alias("is_nvz"))


def homography_cache(spark, d):
    v = table(spark, d, "frames").select(*KEYS, F.when(F.col("frame_index") % 47 == 5, F.col("cam_dx")).alias("h"))
    return sequences.cached(v, "h").select(*KEYS, "used", "projection_status")


def _labels(spark, d):
    """Label text of every record: boxes that are wider than high as outlines, ignored objects as lines of another class, and a null box as a line without numbers."""
    r, s = table(spark, d, "records"), table(spark, d, "sources")
    corner = lambda b, sx, sy: F.concat_ws(" ", F.format_string("%.6f", b["x"] + sx * b["w"] / 2), F.format_string("%.6f", b["y"] + sy * b["h"] / 2))

    def line(b):
        box = F.format_string("%d %.5f %.5f %.5f %.5f", F.col("ball_class"), b["x"], b["y"], b["w"], b["h"])
        outline = F.concat_ws(" ", F.col("ball_class").cast("string"), *[corner(b, x, y) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
        return F.when(b["w"].isNull() | b["h"].isNull() | b["x"].isNull() | b["y"].isNull(), "none").when(b["w"] > b["h"], outline).otherwise(box)

    text = F.concat(F.coalesce(F.array_join(F.transform("boxes", line), "\n"), F.lit("")), F.lit("\r\n\n"), F.array_join(F.array_repeat(F.lit("9 0.5 0.5 0.1 0.1"), F.coalesce(F.col("ignored_objects"), F.lit(0))), "\n"))
    parsed = cleaning.parse_labels(r.join(s, r["source"] == s["short_name"]).select(*r.columns, "ball_class", text.alias("label_text")))
    return parsed.withColumns({"boxes": F.col("parsed.boxes"), "ignored": F.col("parsed.ignored"), "converted": F.col("parsed.converted"), "errors": F.col("parsed.errors"), "messages": F.col("parsed.messages")})


def label_parse(spark, d):
    return _labels(spark, d).select("record_id", F.size("boxes").alias("boxes"), "ignored", "converted", "errors", F.array_join("messages", "; ").alias("messages"), F.round(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["w"] + 2 * b["y"]), 8).alias("sum"))


def label_errors(spark, d):
    return cleaning.error_list(_labels(spark, d)).select("record_id", "error")


def court_labels(spark, d):
    """Lines of court points made from boxes: one in a picture with a single box lacks a value, others have a second class."""
    b = lambda i: F.get("boxes", F.lit(i))
    values = F.array_join(F.array_repeat(F.format_string("%.5f", b(0)["x"]), 39), " ")
    text = F.when(F.size("boxes") == 1, F.concat(F.lit("0 "), values)).when(F.size("boxes") == 2, F.concat(F.lit("1 0.5 "), values)).when(F.size("boxes") > 2, F.concat(F.lit("0 0.5 "), values, F.lit("\n0 x "), values))
    return cleaning.parse_court_labels(table(spark, d, "records").filter("boxes IS NULL OR NOT exists(boxes, b -> b.x IS NULL)").select("record_id", text.alias("label_text"))).select("record_id", "court_error")


def norm_source_key(spark, d):
    return table(spark, d, "records").select("record_id", cleaning.source_key(F.col("source"), F.col("image")).alias("k"), cleaning.clip_key(F.col("source"), F.col("image")).alias("c"))


def dedup_variants(spark, d):
    return cleaning.best_variant(table(spark, d, "records")).select("record_id", "source_key")


def dedup_exact(spark, d):
    return cleaning.best_exact(table(spark, d, "records"), table(spark, d, "sources")).select("record_id", "image_hash")


def dedup_stats(spark, d):
    return cleaning.variant_stats(table(spark, d, "records"))


def exact_stats(spark, d):
    return cleaning.exact_stats(table(spark, d, "records"))


def negative_cap(spark, d):
    return cleaning.limit_negatives(table(spark, d, "records"), 0.25).select("record_id")


def _split(spark, d):
    return cleaning.grouped_split(table(spark, d, "records"))


def grouped_split(spark, d):
    return _split(spark, d)


def split_overlap_check(spark, d):
    """Source frames that the split by clip leaves in two splits, as they are filed under two clips: measured, by frame and clip."""
    return cleaning.split_overlap(table(spark, d, "records"), _split(spark, d))


def split_counts(spark, d):
    return cleaning.split_counts(table(spark, d, "records"))


def manifest(spark, d):
    return cleaning.manifest(table(spark, d, "records"))


def label_lines(spark, d):
    return cleaning.label_lines(table(spark, d, "records").withColumn("boxes", F.transform("boxes", lambda b: F.struct(*[F.round(b[c], 5).alias(c) for c in "xywh"]))))


def source_audit(spark, d):
    return cleaning.audit(_labels(spark, d))


def negative_stats(spark, d):
    return cleaning.negative_stats(table(spark, d, "records"))


def cleaned_splits(spark, d):
    """Counts of the split that the job makes."""
    done = cleaning.clean(table(spark, d, "records"), table(spark, d, "sources"))
    return cleaning.split_counts(done.filter("clean_split IS NOT NULL"), "clean_split")


def clean_pipeline(spark, d):
    """Variants, exact copies, negative cap, split by clip: records kept per source and splits."""
    done = cleaning.clean(table(spark, d, "records"), table(spark, d, "sources"))
    return done.groupBy("source", "original_split", "clean_split").agg(F.count("*").alias("records"))


def cleaning_report(spark, d):
    """The whole job from label text on, as the rows of its report."""
    return cleaning.report_rows(_labels(spark, d), table(spark, d, "sources"))


def _timings(spark, d):
    """Times of frames from the frames themselves: milliseconds since the frame before; the detector takes the camera's shift, and is skipped where that isn't known."""
    from pyspark.sql import Window

    spread, keys = haloed(table(spark, d, "frames").select(*KEYS, "ts_s", "cam_dx"), ["stream_id"], "frame_index", 1)
    step = (F.col("ts_s") - F.lag("ts_s").over(Window.partitionBy(*keys).orderBy("frame_index"))) * 1000
    return spread.withColumn("ms", step).filter("NOT halo AND ms > 0").select(*KEYS, "ms", F.abs("cam_dx").alias("detector_ms"), F.col("cam_dx").isNull().alias("detector_skipped"))


def latency_summary(spark, d):
    m = metrics.latency_report(_timings(spark, d), 20, ["stream_id"])
    return m.select("stream_id", "measured_frames", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def throughput(spark, d):
    return metrics.throughput(table(spark, d, "frames")).select("stream_id", "processed", F.round("elapsed_s", 6).alias("elapsed_s"), F.round("fps", 6).alias("fps"))


def stream_metadata(spark, d):
    return metrics.stream_metadata(table(spark, d, "frames")).withColumn("fps", F.round("fps", 4))


def ab_compare(spark, d):
    """Delivered tracks against the most confident detections, frame by frame."""
    a = _finite(_tracks(spark, d)).groupBy(*KEYS).agg(F.min_by("cx", "track_id").alias("x"), F.min_by("cy", "track_id").alias("y"))
    b = metrics.best_detection(_det(spark, d)).select(*KEYS, F.col("cx").alias("x"), F.col("cy").alias("y"))
    return metrics.compare(a, b, ["stream_id"]).select("stream_id", "both", "only_a", "only_b", F.round("mean_distance", 4).alias("mean_distance"), F.round("max_distance", 4).alias("max_distance"))


def _watched(spark, d):
    """One row a frame: the first track of it, the picture, and the projection status of a plane that comes with every known camera shift."""
    t = _tracks(spark, d).groupBy(*KEYS).agg(F.min_by(F.struct("status", "cx", "cy"), "track_id").alias("t"))
    plane = sequences.cached(table(spark, d, "frames").select(*KEYS, "width", "height", F.when(F.col("cam_dx") > 1.5, F.col("cam_dx")).alias("h")), "h")
    return plane.join(t, KEYS, "left").select(*KEYS, "t.status", "t.cx", "t.cy", "width", "height", "projection_status")


def event_flags(spark, d):
    return events.flags(_watched(spark, d))


def frame_events(spark, d):
    return events.events(_watched(spark, d))


def projection_anchor(spark, d):
    """Foot of a delivered box, else the center."""
    w = table(spark, d, "ball_tracks").filter("track_id IS NOT NULL")
    b = lambda i: F.get("bbox", F.lit(i))
    c = lambda i: F.get("center", F.lit(i))
    u, v = G.anchor(b(0), b(2), b(3), c(0), c(1))
    colour, radius = G.marker(F.col("track_id"), b(0), b(1), b(2), b(3))
    return w.select("row_id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), colour.alias("colour"), radius.alias("radius"))


def keypoint_ema(spark, d):
    return sequences.smoothed_points(_finite(_tracks(spark, d)).select("stream_id", "track_id", "frame_index", F.col("cx").alias("x"), F.col("cy").alias("y")), ["stream_id", "track_id"])


def frame_timestamp(spark, d):
    return table(spark, d, "frames").select(*KEYS, F.round(G.timestamp(F.col("frame_index"), F.when(F.col("cam_dx").isNotNull(), F.col("width") / 32)), 6).alias("t"))


def court_observations(spark, d):
    o = court.observations(_keypoints(spark, d), "manual")
    return o.select("stream_id", F.array_join(F.transform("visible_indices", lambda i: i.cast("string")), " ").alias("visible"), "num_visible", "is_reliable", "source")


def court_lines(spark, d):
    return court.lines(spark, "top").select("line", "a", "b", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("length"))


def regression_gate(spark, d):
    """Mean confidence as map50 and observed share as recall: each stream against the mean of all."""
    t = _tracks(spark, d)
    agg = [F.avg("confidence").alias("map50"), F.avg((F.col("status") == "observed").cast("double")).alias("recall")]
    current = t.groupBy(F.col("stream_id").alias("model")).agg(*agg)
    baseline = current.select("model").crossJoin(F.broadcast(t.agg(*agg)))
    return metrics.gate(current, baseline).select("model", F.round("map50_drop", 6).alias("map50_drop"), F.round("recall_drop", 6).alias("recall_drop"), "accepted")


def skip_existing(spark, d):
    done = _det(spark, d).select("stream_id", F.when(F.col("class_id") == 0, "video").otherwise("jsonl").alias("kind"))
    return metrics.todo(table(spark, d, "frames").select("stream_id").distinct(), done)


def rolling_fps(spark, d):
    return sequences.rolling_rate(table(spark, d, "frames")).select(*KEYS, F.round("fps", 3).alias("smooth_fps"))


def best_detection(spark, d):
    return metrics.best_detection(_det(spark, d))


def _runs(spark, d):
    n = _det(spark, d).groupBy("stream_id").agg(F.count("*").alias("n"))
    f = table(spark, d, "frames").select("stream_id").distinct().join(n, "stream_id", "left")
    status = F.when(F.col("n").isNull(), "skipped").when(F.col("n") < 20, "failed").otherwise("succeeded")
    return f.select(F.col("stream_id").alias("position"), "stream_id", status.alias("status"))


def batch_summary(spark, d):
    return metrics.batch_summary(_runs(spark, d))


def batch_fail_fast(spark, d):
    return metrics.stop_at_failure(_runs(spark, d), True).groupBy("status").agg(F.count("*").alias("n"))


def search_region(spark, d):
    j = _det(spark, d).join(table(spark, d, "frames").select(*KEYS, "width", "height"), KEYS)
    return j.select(*KEYS, "det_idx", court.search_region(F.col("cx"), F.col("cy"), F.col("width"), F.col("height")).alias("roi"))


def court_pixels(spark, d):
    u, v = court.mini_pixel(F.col("cx") / 100, F.col("cy") / 30, 220, 440)
    return _det(spark, d).select(*KEYS, "det_idx", u.alias("u"), v.alias("v"))


def _keypoints(spark, d):
    """Court points seen through the inverse of the test plane; each stream lacks one of them."""
    x, y = G.unproject([F.lit(v) for v in PLANE], F.col("court_x"), F.col("court_y"))
    seen = court.layout(spark).select("kp", (x + 400).alias("x"), (y + 400).alias("y"))
    streams = table(spark, d, "frames").groupBy("stream_id").agg(F.count("*").alias("n"))
    return streams.crossJoin(F.broadcast(seen)).filter("n % 14 <> kp").select("stream_id", "kp", "x", "y")


def court_coverage(spark, d):
    return court.coverage(_keypoints(spark, d).filter("kp % 3 = 0"))


def homography_fit(spark, d):
    return court.fit(_keypoints(spark, d)).select("stream_id", "points", "status", "inlier_ratio", "mean_error_px")


def track_single(spark, d):
    rounded = {c: F.round(c, 4) for c in ("cx", "cy", "vx", "vy")} | {"confidence": F.round("confidence", 6)}
    return single.run(table(spark, d, "frames"), _kept(spark, d)).withColumns(rounded)


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_spikes, det_conf_tiers, det_filter, det_box_forms, det_letterbox, det_crop, det_topk_per_frame, det_decode, det_none, det_failure, frame_sampling, frame_range, frame_spine_gaps, pair_metrics, dedup_greedy, nms_iou,
        frame_counters, camera_gate, gated_candidates, association_anti, track_multi, track_diagnostics, frame_results_json, track_trails, status_counts, lost_events, bounce_candidates, bounce_events, leave_side, confidence_decay, velocity_lag,
        moving_average, kalman_smooth, track_metrics, homography_project, homography_inverse, zone_classify, homography_cache, label_parse, label_errors, court_labels, norm_source_key, dedup_variants, dedup_exact, dedup_stats, exact_stats,
        negative_cap, negative_stats, grouped_split, split_overlap_check, split_counts, cleaned_splits, manifest, label_lines, source_audit, clean_pipeline, cleaning_report, latency_summary, throughput, stream_metadata, ab_compare, event_flags, frame_events,
        projection_anchor, keypoint_ema, frame_timestamp, court_observations, court_lines, regression_gate, skip_existing, rolling_fps, best_detection, batch_summary, batch_fail_fast, search_region, court_pixels, court_coverage, homography_fit,
        track_single,
    )
}
