"""SQL for the queries of the registry, written from the definitions."""

from . import tracker_sql as T

_DET = "det AS (SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index, det_idx ORDER BY source NULLS LAST, x1, y1) = 1)"
_KEEP = "kept AS (SELECT * FROM det WHERE confidence >= 0.15 AND class_id = 0)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY confidence DESC, det_idx) rk FROM kept)"
_INTER = "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1)) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1))"
_AREAS = "(k.x2 - k.x1) * (k.y2 - k.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)"


def _greedy(clash: str) -> str:
    return f"""WITH RECURSIVE {_DET}, {_KEEP}, {_RANKED},
fold AS (
  SELECT stream_id, frame_index, 0::BIGINT rk, []::STRUCT(det_idx INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, cx DOUBLE, cy DOUBLE)[] kl FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.stream_id, r.frame_index, r.rk, CASE WHEN len(list_filter(f.kl, lambda k: {clash})) > 0 THEN f.kl
    ELSE list_append(f.kl, {{'det_idx': r.det_idx, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'cx': r.cx, 'cy': r.cy}}) END
  FROM fold f JOIN ranked r ON f.stream_id = r.stream_id AND f.frame_index = r.frame_index AND r.rk = f.rk + 1),
done AS (SELECT stream_id, frame_index, unnest(kl) k FROM fold QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY rk DESC) = 1),
final AS (SELECT stream_id, frame_index, k.det_idx det_idx FROM
  (SELECT stream_id, frame_index, kl FROM fold QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY rk DESC) = 1) t, unnest(t.kl) u(k))
"""


_SIDE = "greatest(1, k.x2 - k.x1, k.y2 - k.y1, r.x2 - r.x1, r.y2 - r.y1)"
_DEDUP = _greedy(f"(({_AREAS}) - ({_INTER}) > 0 AND ({_INTER}) >= 0.2 * (({_AREAS}) - ({_INTER}))) OR sqrt(pow(k.cx - r.cx, 2) + pow(k.cy - r.cy, 2)) <= greatest(6.0, 0.75 * {_SIDE})").replace(
    "done AS (SELECT stream_id, frame_index, unnest(kl) k FROM fold QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY rk DESC) = 1),\n", ""
)
_NMS = _greedy(f"({_INTER}) > 0.5 * (({_AREAS}) - ({_INTER}))").replace(
    "done AS (SELECT stream_id, frame_index, unnest(kl) k FROM fold QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY rk DESC) = 1),\n", ""
)

_T = r"""t AS (SELECT stream_id, track_id, frame_index, regexp_replace(lower(regexp_replace(status, '\s', '', 'g')), '^.*\.', '') status, center[1] cx, center[2] cy, velocity[1] vx, velocity[2] vy, confidence, missing_frames
  FROM ball_tracks WHERE track_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream_id, track_id, frame_index ORDER BY row_id) = 1)"""
_FIN = "fin AS (SELECT * FROM t WHERE cx IS NOT NULL AND NOT isnan(cx) AND NOT isnan(cy) AND abs(cx) < 1e12 AND abs(cy) < 1e12)"
_W = "WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_index)"
_N = "coalesce(len(boxes), 0)"
_STEM = r"regexp_replace(regexp_replace(regexp_replace(image, '^.*/', ''), '(.)\.[^.]*$', '\1'), '\.rf\.[0-9a-fA-F]{16,}$', '')"
_BARE = f"regexp_replace(lower({_STEM}), '^kevin_', '')"
_C = rf"regexp_replace(regexp_replace(lower({_STEM}), '\.rf\.[0-9a-f]{{16,}}$', ''), '^kevin_', '')"
_CLIP = rf"""CASE WHEN regexp_matches({_C}, '-\d{{4}}-\d{{2}}-\d{{2}}t\d{{6}}-\d+_(jpg|jpeg|png)$') THEN regexp_replace({_C}, '-\d{{4}}-\d{{2}}-\d{{2}}t\d{{6}}-\d+_(jpg|jpeg|png)$', '')
  WHEN regexp_matches({_C}, '_\d{{2}}m\d{{2}}s_frame_\d+_(jpg|jpeg|png)$') THEN regexp_replace({_C}, '_\d{{2}}m\d{{2}}s_frame_\d+_(jpg|jpeg|png)$', '')
  ELSE regexp_replace({_C}, '[-_]\d+-?_(jpg|jpeg|png)$', '') END"""
_VARIANTS = f"SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY coalesce(source_key, record_id::VARCHAR) ORDER BY ({_N} > 0) DESC, {_N} DESC, coalesce(file_size, -1) DESC, sha1(image) DESC, record_id) = 1"
_EXACT = f"SELECT r.* FROM {{0}} r LEFT JOIN sources s ON r.source = s.short_name QUALIFY row_number() OVER (PARTITION BY coalesce(image_hash, record_id::VARCHAR) ORDER BY ({_N} > 0) DESC, {_N} DESC, priority NULLS LAST, coalesce(file_size, -1) DESC, record_id) = 1"
_CAP = f"""SELECT * FROM {{0}} WHERE {_N} > 0 UNION ALL SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (ORDER BY sha1(coalesce(source_key, '')), record_id) rk FROM {{0}} WHERE {_N} = 0)
  WHERE rk <= (SELECT floor(count(*) * 0.25) FROM {{0}} WHERE {_N} > 0)"""
# Fixed test plane, as in the registry.
_H = "(0.016 * {x} + 0.001 * {y} - 1.0) / (0.00001 * {x} + 0.0002 * {y} + 1.0)", "(0.0005 * {x} + 0.05 * {y} - 2.0) / (0.00001 * {x} + 0.0002 * {y} + 1.0)"
_U, _V = (h.format(x="cx", y="y2") for h in _H)
_PLANE = f"plane AS (SELECT *, CASE WHEN ({_U}) BETWEEN -20 AND 40 AND ({_V}) BETWEEN -20 AND 64 THEN {_U} END u, CASE WHEN ({_U}) BETWEEN -20 AND 40 AND ({_V}) BETWEEN -20 AND 64 THEN {_V} END v FROM det)"
_CANDIDATES = f"""WITH {_DET}, cand AS (SELECT n.stream_id, n.frame_index, n.det_idx, p.det_idx prev_idx, sqrt(pow(n.cx - p.cx, 2) + pow(n.cy - p.cy, 2)) distance
  FROM det n JOIN det p ON n.stream_id = p.stream_id AND n.frame_index = p.frame_index + 1 WHERE sqrt(pow(n.cx - p.cx, 2) + pow(n.cy - p.cy, 2)) <= 55)"""

_BOUNCES = f"""WITH RECURSIVE {_T}, {_FIN}, s AS (SELECT *, lead(frame_index, 5) OVER w decided_at, count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) nb, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) na,
  max(cy) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) mb, max(cy) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) ma, min(cy) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) mi FROM fin WHERE status = 'observed' {_W}),
c AS (SELECT stream_id, track_id, decided_at, row_number() OVER (PARTITION BY stream_id, track_id ORDER BY decided_at) n FROM s WHERE nb = 5 AND na = 5 AND cy > mb AND cy >= ma AND mi > 0),
f AS (SELECT stream_id, track_id, n, decided_at frame_index, decided_at kept, true yes FROM c WHERE n = 1
  UNION ALL SELECT c.stream_id, c.track_id, c.n, c.decided_at, CASE WHEN c.decided_at - f.kept >= 15 THEN c.decided_at ELSE f.kept END, c.decided_at - f.kept >= 15 FROM f JOIN c ON f.stream_id = c.stream_id AND f.track_id = c.track_id AND c.n = f.n + 1)
SELECT stream_id, track_id, frame_index FROM f WHERE yes"""
# The adjugate of the test plane, times x = cx / 100 and y = cy / 30.
_INVERSE = f"""WITH {_DET}, p AS (SELECT *, 0.016::DOUBLE a, 0.001::DOUBLE b, -1::DOUBLE c, 0.0005::DOUBLE d, 0.05::DOUBLE e, -2::DOUBLE f, 0.00001::DOUBLE g, 0.0002::DOUBLE i, 1::DOUBLE j, cx / 100 x, cy / 30 y FROM det),
q AS (SELECT *, (e * j - f * i) * x + (c * i - b * j) * y + (b * f - c * e) u, (f * g - d * j) * x + (a * j - c * g) * y + (c * d - a * f) v, (d * i - e * g) * x + (b * g - a * i) * y + (a * e - b * d) w FROM p)
SELECT stream_id, frame_index, det_idx, round(u / w, 2) x, round(v / w, 2) y FROM q"""
_SPLITS = "WITH RECURSIVE " + T.grouped_split()
_CLEANED = f"""v AS MATERIALIZED ({_VARIANTS}), e AS MATERIALIZED ({_EXACT.format("v")}), c AS MATERIALIZED ({_CAP.format("e")}), """
_CLEAN = "WITH RECURSIVE " + _CLEANED + T.grouped_split("c") + f", done AS (SELECT c.*, {T.SPLIT_NAME} named, CASE WHEN k IS NOT NULL THEN named END clean_split FROM c LEFT JOIN placed USING (clip_key))\n"
# Lines of label text, box by box, as the registry writes them, and what becomes of each.
_IN = "b.v.{0} BETWEEN 0 AND 1"
_BOXED = """lines AS (SELECT r.*, list_transform(coalesce(boxes, []), lambda b, i: {'n': i, 'none': b.x IS NULL OR b.y IS NULL OR b.w IS NULL OR b.h IS NULL, 'wide': b.w > b.h, 'odd': NOT (isfinite(b.x) AND isfinite(b.y) AND isfinite(b.w) AND isfinite(b.h)),
    'v': {'x': round(CASE WHEN isfinite(b.x) THEN b.x END::DECIMAL(18, 9), 5)::DOUBLE, 'y': round(CASE WHEN isfinite(b.y) THEN b.y END::DECIMAL(18, 9), 5)::DOUBLE, 'w': round(CASE WHEN isfinite(b.w) THEN b.w END::DECIMAL(18, 9), 5)::DOUBLE, 'h': round(CASE WHEN isfinite(b.h) THEN b.h END::DECIMAL(18, 9), 5)::DOUBLE},
    'l': round(CASE WHEN isfinite(b.x - b.w / 2) THEN b.x - b.w / 2 END::DECIMAL(18, 9), 6)::DOUBLE, 'r': round(CASE WHEN isfinite(b.x + b.w / 2) THEN b.x + b.w / 2 END::DECIMAL(18, 9), 6)::DOUBLE, 't': round(CASE WHEN isfinite(b.y - b.h / 2) THEN b.y - b.h / 2 END::DECIMAL(18, 9), 6)::DOUBLE, 'b': round(CASE WHEN isfinite(b.y + b.h / 2) THEN b.y + b.h / 2 END::DECIMAL(18, 9), 6)::DOUBLE}) b
  FROM records r JOIN sources ON source = short_name),
kinds AS (SELECT *, list_transform(b, lambda q: {'n': q.n, 'outline': NOT q.none AND NOT q.odd AND q.wide AND q.l BETWEEN 0 AND 1 AND q.r BETWEEN 0 AND 1 AND q.t BETWEEN 0 AND 1 AND q.b BETWEEN 0 AND 1, 'bad': CASE WHEN q.none THEN 'non-numeric value' WHEN q.odd THEN 'non-finite coordinate'
    WHEN q.wide AND NOT (q.l BETWEEN 0 AND 1 AND q.r BETWEEN 0 AND 1 AND q.t BETWEEN 0 AND 1 AND q.b BETWEEN 0 AND 1) THEN 'polygon coordinate outside YOLO range'
    WHEN q.wide AND NOT (q.r > q.l AND q.b > q.t) THEN 'coordinate outside YOLO range'
    WHEN NOT q.wide AND NOT (q.v.x BETWEEN 0 AND 1 AND q.v.y BETWEEN 0 AND 1 AND q.v.w > 0 AND q.v.w <= 1 AND q.v.h > 0 AND q.v.h <= 1) THEN 'coordinate outside YOLO range' END,
    'box': CASE WHEN q.wide THEN {'x': (q.l + q.r) / 2, 'y': (q.t + q.b) / 2, 'w': q.r - q.l, 'h': q.b - q.t} ELSE q.v END}) k FROM lines),
parsed AS MATERIALIZED (SELECT * EXCLUDE (boxes, b, k), list_transform(list_filter(k, lambda x, i: x.bad IS NULL AND len(list_filter(k[1:i - 1], lambda y: y.bad IS NULL AND y.box = x.box)) = 0), lambda x: x.box) boxes, coalesce(ignored_objects, 0) ignored, len(list_filter(k, lambda x: x.outline))::INT converted, len(list_filter(k, lambda x: x.bad IS NOT NULL))::INT errors,
  list_transform(list_filter(k, lambda x: x.bad IS NOT NULL), lambda x: 'line ' || x.n || ': ' || x.bad) messages FROM kinds)
"""
_LABELS = "WITH " + _BOXED
_ROW = "SELECT '{0}' section, {1} source, unnest([{2}]) name, unnest([{3}])::DOUBLE \"value\" FROM {4}"


def _row(section: str, values: dict[str, str], table: str, source: str = "NULL::VARCHAR") -> str:
    return _ROW.format(section, source, ", ".join(f"'{k}'" for k in values), ", ".join(f"({v})::DOUBLE" for v in values.values()), table)


_REPORT = "WITH RECURSIVE " + _BOXED + ", valid AS MATERIALIZED (SELECT * FROM parsed WHERE errors = 0), " + _CLEANED.replace("FROM records", "FROM valid", 1) + T.grouped_split("c") + f""", done AS (SELECT c.*, {T.SPLIT_NAME} clean_split FROM c JOIN placed USING (clip_key)),
sized AS (SELECT count(*) n, count(DISTINCT original_split) s, count(DISTINCT {_N}) b FROM valid WHERE source_key IS NOT NULL GROUP BY source_key),
same AS (SELECT count(*) n, count(DISTINCT boxes) b FROM v WHERE image_hash IS NOT NULL GROUP BY image_hash),
rows AS (
  SELECT * FROM (SELECT 'sources' section, source, unnest(['images', 'ball_boxes', 'ignored_objects', 'converted_polygon_boxes', 'positive_images', 'multi_ball_images', 'negative_images', 'invalid_images']) name,
    unnest([count(*), sum(len(boxes)), sum(ignored), sum(converted), nullif(count(*) FILTER (len(boxes) > 0), 0), nullif(count(*) FILTER (len(boxes) > 1), 0), nullif(count(*) FILTER (len(boxes) = 0), 0), nullif(count(*) FILTER (errors > 0), 0)])::DOUBLE "value" FROM parsed GROUP BY source)
  UNION ALL {_row("raw", {"raw_valid_records": "count(*)"}, "valid")}
  UNION ALL {_row("source_deduplication", {"unique_source_frames": "count(*)", "selected_positive_images": f"count(*) FILTER ({_N} > 0)", "selected_negative_images": f"count(*) FILTER ({_N} = 0)", "selected_ball_boxes": f"coalesce(sum({_N}), 0)"}, "v")}
  UNION ALL {_row("source_deduplication", {"variants_removed": "sum(n - 1)", "source_frames_leaking_across_original_splits": "count(*) FILTER (s > 1)", "variant_groups_with_ball_count_disagreement": "count(*) FILTER (b > 1)"}, "sized")}
  UNION ALL {_row("exact_deduplication", {"unique_images": "count(*)"}, "e")}
  UNION ALL {_row("exact_deduplication", {"exact_duplicates_removed": "sum(n - 1)", "duplicate_groups_with_label_disagreement": "count(*) FILTER (b > 1)"}, "same")}
  UNION ALL {_row("negative_sampling", {"positive_images": f"count(*) FILTER ({_N} > 0)", "available_negative_images": f"count(*) FILTER ({_N} = 0)", "kept_negative_images": f"least(count(*) FILTER ({_N} = 0), floor(count(*) FILTER ({_N} > 0) * 0.25))", "max_negative_to_positive_ratio": "0.25"}, "e")}
  UNION ALL SELECT 'cleaned_splits', NULL, clean_split, count(*)::DOUBLE FROM done GROUP BY clean_split
  UNION ALL SELECT 'cleaned_source_splits', source, clean_split, count(*)::DOUBLE FROM done GROUP BY source, clean_split
  UNION ALL {_row("clips", {"clip_groups": "count(*)"}, "placed")}
  UNION ALL SELECT 'clips', NULL, 'clip_group_overlap_after_resplit', count(*)::DOUBLE FROM (SELECT clip_key FROM done GROUP BY clip_key HAVING count(DISTINCT clean_split) > 1))
SELECT * FROM rows WHERE "value" IS NOT NULL"""
# One row a frame with its first track and the state of a plane that comes with every camera shift beyond 1.5.
_WATCH = f"""{_T}, held AS (SELECT stream_id, frame_index, width, height, last_value(CASE WHEN cam_dx > 1.5 THEN frame_index END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) h_at FROM frames),
one AS (SELECT stream_id, frame_index, arg_min({{'status': status, 'cx': cx, 'cy': cy}}, track_id) t FROM t GROUP BY ALL),
watched AS MATERIALIZED (SELECT h.stream_id, h.frame_index, t.status, t.cx, t.cy, width, height, CASE WHEN h_at IS NULL THEN 'none' WHEN h.frame_index = h_at THEN 'homography' WHEN h.frame_index - h_at <= 30 THEN 'cached' ELSE 'unavailable' END projection_status,
  row_number() OVER (PARTITION BY h.stream_id ORDER BY h.frame_index) n FROM held h LEFT JOIN one USING (stream_id, frame_index))
"""
_WATCHED = "WITH " + _WATCH
_NUMBER = "({0} IS NOT NULL AND NOT isnan({0}))"
_EVENTS = "WITH RECURSIVE " + _WATCH + f""", fold AS (
  SELECT stream_id, 0::BIGINT n, 0::BIGINT frame_index, []::VARCHAR[] events, false active, 0::BIGINT run, NULL::BIGINT bounced, NULL::DOUBLE x, NULL::DOUBLE y, []::DOUBLE[] heights FROM watched WHERE n = 1
  UNION ALL
  SELECT stream_id, n, frame_index, CASE WHEN status IS NULL THEN ['ball_missing'] ELSE list_concat(CASE WHEN status = 'observed' THEN CASE WHEN hit THEN ['ball_seen', 'bounce_candidate'] ELSE ['ball_seen'] END WHEN status = 'predicted' THEN CASE WHEN run + 1 > 5 THEN ['ball_lost'] ELSE [] END
      WHEN NOT active THEN [] WHEN side IS NULL THEN ['ball_lost'] ELSE ['ball_lost', 'leave_view_' || side] END, CASE WHEN projection_status IN ('homography', 'cached') THEN [] ELSE ['projection_unavailable'] END) END,
    coalesce(status IN ('observed', 'predicted'), false), CASE WHEN status = 'predicted' THEN run + 1 ELSE 0 END, CASE WHEN hit THEN frame_index ELSE bounced END, CASE WHEN status IS NOT NULL AND known THEN cx ELSE x END, CASE WHEN status IS NOT NULL AND known THEN cy ELSE y END, past FROM (
    SELECT *, coalesce(status = 'observed' AND {_NUMBER.format("cy")} AND len(past) = 11 AND list_min(past) > 0 AND (bounced IS NULL OR frame_index - bounced >= 15) AND past[6] > list_max(past[1:5]) AND past[6] >= list_max(past[7:11]), false) hit,
      CASE WHEN x <= 12 THEN 'left' WHEN x >= width - 12 THEN 'right' WHEN y <= 12 THEN 'top' WHEN y >= height - 12 THEN 'bottom' END side FROM (
    SELECT w.*, f.active, f.run, f.bounced, f.x, f.y, {_NUMBER.format("w.cx")} AND {_NUMBER.format("w.cy")} known, CASE WHEN w.status = 'observed' AND {_NUMBER.format("w.cy")} THEN list_append(f.heights, w.cy)[-11:] ELSE f.heights END past
    FROM fold f JOIN watched w ON f.stream_id = w.stream_id AND w.n = f.n + 1)))
SELECT stream_id, frame_index, events FROM fold WHERE n > 0"""

ORACLE = {
    "track_multi": T.tracker(_DEDUP) + T.TRACKS,
    "track_diagnostics": T.tracker(_DEDUP) + T.DIAGNOSTICS,
    "track_single": T.single(_DEDUP),
    "bounce_events": _BOUNCES,
    "homography_inverse": _INVERSE,
    "grouped_split": _SPLITS + f"SELECT clip_key, {T.SPLIT_NAME} clean_split FROM placed",
    "det_conf_tiers": f"WITH {_DET} SELECT stream_id, CASE WHEN confidence >= 0.25 THEN 'high' WHEN confidence >= 0.15 THEN 'low' ELSE 'none' END tier, count(*) n FROM det GROUP BY ALL",
    "det_filter": f"WITH {_DET}, {_KEEP} SELECT stream_id, frame_index, det_idx, confidence FROM kept WHERE NOT (cx BETWEEN 100 AND 400 AND cy BETWEEN 100 AND 300)",
    "det_box_forms": f"""WITH {_DET} SELECT stream_id, frame_index, det_idx, round(cx - (x2 - x1) / 2, 4) bx1, round(cy - (y2 - y1) / 2, 4) by1, round(cx + (x2 - x1) / 2, 4) bx2, round(cy + (y2 - y1) / 2, 4) by2,
  round((x1 + x2) / 2, 4) mx, round((y1 + y2) / 2, 4) my FROM det""",
    "det_letterbox": f"""WITH {_DET}, s AS (SELECT d.*, f.width, f.height, least(640 / f.width, 640 / f.height) sc FROM det d JOIN frames f USING (stream_id, frame_index))
SELECT stream_id, frame_index, det_idx, round_even((640 - round_even(width * sc, 0)) / 2 - 0.1, 0)::INT pad_left, round_even((640 - round_even(height * sc, 0)) / 2 - 0.1, 0)::INT pad_top,
  round(least(greatest(cx, 0), width), 4) x, round(least(greatest(cy, 0), height), 4) y FROM s""",
    "det_crop": f"""WITH {_DET}, p AS (SELECT d.stream_id, d.frame_index, det_idx, greatest(x1 - (x2 - x1) * 0.1, 0) a, greatest(y1 - (y2 - y1) * 0.1, 0) b, least(x2 + (x2 - x1) * 0.1, width) c, least(y2 + (y2 - y1) * 0.1, height) d
  FROM det d JOIN frames f USING (stream_id, frame_index))
SELECT stream_id, frame_index, det_idx, CASE WHEN c > a AND d > b THEN round(a, 4) END x1, CASE WHEN c > a AND d > b THEN round(b, 4) END y1, CASE WHEN c > a AND d > b THEN round(c, 4) END x2, CASE WHEN c > a AND d > b THEN round(d, 4) END y2 FROM p""",
    "det_topk_per_frame": f"WITH {_DET} SELECT stream_id, frame_index, det_idx, row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY confidence DESC, det_idx) rank FROM det QUALIFY rank <= 3",
    "det_decode": f"""WITH {_DET}, s AS (SELECT *, [confidence, confidence * class_id * 2, 0.01] sc, row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY det_idx) - 1 r FROM det)
SELECT stream_id, frame_index, r::INT "row", round(cx - (x2 - x1) / 2, 4) x1, round(cy + (y2 - y1) / 2, 4) y2, round(list_max(sc), 6) confidence, CASE WHEN confidence = list_max(sc) THEN 0 ELSE list_position(sc, list_max(sc)) - 1 END::INT class_id
FROM s WHERE list_max(sc) >= 0.15""",
    "det_none": "SELECT stream_id, frame_index, 0::BIGINT n FROM frames",
    "det_failure": f"""WITH {_DET}, f AS (SELECT stream_id, min(frame_index) off FROM det WHERE x2 - x1 < 4 GROUP BY stream_id)
SELECT stream_id, count(*) n, max(frame_index) last_frame FROM det LEFT JOIN f USING (stream_id) WHERE off IS NULL OR frame_index < off GROUP BY stream_id""",
    "frame_sampling": "SELECT stream_id, frame_index, (row_number() OVER (PARTITION BY stream_id ORDER BY frame_index) - 1) % 3 <> 0 detector_skipped FROM frames",
    "frame_range": "SELECT stream_id, frame_index, width FROM frames WHERE frame_index >= 50 AND frame_index < 150",
    "frame_spine_gaps": f"""WITH {_DET}, p AS (SELECT stream_id, frame_index, count(*) n FROM det GROUP BY ALL)
SELECT stream_id, count(*) frames, count(*) FILTER (n IS NULL) empty_frames, coalesce(sum(n), 0) detections FROM frames LEFT JOIN p USING (stream_id, frame_index) GROUP BY stream_id""",
    "pair_metrics": f"""WITH {_DET}, p AS (SELECT k.stream_id, k.frame_index, k.det_idx a_det_idx, r.det_idx b_det_idx, {_INTER} i, {_AREAS} s, sqrt(pow(k.cx - r.cx, 2) + pow(k.cy - r.cy, 2)) dist,
  abs(ln(greatest(r.x2 - r.x1, 1) / greatest(k.x2 - k.x1, 1))) + abs(ln(greatest(r.y2 - r.y1, 1) / greatest(k.y2 - k.y1, 1))) pen
  FROM det k JOIN det r ON k.stream_id = r.stream_id AND k.frame_index = r.frame_index AND k.det_idx < r.det_idx)
SELECT stream_id, frame_index, a_det_idx, b_det_idx, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) iou, round(dist, 4) distance, round(pen, 5) size_penalty FROM p""",
    "dedup_greedy": _DEDUP + "SELECT * FROM final",
    "nms_iou": _NMS + "SELECT * FROM final",
    "frame_counters": _DEDUP + ", a AS (SELECT stream_id, frame_index, count(*) raw FROM kept GROUP BY ALL), b AS (SELECT stream_id, frame_index, count(*) n FROM final GROUP BY ALL) SELECT stream_id, frame_index, raw, coalesce(n, 0) kept, raw - coalesce(n, 0) removed FROM a LEFT JOIN b USING (stream_id, frame_index)",
    "camera_gate": """SELECT stream_id, frame_index, coalesce(sqrt(cam_dx * cam_dx + cam_dy * cam_dy) <= 3, false) applied, CASE WHEN applied THEN cam_dx ELSE 0 END dx, CASE WHEN applied THEN cam_dy ELSE 0 END dy,
  coalesce(sqrt(cam_dx * cam_dx + cam_dy * cam_dy) <= 3 AND width / 100 >= 15, false) sure, cam_dx IS NOT NULL AND cam_dy IS NOT NULL free, CASE WHEN free THEN cam_dx ELSE 0 END free_dx FROM frames""",
    "gated_candidates": _CANDIDATES + " SELECT stream_id, frame_index, det_idx, prev_idx, round(distance, 4) distance FROM cand",
    "association_anti": _CANDIDATES + " SELECT stream_id, frame_index, det_idx FROM det ANTI JOIN cand USING (stream_id, frame_index, det_idx) WHERE confidence >= 0.25",
    "frame_results_json": _DEDUP + f""", {_T}, {_FIN}, a AS (SELECT f.stream_id, f.frame_index, count(*) n, arg_min(d.x2, det_idx) x2 FROM final f JOIN det d USING (stream_id, frame_index, det_idx) GROUP BY ALL),
b AS (SELECT stream_id, frame_index, count(*) m, min(track_id) id, any_value(confidence) conf, arg_min(status, track_id) status, arg_min(cx, track_id) cx, arg_min(vy, track_id) vy FROM fin GROUP BY ALL)
SELECT stream_id, frame_index, coalesce(n, 0)::INT detections, coalesce(m, 0)::INT tracks, CASE WHEN m = 1 THEN id END single, CASE WHEN m = 1 THEN round(conf, 6) END single_confidence, status, round(cx, 4) cx, round(vy, 4) vy, round(x2, 4) x2, CASE WHEN n > 0 THEN 'detector' END source,
  round(ts_s, 4) "timestamp", round(cam_dx, 6) cam_dx, width, (coalesce(m, 0) + CASE WHEN m = 1 THEN 1 ELSE 0 END)::INT nulls FROM frames LEFT JOIN a USING (stream_id, frame_index) LEFT JOIN b USING (stream_id, frame_index)""",
    "track_trails": f"""WITH {_T}, {_FIN}, i AS (SELECT *, frame_index - row_number() OVER w isl FROM fin {_W})
SELECT stream_id, track_id, frame_index, (count(*) OVER v)::INT points, array_to_string(list(printf('%.3f %.3f', cx, cy)) OVER v, '; ') trail FROM i WINDOW v AS (PARTITION BY stream_id, track_id, isl ORDER BY frame_index ROWS 29 PRECEDING)""",
    "status_counts": f"WITH {_T} SELECT stream_id, frame_index, count(*) FILTER (status = 'observed') observed, count(*) FILTER (status = 'predicted') predicted FROM t GROUP BY ALL",
    "lost_events": f"""WITH {_T}, g AS (SELECT *, sum((status <> 'predicted')::INT) OVER w g, lag(status) OVER w before FROM t {_W}),
h AS (SELECT *, sum((status = 'predicted')::INT) OVER (PARTITION BY stream_id, track_id, g ORDER BY frame_index) run FROM g)
SELECT stream_id, track_id, frame_index FROM h WHERE (status = 'predicted' AND run > 5) OR (status = 'absent' AND before <> 'absent')""",
    "bounce_candidates": f"""WITH {_T}, {_FIN}, s AS (SELECT *, lead(frame_index, 5) OVER w decided_at, count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) nb, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) na,
  max(cy) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) mb, max(cy) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) ma, min(cy) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) mi FROM fin WHERE status = 'observed' {_W})
SELECT stream_id, track_id, frame_index, decided_at FROM s WHERE nb = 5 AND na = 5 AND cy > mb AND cy >= ma AND mi > 0""",
    "leave_side": f"""WITH {_T}, l AS (SELECT *, last_value(cx IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) px, last_value(cy IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) py, lag(status) OVER w before FROM t {_W})
SELECT l.stream_id, track_id, l.frame_index, CASE WHEN px <= 12 THEN 'left' WHEN px >= width - 12 THEN 'right' WHEN py <= 12 THEN 'top' WHEN py >= height - 12 THEN 'bottom' END side
FROM l JOIN frames f USING (stream_id, frame_index) WHERE status = 'absent' AND before <> 'absent'""",
    "confidence_decay": f"WITH {_T} SELECT stream_id, track_id, frame_index, round(confidence * pow(0.82::DOUBLE, missing_frames), 6) decayed, round(confidence * greatest(0.0::DOUBLE, 1 - missing_frames / 4), 6) linear FROM t WHERE missing_frames IS NOT NULL AND confidence IS NOT NULL",
    "velocity_lag": f"WITH {_T}, {_FIN} SELECT stream_id, track_id, frame_index, (cx - lag(cx) OVER w) / greatest(1, frame_index - lag(frame_index) OVER w) mvx, (cy - lag(cy) OVER w) / greatest(1, frame_index - lag(frame_index) OVER w) mvy FROM fin WHERE status = 'observed' {_W}",
    "moving_average": f"WITH {_T}, {_FIN} SELECT stream_id, track_id, frame_index, round(avg(cx) OVER (w ROWS 2 PRECEDING), 4) mx, round(avg(cy) OVER (w ROWS 2 PRECEDING), 4) my FROM fin {_W}",
    "kalman_smooth": f"""WITH RECURSIVE {_T}, {_FIN}, r AS (SELECT stream_id, track_id, frame_index, CASE WHEN status = 'observed' THEN cx END cx, CASE WHEN status = 'observed' THEN cy END cy, min(CASE WHEN status = 'observed' THEN frame_index END) OVER (PARTITION BY stream_id, track_id) begun FROM fin WHERE status IN ('observed', 'predicted')),
s AS (SELECT *, row_number() OVER w n FROM r WHERE frame_index >= begun {_W}),
k AS (
  SELECT stream_id, track_id, frame_index, n, cx x, cy y, 0::DOUBLE vx, 0::DOUBLE vy, 100::DOUBLE a, 0::DOUBLE b, 100::DOUBLE c FROM s WHERE n = 1
  UNION ALL
  SELECT p.stream_id, p.track_id, p.frame_index, p.n,
    CASE WHEN m IS NULL THEN px ELSE px + pa / (pa + 16) * (m - px) END, CASE WHEN m IS NULL THEN py ELSE py + pa / (pa + 16) * (my - py) END,
    CASE WHEN m IS NULL THEN vx ELSE vx + pb / (pa + 16) * (m - px) END, CASE WHEN m IS NULL THEN vy ELSE vy + pb / (pa + 16) * (my - py) END,
    CASE WHEN m IS NULL THEN pa ELSE pa * 16 / (pa + 16) END, CASE WHEN m IS NULL THEN pb ELSE pb * 16 / (pa + 16) END, CASE WHEN m IS NULL THEN pc ELSE pc - pb * pb / (pa + 16) END
  FROM (SELECT s.stream_id, s.track_id, s.frame_index, s.n, s.cx m, s.cy my, k.x + k.vx px, k.y + k.vy py, k.vx, k.vy, k.a + 2 * k.b + k.c + 36 pa, k.b + k.c + 72 pb, k.c + 144 pc
    FROM k JOIN s ON k.stream_id = s.stream_id AND k.track_id = s.track_id AND s.n = k.n + 1) p)
SELECT stream_id, track_id, frame_index, round(x, 3) sx, round(y, 3) sy FROM k UNION ALL SELECT stream_id, track_id, frame_index, NULL, NULL FROM r WHERE begun IS NULL OR frame_index < begun""",
    "track_metrics": f"WITH {_T} SELECT stream_id, count(DISTINCT track_id) tracks, round(count(*) FILTER (status = 'observed') / count(*), 6) observed_share, max(missing_frames) longest_gap FROM t GROUP BY stream_id",
    "homography_project": f"WITH {_DET}, {_PLANE} SELECT stream_id, frame_index, det_idx, round(u, 4) u, round(v, 4) v FROM plane",
    "zone_classify": f"""WITH {_DET}, {_PLANE}, z AS (SELECT *, CASE WHEN u IS NULL OR v IS NULL THEN 'unknown' WHEN u < -0.1 OR u > 20.1 OR v < -0.1 OR v > 44.1 THEN 'out_of_court' WHEN v < 15 THEN 'far_' || CASE WHEN u < 10 THEN 'left' ELSE 'right' END || '_service'
  WHEN v < 22 THEN 'far_nvz' WHEN v < 29 THEN 'near_nvz' ELSE 'near_' || CASE WHEN u < 10 THEN 'left' ELSE 'right' END || '_service' END zone FROM plane)
SELECT stream_id, frame_index, det_idx, zone, zone NOT IN ('unknown', 'out_of_court') is_in_court, zone IN ('far_nvz', 'near_nvz') is_nvz FROM z""",
    "homography_cache": """WITH v AS (SELECT stream_id, frame_index, CASE WHEN frame_index % 47 = 5 THEN cam_dx END h FROM frames),
l AS (SELECT *, last_value(h IGNORE NULLS) OVER w h_last, last_value(CASE WHEN h IS NOT NULL THEN frame_index END IGNORE NULLS) OVER w h_at FROM v WINDOW w AS (PARTITION BY stream_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING))
SELECT stream_id, frame_index, CASE WHEN frame_index - h_at <= 30 THEN h_last END used, CASE WHEN h_at IS NULL THEN 'none' WHEN frame_index = h_at THEN 'homography' WHEN frame_index - h_at <= 30 THEN 'cached' ELSE 'unavailable' END projection_status FROM l""",
    "label_parse": _LABELS + """SELECT record_id, len(boxes)::INT boxes, ignored, converted, errors, array_to_string(messages, '; ') messages, round(coalesce(list_sum(list_transform(boxes, lambda b: b.w + 2 * b.y)), 0), 8) "sum" FROM parsed""",
    "label_errors": _LABELS + """SELECT record_id, coalesce(image, '') || ': ' || array_to_string(messages, '; ') error FROM parsed WHERE errors > 0 ORDER BY record_id LIMIT 100""",
    "court_labels": """SELECT record_id, CASE len(boxes) WHEN 1 THEN 'line 1: expected 41 values, got 40' WHEN 2 THEN 'line 1: invalid class or coordinate' WHEN 0 THEN NULL ELSE CASE WHEN NOT isfinite(boxes[1].x) THEN 'line 1: invalid class or coordinate' WHEN boxes IS NOT NULL THEN 'line 2: non-numeric value' END END court_error
FROM records WHERE boxes IS NULL OR len(list_filter(boxes, lambda b: b.x IS NULL)) = 0""",
    "norm_source_key": rf"""SELECT record_id, CASE WHEN regexp_matches({_BARE}, '^pickleball\d+_mp4-') THEN 'moving_family:' || {_BARE} ELSE source || ':' || lower({_STEM}) END k,
  CASE WHEN regexp_matches({_CLIP}, '^pickleball\d+_mp4$') THEN 'moving_family:' || ({_CLIP}) ELSE source || ':' || ({_CLIP}) END c FROM records""",
    "dedup_variants": f"SELECT record_id, source_key FROM ({_VARIANTS})",
    "dedup_exact": f"SELECT record_id, image_hash FROM ({_EXACT.format('records')})",
    "dedup_stats": f"SELECT count(*) frames, sum(n - 1)::BIGINT variants_removed, count(*) FILTER (s > 1) leaking, count(*) FILTER (b > 1) disagreeing FROM (SELECT count(*) n, count(DISTINCT original_split) s, count(DISTINCT {_N}) b FROM records WHERE source_key IS NOT NULL GROUP BY source_key)",
    "exact_stats": "SELECT count(*) images, sum(n - 1)::BIGINT duplicates_removed, count(*) FILTER (b > 1) disagreeing FROM (SELECT count(*) n, count(DISTINCT coalesce(boxes, [])) b FROM records WHERE image_hash IS NOT NULL GROUP BY image_hash)",
    "negative_cap": f"SELECT record_id FROM ({_CAP.format('records')})",
    "split_overlap_check": _SPLITS + """, j AS (SELECT clip_key, source_key, k FROM records JOIN placed USING (clip_key))
SELECT (SELECT count(*) FROM (SELECT clip_key FROM j GROUP BY clip_key HAVING count(DISTINCT k) > 1)) clips, (SELECT count(*) FROM (SELECT source_key FROM j WHERE source_key IS NOT NULL GROUP BY source_key HAVING count(DISTINCT k) > 1)) frames""",
    "split_counts": "SELECT assigned_split, source, count(*) n, grouping_id(assigned_split, source) level FROM records GROUP BY ROLLUP (assigned_split, source)",
    "negative_stats": f"SELECT count(*) FILTER ({_N} > 0) positive_images, count(*) FILTER ({_N} = 0) available_negative_images, least(count(*) FILTER ({_N} = 0), floor(count(*) FILTER ({_N} > 0) * 0.25)::BIGINT) kept_negative_images, 0.25::DOUBLE max_negative_to_positive_ratio FROM records",
    "cleaned_splits": _CLEAN + f"SELECT clean_split, source, count(*) n, grouping_id(clean_split, source) level FROM done WHERE clean_split IS NOT NULL GROUP BY ROLLUP (clean_split, source)",
    "manifest": f"""SELECT assigned_split clean_split, assigned_split || '/images/' || source || '__' || substr(sha1(source || ':' || coalesce(source_key, '') || ':' || coalesce(image_hash, '')), 1, 16) || lower(regexp_extract(image, '[^/](\\.[^./]*)$', 1)) clean_image, source source_dataset,
  original_split source_split, image source_image, source_key source_frame_key, clip_key, {_N}::INT ball_count, ignored_objects ignored_non_ball_objects, image_hash content_fingerprint FROM records""",
    "label_lines": "SELECT record_id, array_to_string(list_transform(boxes, lambda b: printf('0 %.8f %.8f %.8f %.8f', round(b.x, 5), round(b.y, 5), round(b.w, 5), round(b.h, 5)) || chr(10)), '').replace('nan', 'NaN') label_text FROM records",
    "source_audit": _LABELS + """SELECT source, count(*) images, sum(len(boxes))::BIGINT ball_boxes, sum(ignored)::BIGINT ignored_objects, sum(converted)::BIGINT converted_polygon_boxes, nullif(count(*) FILTER (len(boxes) > 0), 0) positive_images, nullif(count(*) FILTER (len(boxes) > 1), 0) multi_ball_images,
  nullif(count(*) FILTER (len(boxes) = 0), 0) negative_images, nullif(count(*) FILTER (errors > 0), 0) invalid_images FROM parsed GROUP BY source""",
    "clean_pipeline": _CLEAN + "SELECT source, original_split, clean_split, count(*) records FROM done GROUP BY ALL",
    "cleaning_report": _REPORT,
    "latency_summary": """WITH t AS (SELECT stream_id, frame_index, (ts_s - lag(ts_s) OVER (PARTITION BY stream_id ORDER BY frame_index)) * 1000 ms, abs(cam_dx) dms FROM frames)
SELECT stream_id, count(ms) measured_frames, round(avg(ms), 6) pipeline_ms_mean, round(quantile_cont(ms, 0.5), 6) pipeline_ms_p50, round(quantile_cont(ms, 0.95), 6) pipeline_ms_p95, round(1000 / avg(ms), 6) throughput_fps, round(coalesce(avg(dms), 0), 6) detector_ms_mean,
  round(coalesce(quantile_cont(dms, 0.95), 0), 6) detector_ms_p95 FROM t WHERE ms > 0 AND frame_index >= 20 GROUP BY stream_id""",
    "throughput": "SELECT stream_id, count(*) processed, round(max(ts_s) - min(ts_s), 6) elapsed_s, CASE WHEN max(ts_s) > min(ts_s) THEN round(count(*) / (max(ts_s) - min(ts_s)), 6) END fps FROM frames GROUP BY stream_id",
    "stream_metadata": """WITH s AS (SELECT stream_id, arg_max(width, (n, width, height)) width, arg_max(height, (n, width, height)) height FROM (SELECT stream_id, width, height, count(*) n FROM frames GROUP BY ALL) GROUP BY stream_id)
SELECT stream_id, frames, first_frame, last_frame, width, height, round(CASE WHEN slope > 0 THEN 1 / slope ELSE 30 END, 4) fps FROM (SELECT stream_id, count(*) frames, min(frame_index) first_frame, max(frame_index) last_frame, regr_slope(ts_s, frame_index::DOUBLE) slope FROM frames GROUP BY stream_id) JOIN s USING (stream_id)""",
    "ab_compare": f"""WITH {_DET}, {_T}, {_FIN}, a AS (SELECT stream_id, frame_index, arg_min(cx, track_id) ax, arg_min(cy, track_id) ay FROM fin GROUP BY ALL),
b AS (SELECT stream_id, frame_index, cx bx, cy "by" FROM det QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY confidence DESC, det_idx) = 1),
j AS (SELECT *, sqrt(pow(ax - bx, 2) + pow(ay - "by", 2)) far FROM a FULL JOIN b USING (stream_id, frame_index))
SELECT stream_id, count(*) FILTER (ax IS NOT NULL AND bx IS NOT NULL) "both", count(*) FILTER (bx IS NULL) only_a, count(*) FILTER (ax IS NULL) only_b, round(avg(far), 4) mean_distance, round(max(far), 4) max_distance FROM j GROUP BY stream_id""",
    "event_flags": _WATCHED + """SELECT stream_id, frame_index, coalesce(status = 'observed', false) seen, status IS NULL missing, status IS NOT NULL AND projection_status NOT IN ('homography', 'cached') projection_unavailable FROM watched""",
    "frame_events": _EVENTS,
    "projection_anchor": """WITH b AS (SELECT *, bbox[1] x1, bbox[2] y1, bbox[3] x2, bbox[4] y2 FROM ball_tracks WHERE track_id IS NOT NULL),
h AS (SELECT *, trunc(greatest(round_even(x2, 0) - round_even(x1, 0), round_even(y2, 0) - round_even(y1, 0)) / 2)::INT half FROM b)
SELECT row_id, round(CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL THEN (x1 + x2) / 2 ELSE center[1] END, 4) u, round(CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL THEN y2 ELSE center[2] END, 4) v,
  (track_id - 1) % 7 colour, CASE WHEN x1 IS NULL THEN 7 ELSE greatest(5, least(15, half)) END radius FROM h""",
    "keypoint_ema": f"""WITH RECURSIVE {_T}, {_FIN}, s AS (SELECT stream_id, track_id, frame_index, cx, cy, row_number() OVER w n FROM fin {_W}),
e AS (SELECT stream_id, track_id, frame_index, n, cx sx, cy sy FROM s WHERE n = 1
  UNION ALL SELECT s.stream_id, s.track_id, s.frame_index, s.n, 0.35::DOUBLE * s.cx + 0.65::DOUBLE * e.sx, 0.35::DOUBLE * s.cy + 0.65::DOUBLE * e.sy FROM e JOIN s ON e.stream_id = s.stream_id AND e.track_id = s.track_id AND s.n = e.n + 1)
SELECT stream_id, track_id, frame_index, sx, sy FROM e""",
    "frame_timestamp": "SELECT stream_id, frame_index, round(frame_index / CASE WHEN cam_dx IS NOT NULL THEN width / 32 ELSE 30 END, 6) t FROM frames",
    "court_observations": """WITH s AS (SELECT stream_id, count(*) n FROM frames GROUP BY ALL), j AS (SELECT stream_id, kp FROM s, (SELECT unnest(range(14)) kp) WHERE n % 14 <> kp)
SELECT stream_id, string_agg(kp::VARCHAR, ' ' ORDER BY kp) visible, count(*)::INT num_visible, count(*) >= 4 is_reliable, 'manual' source FROM j GROUP BY stream_id""",
    "court_lines": """SELECT * FROM (VALUES (0, 0, 2, 20.0::DOUBLE), (1, 11, 13, 20), (2, 0, 11, 44), (3, 2, 13, 44), (4, 6, 7, 20), (5, 3, 5, 20), (6, 8, 10, 20), (7, 1, 4, 15), (8, 9, 12, 15), (9, 3, 8, 14), (10, 5, 10, 14)) t(line, a, b, length)""",
    "regression_gate": f"""WITH {_T}, c AS (SELECT stream_id model, avg(confidence) m, avg((status = 'observed')::INT) r FROM t GROUP BY stream_id), b AS (SELECT avg(confidence) bm, avg((status = 'observed')::INT) br FROM t)
SELECT model, round(bm - m, 6) map50_drop, round(br - r, 6) recall_drop, NOT (bm - m > 0.015 OR br - r > 0.02) accepted FROM c, b""",
    "skip_existing": f"WITH {_DET} SELECT DISTINCT stream_id FROM frames WHERE stream_id NOT IN (SELECT stream_id FROM det GROUP BY stream_id HAVING count(DISTINCT class_id = 0) >= 2)",
    "rolling_fps": """WITH g AS (SELECT stream_id, frame_index, ts_s - lag(ts_s) OVER (PARTITION BY stream_id ORDER BY frame_index) dt FROM frames WHERE ts_s IS NOT NULL)
SELECT stream_id, frame_index, round(avg(CASE WHEN dt > 0 THEN 1 / dt END) OVER (PARTITION BY stream_id ORDER BY frame_index ROWS 29 PRECEDING), 3) smooth_fps FROM g""",
    "best_detection": f"WITH {_DET} SELECT stream_id, frame_index, det_idx, cx, cy, confidence FROM det QUALIFY row_number() OVER (PARTITION BY stream_id, frame_index ORDER BY confidence DESC, det_idx) = 1",
    "batch_summary": f"""WITH {_DET}, n AS (SELECT stream_id, count(*) n FROM det GROUP BY ALL), s AS (SELECT DISTINCT stream_id, n FROM frames LEFT JOIN n USING (stream_id))
SELECT count(*) FILTER (n >= 20) succeeded, count(*) FILTER (n IS NULL) skipped, count(*) FILTER (n < 20) failed, (count(*) FILTER (n < 20) > 0)::INT exit_code FROM s""",
    "batch_fail_fast": f"""WITH {_DET}, n AS (SELECT stream_id, count(*) n FROM det GROUP BY ALL), s AS (SELECT DISTINCT stream_id, n FROM frames LEFT JOIN n USING (stream_id)), f AS (SELECT min(stream_id) stop FROM s WHERE n < 20)
SELECT CASE WHEN stream_id > stop THEN 'not_run' WHEN n IS NULL THEN 'skipped' WHEN n < 20 THEN 'failed' ELSE 'succeeded' END status, count(*) n FROM s, f GROUP BY 1""",
    "search_region": f"""WITH {_DET}, a AS (SELECT d.stream_id, d.frame_index, det_idx, greatest(cx - 120, 0) x1, greatest(cy - 120, 0) y1, least(cx + 120, width) x2, least(cy + 120, height) y2, width, height FROM det d JOIN frames f USING (stream_id, frame_index))
SELECT stream_id, frame_index, det_idx, [round_even(CASE WHEN x2 - x1 < 60 THEN greatest((x1 + x2) / 2 - 30, 0) ELSE x1 END, 1), round_even(CASE WHEN y2 - y1 < 60 THEN greatest((y1 + y2) / 2 - 30, 0) ELSE y1 END, 1),
  round_even(CASE WHEN x2 - x1 < 60 THEN least((x1 + x2) / 2 + 30, width) ELSE x2 END, 1), round_even(CASE WHEN y2 - y1 < 60 THEN least((y1 + y2) / 2 + 30, height) ELSE y2 END, 1)] roi FROM a""",
    "court_pixels": f"WITH {_DET} SELECT stream_id, frame_index, det_idx, trunc(15 + cx / 100 * (190 / 20))::INT u, trunc(10 + cy / 30 * (420 / 44))::INT v FROM det",
    "court_coverage": "WITH s AS (SELECT stream_id, count(*) n FROM frames GROUP BY ALL), k AS (SELECT unnest([0, 3, 6, 9, 12]) kp), j AS (SELECT stream_id, kp FROM s, k WHERE n % 14 <> kp) SELECT stream_id, count(*) points, false left_right, bool_or(kp < 6) AND bool_or(kp > 7) near_far FROM j GROUP BY stream_id",
}
