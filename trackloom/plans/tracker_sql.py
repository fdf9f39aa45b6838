"""SQL of the trackers: frame by frame recursion over a list of tracks per stream, with the shipped parameters."""

# The shipped configuration.
HIGH, LOW, SCALE_WIDTH = 0.25, 0.15, 1280


def _pass(tracks: str, dets: str, free: str) -> str:
    """Candidate pairs (t, d from 1) of tracks for which ``free`` holds with detections, by rising cost, and those that are too fast."""
    far = f"""flatten(list_transform({tracks}, lambda t, i: list_transform({dets}, lambda d, j: {{'t': i, 'd': j, 'far': sqrt(pow(d.cx - t.x, 2) + pow(d.cy - t.y, 2)), 'step': sqrt(pow(d.cx - t.lx, 2) + pow(d.cy - t.ly, 2)),
      'speed': sqrt(t.vx * t.vx + t.vy * t.vy), 'missing': t.missing, 'elapsed': greatest(1, t.missing + 1), 'moving': t.moving, 'hits': t.hits, 'conf': d.conf, 'free': {free},
      'size': abs(ln(greatest(d.w, 1) / greatest(t.w, 1))) + abs(ln(greatest(d.h, 1) / greatest(t.h, 1)))}})))"""
    gated = f"""list_transform(list_filter({far}, lambda p: p.free), lambda p: {{'p': p, 'gate': greatest(least(180 * s, 55 * s + p.speed * 0.8 + p.missing * 15 * s), CASE WHEN p.hits < 2 THEN 150 * s ELSE 0 END),
      'reach': least(390::DOUBLE, 260 + p.elapsed * 15) * s, 'fast': p.step > 120 * s * p.elapsed}})"""
    return f"""list_transform({gated}, lambda g: {{'g': g, 'impact': g.p.far > g.gate AND g.p.moving AND g.p.conf >= {HIGH} AND greatest(g.p.speed, g.p.step / g.p.elapsed) >= 15 * s AND g.p.step <= g.reach}})"""


def _greedy(pairs: str) -> str:
    """Matches {t, d, impact}: the cheapest pair first, each track and detection once."""
    cost = "CASE WHEN x.impact THEN 1 + x.g.p.step / greatest(x.g.reach, 1) ELSE x.g.p.far / greatest(x.g.gate, 1) END + 0.08 * x.g.p.size - 0.10 * x.g.p.conf"
    ranked = f"list_sort(list_transform(list_filter({pairs}, lambda x: (x.g.p.far <= x.g.gate OR x.impact) AND NOT x.g.fast), lambda x: {{'cost': {cost}, 't': x.g.p.t, 'd': x.g.p.d, 'impact': x.impact}}))"
    boxed = f"list_transform({ranked}, lambda x: {{'m': [x]}})"
    taken = f"list_reduce({boxed}, lambda a, b: CASE WHEN len(list_filter(a.m, lambda k: k.t = b.m[1].t OR k.d = b.m[1].d)) > 0 THEN a ELSE {{'m': list_concat(a.m, b.m)}} END)"
    return f"CASE WHEN len({ranked}) = 0 THEN [] ELSE ({taken}).m END"


def _absorbed(tracks: str, matches: str, dets: str) -> str:
    """Tracks with their matched detections taken in."""
    met = f"list_transform({tracks}, lambda t, i: {{'t': t, 'm': list_filter({matches}, lambda m: m.t = i)[1]}})"
    seen = f"""list_transform({met}, lambda x: {{'t': x.t, 'hit': x.m IS NOT NULL, 'impact': x.m.impact, 'd': {dets}[x.m.d], 'e': greatest(1, x.t.missing + 1), 'k': x.t.a + 16.0::DOUBLE}})"""
    gone = f"""list_transform({seen}, lambda x: {{'x': x, 'ga': sqrt(pow(x.d.cx - x.t.ax, 2) + pow(x.d.cy - x.t.ay, 2)), 'gr': sqrt(pow(x.d.cx - x.t.rx, 2) + pow(x.d.cy - x.t.ry, 2))}})"""
    moved = f"""list_transform({gone}, lambda g: {{'x': g.x, 'moved': g.ga > 12 * s AND g.ga / greatest(g.x.t.af + g.x.e, 1) >= 0.8 * s AND g.gr > 12 * s AND g.gr / greatest(g.x.t.rf + g.x.e, 1) >= 0.8 * s}})"""
    t, d, keep = "y.x.t", "y.x.d", lambda new, old: f"CASE WHEN y.moved THEN {new} ELSE {old} END"
    new = {
        "id": f"{t}.id", "x": f"{t}.x + {t}.a / y.x.k * ({d}.cx - {t}.x)", "y": f"{t}.y + {t}.a / y.x.k * ({d}.cy - {t}.y)",
        "vx": f"CASE WHEN y.x.impact THEN ({d}.cx - {t}.lx) / y.x.e ELSE {t}.vx + {t}.b / y.x.k * ({d}.cx - {t}.x) END", "vy": f"CASE WHEN y.x.impact THEN ({d}.cy - {t}.ly) / y.x.e ELSE {t}.vy + {t}.b / y.x.k * ({d}.cy - {t}.y) END",
        "a": f"{t}.a * (1 - {t}.a / y.x.k)", "b": f"{t}.b * (1 - {t}.a / y.x.k)", "c": f"{t}.c - {t}.b / y.x.k * {t}.b", "w": f"0.7 * greatest(1, {d}.w) + 0.3 * {t}.w", "h": f"0.7 * greatest(1, {d}.h) + 0.3 * {t}.h", "conf": f"{d}.conf",
        "age": f"{t}.age", "hits": f"{t}.hits + 1", "missing": "0", "seen": "true", "lx": f"{d}.cx", "ly": f"{d}.cy", "ax": keep(f"{d}.cx", f"{t}.ax"), "ay": keep(f"{d}.cy", f"{t}.ay"), "af": keep("0", f"{t}.af + y.x.e"),
        "rx": keep(f"{d}.cx", f"{t}.rx"), "ry": keep(f"{d}.cy", f"{t}.ry"), "rf": keep("0", f"{t}.rf + y.x.e"), "moving": f"{t}.moving OR y.moved", "still": keep("0", f"{t}.still + 1"),
    }
    return f"list_transform({moved}, lambda y: CASE WHEN y.x.hit THEN {_track(new)} ELSE y.x.t END)"


# The fields of a track's state and their types.
STATE = {
    "id": "BIGINT", **dict.fromkeys(("x", "y", "vx", "vy", "a", "b", "c", "w", "h", "conf"), "DOUBLE"), **dict.fromkeys(("age", "hits", "missing"), "BIGINT"), "seen": "BOOLEAN", **dict.fromkeys(("lx", "ly", "ax", "ay"), "DOUBLE"), "af": "BIGINT",
    "rx": "DOUBLE", "ry": "DOUBLE", "rf": "BIGINT", "moving": "BOOLEAN", "still": "BIGINT",
}
TYPE = "STRUCT(" + ", ".join(f'"{k}" {v}' for k, v in STATE.items()) + ")"


def _track(values: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': ({values[k]})::{v}" for k, v in STATE.items()) + "}::" + TYPE


def tracker(kept: str) -> str:
    """CTEs up to ``trk``: one row per frame of each stream with its tracks (``ts``) and counts. ``kept``: CTEs that end with ``final``, the det_idx after suppression."""
    same = {k: f"t.{k}" for k in STATE}
    moved = _track(same | {"x": "t.x + f.dx + t.vx", "y": "t.y + f.dy + t.vy", "a": "t.a + 2 * t.b + t.c + 36", "b": "t.b + t.c + 72", "c": "t.c + 144", "age": "t.age + 1", "seen": "false", "lx": "t.lx + f.dx", "ly": "t.ly + f.dy", "ax": "t.ax + f.dx", "ay": "t.ay + f.dy"})
    faded = _track(same | {"missing": "t.missing + 1", "conf": "t.conf * 0.82", "vx": "t.vx * 0.9", "vy": "t.vy * 0.9"})
    fresh = _track({k: "0" for k in STATE} | {"id": "next_id + i - 1", "x": "d.cx", "y": "d.cy", "lx": "d.cx", "ly": "d.cy", "ax": "d.cx", "ay": "d.cy", "rx": "d.cx", "ry": "d.cy", "a": "100", "c": "100", "w": "greatest(1, d.w)", "h": "greatest(1, d.h)", "conf": "d.conf", "age": "1", "hits": "1", "seen": "true", "moving": "false"})
    return f"""{kept},
boxed AS (SELECT stream_id, frame_index, list({{'cx': d.cx, 'cy': d.cy, 'w': d.x2 - d.x1, 'h': d.y2 - d.y1, 'conf': d.confidence}} ORDER BY d.confidence DESC, det_idx) dets FROM final JOIN det d USING (stream_id, frame_index, det_idx) GROUP BY ALL),
spine AS MATERIALIZED (SELECT f.stream_id, f.frame_index, f.width::DOUBLE width, f.height::DOUBLE height, coalesce(cam_dx, 0) dx, coalesce(cam_dy, 0) dy, coalesce(dets, []) dets, greatest(0.25, f.width / {SCALE_WIDTH}) s,
  row_number() OVER (PARTITION BY f.stream_id ORDER BY f.frame_index) n FROM frames f LEFT JOIN boxed USING (stream_id, frame_index)),
trk AS (
  SELECT stream_id, 0::BIGINT n, 0::BIGINT frame_index, 0::DOUBLE width, 0::DOUBLE height, 0::DOUBLE dx, 0::DOUBLE dy, 0::DOUBLE s, []::{TYPE}[] ts, 1::BIGINT next_id, 0::BIGINT dets, 0::BIGINT high, 0::BIGINT low, 0::BIGINT matched, 0::BIGINT recovered, 0::BIGINT created, 0::BIGINT removed,
    0::BIGINT rejected, 0::BIGINT impacts FROM spine WHERE n = 1
  UNION ALL
  SELECT stream_id, n, frame_index, width, height, dx, dy, s, list_concat(rest, news), next_id + len(news), len(dets), len(high), len(low), len(m1), len(m2), len(news), gone, fast1 + fast2, len(list_filter(m1, lambda m: m.impact)) + len(list_filter(m2, lambda m: m.impact)) FROM (
  SELECT *, list_transform(list_filter(high, lambda d, j: len(list_filter(m1, lambda m: m.d = j)) = 0)[1:greatest(0, 32 - len(rest))], lambda d, i: {fresh}) news FROM (
  SELECT *, list_filter(aged, lambda t: NOT (t.missing > 20 OR (NOT t.moving AND t.age > 30))) rest, len(list_filter(aged, lambda t: t.missing > 20 OR (NOT t.moving AND t.age > 30))) gone FROM (
  SELECT *, list_transform({_absorbed("u1", "m2", "low")}, lambda t: CASE WHEN t.seen THEN t ELSE {faded} END) aged FROM (
  SELECT *, {_greedy("p2")} m2, len(list_filter(p2, lambda x: x.g.fast)) fast2 FROM (
  SELECT *, {_pass("u1", "low", "NOT t.seen")} p2 FROM (
  SELECT *, {_absorbed("u0", "m1", "high")} u1 FROM (
  SELECT *, {_greedy("p1")} m1, len(list_filter(p1, lambda x: x.g.fast)) fast1 FROM (
  SELECT *, {_pass("u0", "high", "true")} p1 FROM (
  SELECT f.*, t.next_id, list_transform(t.ts, lambda t: {moved}) u0, list_filter(f.dets, lambda d: d.conf >= {HIGH}) high, list_filter(f.dets, lambda d: d.conf >= {LOW} AND d.conf < {HIGH}) low
  FROM trk t JOIN spine f ON t.stream_id = f.stream_id AND f.n = t.n + 1 WHERE true)))))))))),
shown AS (SELECT *, list_filter(ts, lambda t: t.missing <= 8 AND t.hits >= 2 AND t.moving AND t.still <= 30 AND (t.seen OR (t.conf >= 0.15 AND t.missing <= CASE WHEN sqrt(t.vx * t.vx + t.vy * t.vy) / s >= 40 THEN 3 ELSE 8 END AND t.x BETWEEN 0 AND width AND t.y BETWEEN 0 AND height))) out FROM trk WHERE n > 0)
"""


_CLIP = "least(greatest({0}, 0::DOUBLE), {1})"
TRACKS = f"""SELECT stream_id, frame_index, t.id track_id, CASE WHEN t.seen THEN 'observed' ELSE 'predicted' END status, round(t.x, 4) cx, round(t.y, 4) cy, round({_CLIP.format("t.x - t.w / 2", "width")}, 4) x1, round({_CLIP.format("t.y - t.h / 2", "height")}, 4) y1,
  round({_CLIP.format("t.x + t.w / 2", "width")}, 4) x2, round({_CLIP.format("t.y + t.h / 2", "height")}, 4) y2, round(t.conf, 6) confidence, round(t.vx, 4) vx, round(t.vy, 4) vy, t.missing::INTEGER missing_frames, CASE WHEN t.seen THEN 'detector' ELSE 'prediction' END source,
  t.age::INTEGER age, t.hits::INTEGER hits, t.hits >= 2 confirmed, t.moving motion_confirmed, t.still::INTEGER stationary_frames FROM (SELECT stream_id, frame_index, width, height, unnest(out) t FROM shown)"""
_STATES = "list_transform(ts, lambda t: concat_ws(' ', t.id, replace(printf('%.3f', t.x), '-0.000', '0.000'), replace(printf('%.3f', t.y), '-0.000', '0.000'), replace(printf('%.3f', t.vx), '-0.000', '0.000'), replace(printf('%.3f', t.vy), '-0.000', '0.000'), t.missing, t.moving, t.seen))"
DIAGNOSTICS = f"""SELECT stream_id, frame_index, dets::INTEGER input_detections, high::INTEGER high_conf_detections, low::INTEGER low_conf_detections, matched::INTEGER high_conf_matches, recovered::INTEGER low_conf_recoveries, created::INTEGER created_tracks, removed::INTEGER removed_tracks,
  len(ts)::INTEGER retained_tracks, len(out)::INTEGER emitted_tracks, len(out)::INTEGER eligible_tracks, 0 output_limited_tracks, rejected::INTEGER physical_gate_rejections, impacts::INTEGER impact_recoveries, len(list_filter(ts, lambda t: NOT t.moving))::INTEGER motion_unconfirmed_tracks,
  len(list_filter(ts, lambda t: t.still > 30))::INTEGER stationary_suppressed_tracks, dx camera_motion_dx, dy camera_motion_dy, array_to_string({_STATES}, '; ') track_states FROM shown"""


def single(kept: str) -> str:
    """The single-object tracker, frame by frame: filter state, the last three positions, the missing count."""
    far = "list_sort(list_transform(good, lambda d, i: {'f': sqrt(pow(d.cx - x, 2) + pow(d.cy - y, 2)), 'i': i}))[1]"
    return f"""{kept},
boxed AS (SELECT stream_id, frame_index, list({{'cx': d.cx, 'cy': d.cy, 'conf': d.confidence}} ORDER BY d.confidence DESC, det_idx) dets FROM final JOIN det d USING (stream_id, frame_index, det_idx) GROUP BY ALL),
spine AS MATERIALIZED (SELECT f.stream_id, f.frame_index, coalesce(dets, []) dets, row_number() OVER (PARTITION BY f.stream_id ORDER BY f.frame_index) n FROM frames f LEFT JOIN boxed USING (stream_id, frame_index)),
ball AS (
  SELECT stream_id, 0::BIGINT n, 0::BIGINT frame_index, NULL::VARCHAR status, NULL::VARCHAR reason, false begun, 0::DOUBLE x, 0::DOUBLE y, 0::DOUBLE vx, 0::DOUBLE vy, 0::DOUBLE a, 0::DOUBLE b, 0::DOUBLE c, []::STRUCT(x DOUBLE, y DOUBLE)[] past, 0::BIGINT missing, 0::DOUBLE conf FROM spine WHERE n = 1
  UNION ALL
  SELECT stream_id, n, frame_index, CASE WHEN hit THEN 'observed' WHEN moved THEN 'predicted' ELSE 'absent' END, CASE WHEN NOT hit THEN reason END, begun OR hit, x2, y2, vx2, vy2, a2, b2, c2, CASE WHEN hit OR moved THEN list_concat(past, [{{'x': x2, 'y': y2}}])[-3:] ELSE [] END,
    CASE WHEN hit OR len(past) = 0 THEN 0 ELSE missing + 1 END, CASE WHEN hit THEN pick.conf ELSE conf END FROM (
  SELECT *, CASE WHEN NOT hit THEN px WHEN begun THEN px + pa / (pa + 4) * (pick.cx - px) ELSE pick.cx END x2, CASE WHEN NOT hit THEN py WHEN begun THEN py + pa / (pa + 4) * (pick.cy - py) ELSE pick.cy END y2,
    CASE WHEN hit AND begun THEN vx + pb / (pa + 4) * (pick.cx - px) ELSE vx END vx2, CASE WHEN hit AND begun THEN vy + pb / (pa + 4) * (pick.cy - py) ELSE vy END vy2,
    CASE WHEN NOT hit THEN pa WHEN begun THEN (1 - pa / (pa + 4)) * pa ELSE 100 END a2, CASE WHEN NOT hit THEN pb WHEN begun THEN (1 - pa / (pa + 4)) * pb ELSE 0 END b2, CASE WHEN NOT hit THEN pc WHEN begun THEN pc - pb / (pa + 4) * pb ELSE 100 END c2 FROM (
  SELECT *, CASE WHEN moves THEN x + vx ELSE x END px, CASE WHEN moves THEN y + vy ELSE y END py, CASE WHEN moves THEN a + 2 * b + c + 56.25::DOUBLE ELSE a END pa, CASE WHEN moves THEN b + c + 112.5::DOUBLE ELSE b END pb, CASE WHEN moves THEN c + 225::DOUBLE ELSE c END pc FROM (
  SELECT *, pick IS NOT NULL hit, pick IS NULL AND len(past) > 0 AND missing + 1 <= 3 moved, len(past) > 0 AND (pick IS NOT NULL OR missing + 1 <= 3) moves, CASE WHEN len(dets) = 0 THEN 'no_detection' WHEN len(good) = 0 THEN 'low_conf' ELSE 'large_jump' END reason FROM (
  SELECT *, CASE WHEN len(good) = 0 THEN NULL WHEN len(past) = 0 THEN good[1] WHEN near.f <= 180 THEN good[near.i] END pick FROM (
  SELECT *, {far} near FROM (
  SELECT b.* EXCLUDE (n, frame_index, status, reason), f.n, f.frame_index, f.dets, list_filter(f.dets, lambda d: d.conf >= {HIGH}) good FROM ball b JOIN spine f ON b.stream_id = f.stream_id AND f.n = b.n + 1)))))))
SELECT stream_id, frame_index, status, round(CASE WHEN status <> 'absent' THEN list_avg(list_transform(past, lambda p: p.x)) END, 4) cx, round(CASE WHEN status <> 'absent' THEN list_avg(list_transform(past, lambda p: p.y)) END, 4) cy,
  round(CASE status WHEN 'observed' THEN conf WHEN 'predicted' THEN conf * greatest(0, 1 - missing / 4) ELSE 0 END, 6) confidence, round(CASE WHEN status <> 'absent' THEN vx END, 4) vx, round(CASE WHEN status <> 'absent' THEN vy END, 4) vy,
  missing::INTEGER missing_frames, reason drop_reason FROM ball WHERE n > 0"""


# Ratios of train, valid and test.
RATIOS = "[0.8::DOUBLE, 0.1::DOUBLE, 0.1::DOUBLE]"


def grouped_split(records: str = "records") -> str:
    """CTEs up to ``placed`` (clip_key, k: 1 train, 2 valid, 3 test): clips reserved source by source, then the rest by falling size, each to the split with the least squared relative error."""
    error = "pow((have[q] + CASE WHEN q = k THEN size ELSE 0 END - goal[q]) / greatest(goal[q], 1), 2)"
    own = "pow((haves[j][q] + CASE WHEN q = k THEN m[j] ELSE 0 END - goals[j][q]) / greatest(goals[j][q], 1), 2)"
    score = f"list_transform([1, 2, 3], lambda k: list_sum(list_transform([1, 2, 3], lambda q: {error})) + list_sum(list_transform(m, lambda v, j: CASE WHEN v = 0 THEN 0 ELSE list_sum(list_transform([1, 2, 3], lambda q: {own})) END)))"
    return f"""
per AS MATERIALIZED (SELECT clip_key, coalesce(source, '') source, count(*) n FROM {records} WHERE clip_key IS NOT NULL GROUP BY ALL),
src AS MATERIALIZED (SELECT source, sum(n) total, count(*) clips, row_number() OVER (ORDER BY source) j FROM per GROUP BY source),
slot AS (SELECT source, total, k, row_number() OVER (ORDER BY clips, source, k DESC) i FROM src, (VALUES (2), (3)) v(k)),
res AS (
  SELECT 0::BIGINT i, []::VARCHAR[] clips, []::INTEGER[] ks, false room
  UNION ALL
  SELECT i, CASE WHEN takes THEN list_append(clips, clip) ELSE clips END, CASE WHEN takes THEN list_append(ks, k) ELSE ks END, room FROM (
    SELECT *, room AND clip IS NOT NULL takes FROM (
    SELECT s.i, r.clips, r.ks, s.k, CASE WHEN s.k = 3 THEN count(p.clip_key) >= 3 ELSE r.room END room, arg_min(p.clip_key, (abs(p.n - s.total * 0.1::DOUBLE), sha1(s.source || ':' || CASE s.k WHEN 3 THEN 'test' ELSE 'valid' END || ':' || p.clip_key))) clip
    FROM res r JOIN slot s ON s.i = r.i + 1 LEFT JOIN per p ON p.source = s.source AND NOT list_contains(r.clips, p.clip_key) GROUP BY s.i, r.clips, r.ks, s.k, r.room))),
kept AS (SELECT unnest(clips) clip_key, unnest(ks) k FROM (SELECT * FROM res ORDER BY i DESC LIMIT 1)),
wide AS MATERIALIZED (SELECT c.clip_key, list(coalesce(n, 0)::DOUBLE ORDER BY j) m, sum(coalesce(n, 0))::DOUBLE size FROM (SELECT DISTINCT clip_key FROM per) c CROSS JOIN src LEFT JOIN per p ON p.clip_key = c.clip_key AND p.source = src.source GROUP BY c.clip_key),
goals AS (SELECT list_transform({RATIOS}, lambda r: r * sum(total)) goal, list(list_transform({RATIOS}, lambda r: r * total) ORDER BY j) goals FROM src),
rest AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, sha1(clip_key)) i FROM wide ANTI JOIN kept USING (clip_key)),
first AS (SELECT list_transform([1, 2, 3], lambda q: coalesce(list_sum(list_transform(list_filter(taken, lambda t: t.k = q), lambda t: t.size)), 0)) have,
  list_transform(range(1, c + 1), lambda j: list_transform([1, 2, 3], lambda q: coalesce(list_sum(list_transform(list_filter(taken, lambda t: t.k = q), lambda t: t.m[j])), 0))) haves
  FROM (SELECT coalesce(list({{'k': k, 'm': m, 'size': size}}), []) taken, (SELECT count(*) FROM src) c FROM kept JOIN wide USING (clip_key))),
fold AS (
  SELECT 0::BIGINT i, NULL::VARCHAR clip_key, 0::BIGINT k, have::DOUBLE[] have, haves::DOUBLE[][] haves FROM first
  UNION ALL
  SELECT i, clip_key, best, list_transform(have, lambda v, q: CASE WHEN q = best THEN v + size ELSE v END), list_transform(haves, lambda h, j: list_transform(h, lambda v, q: CASE WHEN q = best THEN v + m[j] ELSE v END)) FROM (
    SELECT i, clip_key, have, haves, m, size, list_position(scores, list_min(scores))::BIGINT best FROM (
    SELECT r.i, r.clip_key, f.have, f.haves, r.m, r.size, {score} scores FROM fold f JOIN rest r ON r.i = f.i + 1 CROSS JOIN goals))),
placed AS (SELECT clip_key, k::BIGINT k FROM kept UNION ALL SELECT clip_key, k FROM fold WHERE i > 0)
"""


SPLIT_NAME = "CASE k WHEN 1 THEN 'train' WHEN 2 THEN 'valid' ELSE 'test' END"
