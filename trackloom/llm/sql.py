"""SQL for the queries that SQL can express; it follows the stated definition, not the operator's steps."""

_NAME = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url_decode(regexp_replace({0}, '^[^:]*:', '')))), '\.rf\.[0-9a-f]{{16,}}', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^((batch2|reexp|relabel)_)+', '')"
CLIP = _NAME.format("clip_key")
FRAME = "regexp_replace(" + _NAME.format("source_key") + ", '(_(jpg|jpeg|png|bmp|webp))+$', '')"
_FLAT = r"regexp_replace(lower(image_hash), '\s', '', 'g')"
HASH = rf"""CASE WHEN regexp_matches({_FLAT}, '^(0x)?[0-9a-f]{{1,8}}:[1-9][0-9]*$') AND NOT regexp_matches({_FLAT}, '^(0x)?(0+|f{{8}}):')
  THEN lpad(regexp_extract({_FLAT}, '^(?:0x)?([0-9a-f]+):', 1), 8, '0') || ':' || regexp_extract({_FLAT}, ':([0-9]+)$', 1) END"""
SPLIT = "CASE WHEN lower(trim(assigned_split)) IN ('train') THEN 'train' WHEN lower(trim(assigned_split)) IN ('valid', 'validation', 'val') THEN 'valid' WHEN lower(trim(assigned_split)) = 'test' THEN 'test' END"

_STATUS = r"regexp_replace(lower(regexp_replace(status, '\s', '', 'g')), '^.*\.', '')"

_RUNS = rf"""
WITH once AS (
  SELECT stream_id, track_id, frame_index f, {_STATUS} s, CASE WHEN {_STATUS} <> 'observed' THEN frame_index - missing_frames END b
  FROM ball_tracks WHERE track_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY stream_id, track_id, frame_index ORDER BY missing_frames NULLS LAST, row_id) = 1),
a AS (SELECT *, CASE WHEN f - lag(f) OVER w <= 5 AND s = lag(s) OVER w THEN 0 ELSE 1 END new FROM once WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY f)),
g AS (SELECT *, sum(new) OVER (PARTITION BY stream_id, track_id ORDER BY f) island FROM a),
h AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(b IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) base
  FROM g WINDOW w AS (PARTITION BY stream_id, track_id, island ORDER BY f)),
i AS (SELECT *, CASE WHEN base IS DISTINCT FROM lag(base) OVER w THEN 1 ELSE 0 END turn FROM h WINDOW w AS (PARTITION BY stream_id, track_id, island ORDER BY f)),
j AS (SELECT *, sum(turn) OVER (PARTITION BY stream_id, track_id, island ORDER BY f) part FROM i),
runs AS (SELECT stream_id, track_id, any_value(s) status, min(f) first_frame, max(f) last_frame, count(*) frames FROM j GROUP BY stream_id, track_id, island, part)
"""

_IMAGES = f"""
WITH RECURSIVE keyed AS (SELECT record_id, {FRAME} fr, {HASH} h, {SPLIT} s FROM records),
link AS (
  SELECT DISTINCT a.record_id x, b.record_id y FROM keyed a JOIN keyed b ON a.fr = b.fr AND a.record_id <> b.record_id
  UNION SELECT DISTINCT a.record_id, b.record_id FROM keyed a JOIN keyed b ON a.h = b.h AND a.record_id <> b.record_id),
reach AS (SELECT record_id x, record_id y FROM keyed UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
"""

# Groups of the split: clips (of the frame's name where clip_key names none) and source frames, closed by keyed recursion; then the line of each source.
_SPLIT = f"""
WITH RECURSIVE keyed AS MATERIALIZED (SELECT record_id, coalesce(source, '') source, {FRAME} fr, coalesce(nullif({CLIP}, ''), regexp_extract({FRAME}, '^(.+)_[0-9]+$', 1)) cl FROM records),
link(id, v) AS MATERIALIZED (SELECT record_id, 'f' || fr FROM keyed WHERE fr <> '' UNION ALL SELECT record_id, 'c' || cl FROM keyed WHERE cl <> ''),
grp(id, g) USING KEY (id) AS (
  SELECT record_id, record_id FROM keyed
  UNION SELECT l.id, min(m.g) FROM link l JOIN (SELECT v, min(r.g) g FROM link JOIN recurring.grp r ON link.id = r.id GROUP BY v) m ON l.v = m.v JOIN recurring.grp o ON o.id = l.id GROUP BY l.id, o.g HAVING min(m.g) < o.g),
member AS MATERIALIZED (SELECT record_id, source, g group_id FROM keyed JOIN grp ON record_id = id),
weight AS (SELECT group_id, source, count(*) n FROM member GROUP BY ALL),
home AS (SELECT group_id, arg_max(source, (n, source)) home, sum(n) n FROM weight GROUP BY group_id),
total AS (SELECT *, sum(n) OVER (PARTITION BY home) total, (SELECT min(ratio) / sum(ratio) FROM split_targets) least FROM home),
placed AS (SELECT *, n > total * least / 2 AS big, ('0x' || md5(group_id::VARCHAR)[1:8])::BIGINT hash FROM total),
laid AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY home ORDER BY big DESC, CASE WHEN big THEN -n ELSE hash END, group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) / total "at" FROM placed),
cut AS (SELECT split_name, sum(ratio) OVER (ORDER BY ratio DESC, split_name) / sum(ratio) OVER () upto, row_number() OVER (ORDER BY ratio DESC, split_name) k FROM split_targets),
chosen AS (SELECT group_id, coalesce((SELECT arg_min(split_name, k) FROM cut WHERE "at" < upto), (SELECT arg_max(split_name, k) FROM cut)) new_split FROM laid),
assigned AS (SELECT record_id, source, group_id, new_split FROM member JOIN chosen USING (group_id))
"""

_GOOD = """list_sort(list_distinct(list_transform(list_filter(boxes, lambda b: coalesce(b.w > 0 AND b.h > 0 AND b.x - b.w / 2 >= -0.001 AND b.x + b.w / 2 <= 1.001 AND b.y - b.h / 2 >= -0.001 AND b.y + b.h / 2 <= 1.001, false)),
  lambda b: {'x': round(b.x::DECIMAL(18, 10), 4)::DOUBLE, 'y': round(b.y::DECIMAL(18, 10), 4)::DOUBLE, 'w': round(b.w::DECIMAL(18, 10), 4)::DOUBLE, 'h': round(b.h::DECIMAL(18, 10), 4)::DOUBLE})))"""
_BOXES = f"CASE WHEN len({_GOOD}) = 0 THEN '[]' WHEN boxes IS NOT NULL THEN array_to_string(list_transform({_GOOD}, lambda b: printf('%.4f %.4f %.4f %.4f', b.x, b.y, b.w, b.h)), '; ') END"
_BEST = "boxed DESC, round(score, 9) DESC, trust DESC, latest DESC NULLS LAST, value DESC"
TURNS = 30  # rounds spelled out; once the weights settle, the later ones keep them


def _turn(k: int) -> str:
    """Weights after one more round of truth discovery, from those of round k."""
    damped = "raw / max(raw) OVER (PARTITION BY field)" if k < 20 else "(raw / max(raw) OVER (PARTITION BY field) + weight) / 2"
    return f"""
won{k} AS MATERIALIZED (SELECT group_id, field, value FROM (SELECT group_id, field, value, boxed, trust, latest, sum(n * weight) score FROM torn JOIN w{k} USING (field, source) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY {_BEST}) = 1),
new{k} AS (SELECT field, source, -ln((coalesce(wrong, 0) + 1) / (n + 2)) raw FROM held LEFT JOIN
  (SELECT t.field, source, sum(n) wrong FROM torn t JOIN won{k} w ON t.group_id = w.group_id AND t.field = w.field AND t.value <> w.value GROUP BY ALL) USING (field, source)),
next{k} AS (SELECT field, source, weight, done, {damped} fresh FROM new{k} JOIN w{k} USING (field, source)),
w{k + 1} AS MATERIALIZED (SELECT field, source, CASE WHEN done THEN weight ELSE fresh END weight, done OR max(abs(fresh - weight)) OVER () <= 0.001 done FROM next{k})"""


_SURVIVORS = _IMAGES + f""",
member AS MATERIALIZED (SELECT x record_id, min(y) group_id, count(*) copies FROM reach GROUP BY x),
read AS MATERIALIZED (SELECT record_id, group_id, copies, coalesce(source, '') source, image, scanned_at, [{{'field': 'boxes', 'value': {_BOXES}}}, {{'field': 'ignored_objects', 'value': CASE WHEN ignored_objects >= 0 THEN ignored_objects::VARCHAR END}},
    {{'field': 'file_size', 'value': CASE WHEN file_size > 0 THEN file_size::VARCHAR END}}, {{'field': 'frame', 'value': fr}}, {{'field': 'checksum', 'value': regexp_replace(h, '^0+', '')}}, {{'field': 'clip', 'value': {CLIP}}},
    {{'field': 'original_split', 'value': {SPLIT.replace('assigned_split', 'original_split')}}}, {{'field': 'assigned_split', 'value': {SPLIT}}}] c FROM records JOIN keyed USING (record_id) JOIN member USING (record_id)),
said AS (SELECT record_id, group_id, copies, source, scanned_at, unnest(c, recursive := true) FROM read),
claim AS MATERIALIZED (SELECT group_id, field, value, source, count(*) n, max(scanned_at) latest FROM said WHERE copies > 1 AND value <> '' GROUP BY ALL),
valued AS MATERIALIZED (SELECT group_id, field, value, NOT (field = 'boxes' AND value = '[]') boxed, max(-coalesce(priority, 1 << 30)) trust, max(latest) latest FROM claim LEFT JOIN sources ON source = short_name GROUP BY ALL),
torn AS MATERIALIZED (SELECT c.group_id, c.field, c.value, source, n, boxed, trust, v.latest FROM claim c JOIN valued v USING (group_id, field, value) WHERE (c.group_id, c.field) IN (SELECT (group_id, field) FROM valued GROUP BY group_id, field HAVING count(*) > 1)),
held AS MATERIALIZED (SELECT field, source, sum(n) n FROM claim WHERE (field, source) IN (SELECT (field, source) FROM torn) GROUP BY ALL),
w0 AS MATERIALIZED (SELECT field, source, 1.0::DOUBLE weight, false done FROM held),
""" + ",".join(_turn(k) for k in range(TURNS)) + f""",
scored AS (SELECT group_id, c.field, c.value, sum(n * coalesce(weight, 1)) score, sum(n) votes FROM claim c LEFT JOIN w{TURNS} USING (field, source) GROUP BY ALL),
chosen AS (SELECT group_id, field, value, votes / sum(votes) OVER (PARTITION BY group_id, field) support, max(latest) OVER (PARTITION BY group_id, field) latest FROM scored JOIN valued USING (group_id, field, value)
  QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY {_BEST}) = 1),
wide AS (SELECT group_id, map(list(field), list(value)) m, round(min(support), 4) support, max(latest) latest FROM chosen GROUP BY group_id),
path AS (SELECT group_id, image FROM read LEFT JOIN sources ON source = short_name WHERE image IS NOT NULL AND copies > 1 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY -coalesce(priority, 1 << 30) DESC, scanned_at DESC NULLS LAST, image DESC) = 1),
best AS (SELECT g.group_id, copies, m, image, support, latest FROM (SELECT DISTINCT group_id, copies FROM member WHERE copies > 1) g LEFT JOIN wide USING (group_id) LEFT JOIN path USING (group_id)
  UNION ALL SELECT group_id, 1, map(list_transform(c, lambda v: v.field), list_transform(c, lambda v: nullif(v.value, ''))), image, 1.0, scanned_at FROM read WHERE copies = 1)
SELECT group_id, copies, m['boxes'] boxes, m['ignored_objects']::INTEGER ignored_objects, m['file_size']::BIGINT file_size, m['frame'] frame, m['checksum'] checksum, m['clip'] clip, m['original_split'] original_split, m['assigned_split'] assigned_split,
  image, support, latest FROM best
"""

ORACLE = {
    "p4_survivors": _SURVIVORS,
    "p2_split": _SPLIT + "SELECT record_id, source, group_id, new_split FROM assigned",
    "p2_report": _SPLIT + """, n AS (SELECT source, new_split, count(*) records FROM assigned GROUP BY ALL UNION ALL SELECT '*', new_split, count(*) FROM assigned GROUP BY new_split)
SELECT source, new_split, records, round(records / sum(records) OVER (PARTITION BY source), 4) share FROM n""",
    "p1_found": _RUNS + "SELECT stream_id, track_id, first_frame, last_frame FROM runs WHERE last_frame > first_frame",
    "p1_runs": _RUNS + """SELECT stream_id, track_id, status, first_frame, last_frame, frames, round((last_frame - first_frame) * s_per_frame, 4) duration_s
FROM runs LEFT JOIN (SELECT stream_id, regr_slope(ts_s, frame_index::DOUBLE) s_per_frame FROM frames GROUP BY stream_id) USING (stream_id)""",
    "p2_found": f"""
WITH named AS (SELECT record_id, {CLIP} clip, {SPLIT} s FROM records WHERE clip_key IS NOT NULL AND assigned_split IS NOT NULL)
SELECT record_id FROM named WHERE clip IN (SELECT clip FROM named GROUP BY clip HAVING count(DISTINCT s) > 1)""",
    "p3_found": _IMAGES + """
SELECT DISTINCT least(a.record_id, b.record_id) record_id_a, greatest(a.record_id, b.record_id) record_id_b
FROM reach JOIN keyed a ON reach.x = a.record_id JOIN keyed b ON reach.y = b.record_id WHERE a.s = 'train' AND b.s IN ('valid', 'test')""",
    "p3_report": _IMAGES + """,
pair AS (SELECT DISTINCT a.record_id t, b.record_id e FROM reach JOIN keyed a ON reach.x = a.record_id JOIN keyed b ON reach.y = b.record_id WHERE a.s = 'train' AND b.s IN ('valid', 'test')),
stands AS (SELECT record_id, count(*) links FROM (SELECT t record_id FROM pair UNION ALL SELECT e FROM pair) GROUP BY record_id)
SELECT coalesce(s, 'none') split, coalesce(source, 'none') source, count(*) records, count(links) overlapping, coalesce(sum(links), 0)::BIGINT pairs
FROM records JOIN keyed USING (record_id) LEFT JOIN stands USING (record_id) GROUP BY ALL""",
    "p4_found": _IMAGES + """
SELECT min(y) group_id, x record_id FROM reach GROUP BY x HAVING count(*) > 1""",
}
