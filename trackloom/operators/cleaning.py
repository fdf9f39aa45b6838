"""Dataset cleaning: label text, keys, two duplicate passes, negative cap, grouped split, manifest, audit."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "valid", "test")
RATIOS = (0.8, 0.1, 0.1)
# Name patterns of exported pictures and of the video family that two exports share.
EXPORT_HASH = r"\.rf\.[0-9a-fA-F]{16,}$"
SHARED_PREFIX = "^kevin_"
FAMILY_FRAME, FAMILY_CLIP = r"^pickleball\d+_mp4-", r"^pickleball\d+_mp4$"
FRAME_SUFFIXES = (r"-\d{4}-\d{2}-\d{2}t\d{6}-\d+_(?:jpg|jpeg|png)$", r"_\d{2}m\d{2}s_frame_\d+_(?:jpg|jpeg|png)$", r"[-_]\d+-?_(?:jpg|jpeg|png)$")


def stem(path: Column) -> Column:
    """File name without its last suffix and the export's hash."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), EXPORT_HASH, "")


def source_key(source: Column, path: Column) -> Column:
    name = F.lower(stem(path))
    bare = F.regexp_replace(name, SHARED_PREFIX, "")
    return F.when(bare.rlike(FAMILY_FRAME), F.concat(F.lit("moving_family:"), bare)).otherwise(F.concat_ws(":", source, name))


def clip_of(name: Column) -> Column:
    """The clip a picture's stem belongs to: the first frame suffix that fits is cut."""
    value = F.regexp_replace(F.regexp_replace(F.lower(name), EXPORT_HASH, ""), SHARED_PREFIX, "")
    out = F.when(value.rlike(FRAME_SUFFIXES[0]), F.regexp_replace(value, FRAME_SUFFIXES[0], ""))
    for pattern in FRAME_SUFFIXES[1:]:
        out = out.when(value.rlike(pattern), F.regexp_replace(value, pattern, ""))
    return out.otherwise(value)


def clip_key(source: Column, path: Column) -> Column:
    clip = clip_of(stem(path))
    return F.when(clip.rlike(FAMILY_CLIP), F.concat(F.lit("moving_family:"), clip)).otherwise(F.concat_ws(":", source, clip))


# Why a label line is refused, and how Python ends a line and writes a number.
REASONS = {"word": "non-numeric value", "infinite": "non-finite coordinate", "shape": "expected box or polygon values", "outside_outline": "polygon coordinate outside YOLO range", "outside_box": "coordinate outside YOLO range"}
LINE_END = r"\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
NUMBER = "[+-]?(?:(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"


def parse_labels(labels: DataFrame, text: str = "label_text", target: str = "ball_class") -> DataFrame:
    """Adds ``parsed``: boxes, ignored, converted, errors (their number), messages (``line N: reason``, in order). All on the JVM, by higher-order functions.

    A line is class, x, y, w, h, or class and an outline of three or more points in the unit square, which
    becomes its bounding box. A line that isn't all finite numbers, has another count, or whose box is out
    of range is an error (an infinite class too); other classes are ignored; blank lines skipped; a byte
    order mark is cut; equal boxes count once. Null text has no lines.
    """
    lines = f"split(regexp_replace(coalesce({text}, ''), '^\\uFEFF', ''), '{LINE_END}')"
    tokens = f"transform({lines}, (l, i) -> named_struct('n', i + 1, 'v', filter(split(trim(regexp_replace(l, '\\\\s+', ' ')), ' '), t -> t <> '')))"
    values = f"transform(filter({tokens}, l -> size(l.v) > 0), l -> named_struct('n', l.n, 'v', transform(l.v, t -> if(rlike(t, '^{NUMBER}$'), try_cast(t as double), null))))"
    finite = "not (isnan({0}) or abs({0}) = double('infinity'))"
    kinds = f"""transform({values}, l -> named_struct('n', l.n, 'v', l.v, 'kind', case
        when exists(l.v, t -> t is null) or not ({finite.format("l.v[0]")}) then 'word'
        when exists(l.v, t -> not ({finite.format("t")})) then 'infinite'
        when cast(l.v[0] as bigint) <> {target} then 'ignored'
        when size(l.v) = 5 then 'box'
        when size(l.v) >= 7 and size(l.v) % 2 = 1 then if(forall(slice(l.v, 2, size(l.v) - 1), t -> t between 0 and 1), 'outline', 'outside_outline')
        else 'shape' end))"""
    xs, ys = (f"filter(slice(l.v, 2, size(l.v) - 1), (t, i) -> i % 2 = {k})" for k in (0, 1))
    box = f"""case l.kind when 'box' then named_struct('x', l.v[1], 'y', l.v[2], 'w', l.v[3], 'h', l.v[4])
        when 'outline' then named_struct('x', (array_min({xs}) + array_max({xs})) / 2, 'y', (array_min({ys}) + array_max({ys})) / 2, 'w', array_max({xs}) - array_min({xs}), 'h', array_max({ys}) - array_min({ys})) end"""
    fits = "l.b.x between 0 and 1 and l.b.y between 0 and 1 and l.b.w > 0 and l.b.w <= 1 and l.b.h > 0 and l.b.h <= 1"
    staged = labels.withColumn("_l", F.expr(kinds)).withColumn("_l", F.expr(f"transform(_l, l -> named_struct('n', l.n, 'kind', l.kind, 'b', {box}))"))
    staged = staged.withColumn("_l", F.expr(f"transform(_l, l -> named_struct('n', l.n, 'kind', if(l.b is not null and not ({fits}), 'outside_box', l.kind), 'outline', l.kind = 'outline', 'b', l.b))"))
    reason = "case l.kind " + " ".join(f"when '{k}' then '{v}'" for k, v in REASONS.items()) + " end"
    wrong = "filter(_l, l -> l.kind not in ('box', 'outline', 'ignored'))"
    parsed = f"""named_struct('boxes', array_distinct(transform(filter(_l, l -> l.kind in ('box', 'outline')), l -> l.b)), 'ignored', size(filter(_l, l -> l.kind = 'ignored')),
        'converted', size(filter(_l, l -> l.outline)), 'errors', size({wrong}), 'messages', transform({wrong}, l -> concat('line ', l.n, ': ', {reason})))"""
    return staged.withColumn("parsed", F.expr(parsed)).drop("_l")


# Fixed value: values on a line of court points, class and box before three a point.
COURT_VALUES = 41


def parse_court_labels(labels: DataFrame, text: str = "label_text") -> DataFrame:
    """Adds ``court_error``: null where every line has 41 finite numbers of class 0, else the first bad line's ``line N: reason``. Blank lines count; null text has no lines."""
    lines = f"split(regexp_replace(regexp_replace(coalesce({text}, ''), '^\\uFEFF', ''), '({LINE_END})$', ''), '{LINE_END}')"
    tokens = f"transform({lines}, (l, i) -> named_struct('n', i + 1, 't', filter(split(trim(regexp_replace(l, '\\\\s+', ' ')), ' '), t -> t <> '')))"
    values = f"transform({tokens}, l -> named_struct('n', l.n, 'v', transform(l.t, t -> if(rlike(t, '^{NUMBER}$'), try_cast(t as double), null))))"
    found = f"""filter(transform({values}, l -> case when size(l.v) <> {COURT_VALUES} then concat('line ', l.n, ': expected {COURT_VALUES} values, got ', size(l.v)) when exists(l.v, t -> t is null) then concat('line ', l.n, ': non-numeric value')
        when cast(l.v[0] as bigint) <> 0 or exists(l.v, t -> isnan(t) or abs(t) = double('infinity')) then concat('line ', l.n, ': invalid class or coordinate') end), e -> e is not null)"""
    return labels.withColumn("court_error", F.expr(f"if(coalesce({text}, '') = '', null, get({found}, 0))"))


def _count(boxes: str = "boxes") -> Column:
    return F.coalesce(F.greatest(F.size(boxes), F.lit(0)), F.lit(0))


def best_variant(records: DataFrame) -> DataFrame:
    """One record per source_key: with boxes, more boxes, the larger file, then the path's hash. A null key is no group."""
    key = F.coalesce("source_key", F.col("record_id").cast("string"))
    n = _count()
    w = Window.partitionBy(key).orderBy(F.desc(n > 0), F.desc(n), F.desc(F.coalesce("file_size", F.lit(-1))), F.desc(F.sha1("image")), "record_id")
    return records.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_exact(records: DataFrame, sources: DataFrame) -> DataFrame:
    """One record per image_hash: with boxes, more boxes, the more trusted source, the larger file, then the least record_id (input order). A null hash is no group."""
    ranks = sources.groupBy(F.col("short_name").alias("source")).agg(F.min("priority").alias("_p"))
    key = F.coalesce("image_hash", F.col("record_id").cast("string"))
    n = _count()
    w = Window.partitionBy(key).orderBy(F.desc(n > 0), F.desc(n), F.asc_nulls_last("_p"), F.desc(F.coalesce("file_size", F.lit(-1))), "record_id")
    return records.join(ranks, "source", "left").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_p")


def variant_stats(records: DataFrame) -> DataFrame:
    per = records.filter("source_key IS NOT NULL").groupBy("source_key").agg(F.count("*").alias("n"), F.countDistinct("original_split").alias("s"), F.countDistinct(_count()).alias("b"))
    return per.agg(F.count("*").alias("frames"), F.sum(F.col("n") - 1).alias("variants_removed"), F.count_if(F.col("s") > 1).alias("leaking"), F.count_if(F.col("b") > 1).alias("disagreeing"))


def exact_stats(records: DataFrame) -> DataFrame:
    boxes = F.to_json(F.coalesce("boxes", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")))
    per = records.filter("image_hash IS NOT NULL").groupBy("image_hash").agg(F.count("*").alias("n"), F.countDistinct(boxes).alias("b"))
    return per.agg(F.count("*").alias("images"), F.sum(F.col("n") - 1).alias("duplicates_removed"), F.count_if(F.col("b") > 1).alias("disagreeing"))


def limit_negatives(records: DataFrame, ratio: float = 0.25) -> DataFrame:
    """All records with boxes and the first ``floor(positives * ratio)`` others in order of their key's hash.

    No global sort: a rank is the weight of the lower hash prefixes (4,096 of them, a small table) plus the
    place inside the prefix.
    """
    marked = records.withColumn("_pos", _count() > 0)
    positives, rest = marked.filter("_pos"), marked.filter("NOT _pos").withColumn("_h", F.sha1(F.coalesce("source_key", F.lit("")))).withColumn("_b", F.substring("_h", 1, 3))
    below = rest.groupBy("_b").agg(F.count("*").alias("n"))
    below = below.select("_b", F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    limit = positives.agg(F.floor(F.count("*") * ratio).alias("_limit"))
    ranked = rest.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", "record_id"))).join(F.broadcast(below), "_b").crossJoin(F.broadcast(limit))
    kept = ranked.filter("_n + _below <= _limit").select(*records.columns)
    return positives.select(*records.columns).unionByName(kept)


MAX_CLIPS = 2_000_000


def grouped_split(records: DataFrame, most: int = MAX_CLIPS) -> DataFrame:
    """``clip_key, clean_split`` of every clip: each source with three clips or more first gives one to test and one to valid (the nearest to its target, then by hash), the rest go by size to the split that leaves the least squared relative error overall and in its sources.

    The choice is sequential by definition: it runs in one task over the table of clips (a row per clip and
    source, never of records). More than ``most`` clips are refused, as one task holds them all;
    ``assign_splits`` of the training-data subpackage is the distributed operator. Null clips have no row.
    """
    clips = records.filter("clip_key IS NOT NULL").groupBy("clip_key", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    lists = clips.groupBy("clip_key").agg(F.collect_list("source").alias("sources"), F.collect_list("n").alias("counts"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{len(pdf)} clips, more than {most}: use a distributed split")
        sha = lambda t: hashlib.sha1(t.encode("utf-8", errors="replace")).hexdigest()
        names = pdf["clip_key"].tolist()
        sources = sorted({s for own in pdf["sources"] for s in own})
        at = {s: j for j, s in enumerate(sources)}
        own = [np.array([at[s] for s in x]) for x in pdf["sources"]]
        m = [np.asarray(x, float) for x in pdf["counts"]]
        size = np.array([x.sum() for x in m])
        holds: list[list[int]] = [[] for _ in sources]
        for i, js in enumerate(own):
            for j in js:
                holds[j].append(i)
        amount = lambda i, j: m[i][own[i] == j][0]
        ratio = np.array(RATIOS)
        goals = np.array([sum(amount(i, j) for i in holds[j]) for j in range(len(sources))])[:, None] * ratio
        goal = size.sum() * ratio
        have, haves, split = np.zeros(3), np.zeros((len(sources), 3)), np.full(len(names), -1)

        def put(i: int, k: int) -> None:
            split[i] = k
            have[k] += size[i]
            haves[own[i], k] += m[i]

        for j in sorted(range(len(sources)), key=lambda j: (len(holds[j]), sources[j])):
            if sum(split[i] < 0 for i in holds[j]) < 3:
                continue
            for k in (2, 1):
                free = [i for i in holds[j] if split[i] < 0]
                put(min(free, key=lambda i: (abs(amount(i, j) - goals[j, k]), sha(f"{sources[j]}:{SPLITS[k]}:{names[i]}"))), k)
        for i in sorted(np.flatnonzero(split < 0), key=lambda i: (-size[i], sha(names[i]))):
            whole = (have[None] + size[i] * np.eye(3) - goal) / np.maximum(goal, 1)
            parts = (haves[own[i]][:, None] + m[i][:, None, None] * np.eye(3) - goals[own[i]][:, None]) / np.maximum(goals[own[i]], 1)[:, None]
            put(i, int(((whole**2).sum(1) + (parts**2).sum((0, 2))).argmin()))
        return pd.DataFrame({"clip_key": names, "clean_split": [SPLITS[k] for k in split]})

    return lists.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(assign, "clip_key string, clean_split string")


def split_overlap(records: DataFrame, split: DataFrame) -> DataFrame:
    """``clips, frames``: clips, and source frames, whose records stand in two or more splits of ``split`` (clip_key, clean_split). Measured, not stated."""
    placed = records.join(split, "clip_key").select("clip_key", "source_key", "clean_split")
    torn = lambda key: placed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("clean_split").alias("n")).agg(F.count_if(F.col("n") > 1))
    return torn("clip_key").toDF("clips").crossJoin(torn("source_key").toDF("frames"))


# The columns of the manifest, in order.
MANIFEST = ("clean_split", "clean_image", "source_dataset", "source_split", "source_image", "source_frame_key", "clip_key", "ball_count", "ignored_non_ball_objects", "content_fingerprint")


def output_stem() -> Column:
    """File name of a cleaned picture: its source and a hash of what it is."""
    return F.concat(F.col("source"), F.lit("__"), F.substring(F.sha1(F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in ("source", "source_key", "image_hash")])), 1, 16))


def manifest(records: DataFrame, split: str = "assigned_split") -> DataFrame:
    """The ten columns of the manifest for each record; its sink sorts by split, then key. Null values stay null (empty in the file)."""
    suffix = F.lower(F.regexp_extract("image", r"[^/](\.[^./]*)$", 1))
    image = F.concat(F.col(split), F.lit("/images/"), output_stem(), suffix)
    values = (split, image, "source", "original_split", "image", "source_key", "clip_key", _count(), "ignored_objects", "image_hash")
    return records.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in zip(MANIFEST, values)])


def label_lines(records: DataFrame) -> DataFrame:
    """Label text per record: one ``0 x y w h`` line a box, eight places, each line ended; null boxes give null."""
    line = F.transform("boxes", lambda b: F.format_string("0 %.8f %.8f %.8f %.8f\n", b["x"], b["y"], b["w"], b["h"]))
    return records.select("record_id", F.array_join(line, "").alias("label_text"))


def audit(parsed: DataFrame) -> DataFrame:
    """Counters per source over scanned images (source, boxes, ignored, converted, errors), those refused later included.

    Sums are nought where there is nothing; a counter of images without a case is null, as an absent key.
    """
    n = _count()
    none = lambda c: F.nullif(c, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return parsed.groupBy("source").agg(
        F.count("*").alias("images"), total(n).alias("ball_boxes"), total("ignored").alias("ignored_objects"), total("converted").alias("converted_polygon_boxes"), none(F.count_if(n > 0)).alias("positive_images"),
        none(F.count_if(n > 1)).alias("multi_ball_images"), none(F.count_if(n == 0)).alias("negative_images"), none(F.count_if(F.col("errors") > 0)).alias("invalid_images"),
    )


def error_list(parsed: DataFrame, most: int = 100) -> DataFrame:
    """``image, error`` of the first ``most`` refused images in order of their place (``record_id``): a report, its length is the feature."""
    bad = parsed.filter("errors > 0").select("record_id", "image", F.concat(F.coalesce("image", F.lit("")), F.lit(": "), F.array_join("messages", "; ")).alias("error"))
    return bad.orderBy("record_id").limit(most)


def negative_stats(records: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Pictures with boxes, without, and of these how many stay."""
    counts = records.agg(F.count_if(_count() > 0).alias("positive_images"), F.count_if(_count() == 0).alias("available_negative_images"))
    return counts.withColumn("kept_negative_images", F.least(F.col("available_negative_images"), F.floor(F.col("positive_images") * ratio))).withColumn("max_negative_to_positive_ratio", F.lit(ratio))


def split_counts(records: DataFrame, split: str = "assigned_split") -> DataFrame:
    """Records per split and source, per split, and in all (level 0, 1, 3)."""
    return records.rollup(split, "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def method_counts(written: DataFrame) -> DataFrame:
    return written.groupBy("method").agg(F.count("*").alias("n"))


def clean(records: DataFrame, sources: DataFrame, ratio: float = 0.25) -> DataFrame:
    """The job over valid records: best variant, best exact copy, negatives capped, splits by clip. Adds ``clean_split``; a null clip_key has none."""
    kept = limit_negatives(best_exact(best_variant(records), sources), ratio)
    return kept.join(grouped_split(kept), "clip_key", "left")


def records_of(members: DataFrame, sources: DataFrame) -> DataFrame:
    """Scanned archive members with their labels parsed and keys made: ``record_id`` (place in order of archive and name), the fields of a record, ``ignored, converted, errors, messages``. Archives that no source names are left out."""
    named = members.withColumn("_file", F.regexp_replace("archive", "^.*/", "")).join(sources.select(F.col("archive").alias("_file"), F.col("short_name").alias("source"), "folder", "ball_class"), "_file")
    parsed = parse_labels(named)
    path = F.concat_ws("/", "folder", "split", F.lit("images"), "name")
    error = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.col("parsed.messages"))
    place = F.xxhash64("archive", "split", "name")
    return parsed.select(
        place.alias("record_id"), "source", F.col("split").alias("original_split"), path.alias("image"), source_key(F.col("source"), F.col("name")).alias("source_key"), clip_key(F.col("source"), F.col("name")).alias("clip_key"),
        F.col("parsed.boxes").alias("boxes"), F.col("parsed.ignored").alias("ignored_objects"), F.col("parsed.ignored").alias("ignored"), F.col("parsed.converted").alias("converted"), F.size(error).alias("errors"), error.alias("messages"), F.col("size").alias("file_size"),
        F.format_string("%08x:%d", "crc", "size").alias("image_hash"), "archive", F.concat_ws("/", "split", F.lit("images"), "name").alias("member"),
    )


def report_rows(parsed: DataFrame, sources: DataFrame, ratio: float = 0.25) -> DataFrame:
    """The cleaning report as rows ``section, source, name, value``: audit per source, both duplicate passes, negatives, splits, clips, overlap. Its size is bounded by sources and splits."""
    valid = parsed.filter("errors = 0")
    variants = best_variant(valid)
    exact = best_exact(variants, sources)
    kept = limit_negatives(exact, ratio)
    split = grouped_split(kept)
    done = kept.join(split, "clip_key", "left")
    n = _count()
    chosen = variants.agg(F.count("*").alias("unique_source_frames"), F.count_if(n > 0).alias("selected_positive_images"), F.count_if(n == 0).alias("selected_negative_images"), F.coalesce(F.sum(n), F.lit(0)).alias("selected_ball_boxes"))
    stats = variant_stats(valid).select("variants_removed", F.col("leaking").alias("source_frames_leaking_across_original_splits"), F.col("disagreeing").alias("variant_groups_with_ball_count_disagreement"))
    copies = exact_stats(variants).select(F.col("duplicates_removed").alias("exact_duplicates_removed"), F.col("disagreeing").alias("duplicate_groups_with_label_disagreement"))
    overlap = split_overlap(kept, split).select(F.col("clips").alias("clip_group_overlap_after_resplit"))

    def long(section: str, df: DataFrame, source: str | None = None) -> DataFrame:
        names = [c for c in df.columns if c != source]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names]))
        return df.select(F.lit(section).alias("section"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), pairs.alias("p")).select("section", "source", "p.name", "p.value").filter("value IS NOT NULL")

    per = split_counts(done.filter("clean_split IS NOT NULL"), "clean_split").filter("level < 3")
    splits = per.select(F.when(F.col("level") == 0, "cleaned_source_splits").otherwise("cleaned_splits").alias("section"), "source", F.col("clean_split").alias("name"), F.col("n").cast("double").alias("value"))
    parts = [
        long("sources", audit(parsed), "source"), long("raw", valid.agg(F.count("*").alias("raw_valid_records"))), long("source_deduplication", chosen), long("source_deduplication", stats), long("exact_deduplication", exact.agg(F.count("*").alias("unique_images"))),
        long("exact_deduplication", copies), long("negative_sampling", negative_stats(exact, ratio)), splits, long("clips", split.agg(F.count("*").alias("clip_groups"))), long("clips", overlap),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
