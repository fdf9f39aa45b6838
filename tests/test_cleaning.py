import pytest
from trackloom.operators import cleaning as C
from trackloom.functions import keys as K
from pyspark.sql import functions as F

RECORDS = "record_id long, source string, original_split string, image string, source_key string, clip_key string, boxes array<struct<x:double,y:double,w:double,h:double>>, ignored_objects int, file_size long, image_hash string, assigned_split string"


def parsed(spark, text, cls=0):
    p = C.parse_labels(spark.createDataFrame([(text, cls, 1)], "label_text string, ball_class int, _x int")).first().parsed
    return [tuple(b) for b in p.boxes], p.ignored, p.converted, p.errors


def test_label_lines(spark):
    assert parsed(spark, "﻿0 0.5 0.5 0.1 0.2\n\n0 0.5 0.5 0.1 0.2\r\n1 0.1 0.1 0.1 0.1\n") == ([(0.5, 0.5, 0.1, 0.2)], 1, 0, 0)
    boxes, ignored, converted, errors = parsed(spark, "0 0.1 0.1 0.3 0.1 0.3 0.5")
    assert [tuple(round(v, 9) for v in boxes[0]), ignored, converted, errors] == [(0.2, 0.3, 0.2, 0.4), 0, 1, 0]
    assert parsed(spark, "0 0.5 0.5 0 0.1\n0 0.5 x 0.1 0.1\ninf 0.5 0.5 0.1 0.1\n0 nan 0.5 0.1 0.1\n0 1 2 3\n0 1.5 0.5 0.1 0.1")[3] == 6
    assert parsed(spark, None) == parsed(spark, "") == ([], 0, 0, 0)
    text = "0 0.5 0.5 0.1 0.1\r\n\n0 1d 0.5 0.1 0.1\x0b0 nan 0.5 0.1 0.1\u20280 1 2 3\n0 0.5 0.5 0.1 1.5\r0 0.1 0.1 1.3 0.1 0.3 0.5\n7 1 1 1 1"
    p = C.parse_labels(spark.createDataFrame([(text, 0)], "label_text string, ball_class int")).first().parsed
    assert p.messages == ["line 3: non-numeric value", "line 4: non-finite coordinate", "line 5: expected box or polygon values", "line 6: coordinate outside YOLO range", "line 7: polygon coordinate outside YOLO range"]
    assert len(p.boxes) == 1 and (p.ignored, p.converted, p.errors) == (1, 0, 5)


def test_court_labels(spark):
    good = "0 " + " ".join(["0.5"] * 40)
    rows = [(1, good), (2, good + "\n" + good + "\n"), (3, good + " 1"), (4, good + "\n1" + good[1:]), (5, good.replace("0.5", "x", 1)), (6, good + "\n\n" + good), (7, ""), (8, None), (9, good.replace("0.5", "nan", 1))]
    got = {r.i: r.court_error for r in C.parse_court_labels(spark.createDataFrame(rows, "i int, label_text string")).collect()}
    assert got == {1: None, 2: None, 3: "line 1: expected 41 values, got 42", 4: "line 2: invalid class or coordinate", 5: "line 1: non-numeric value", 6: "line 2: expected 41 values, got 0", 7: None, 8: None, 9: "line 1: invalid class or coordinate"}


def test_names(spark):
    names = [
        ("lobcam", "a/Kevin_Pickleball12_mp4-0034_jpg.rf.0123456789abcdef0.jpg", "moving_family:pickleball12_mp4-0034_jpg", "moving_family:pickleball12_mp4"),
        ("cam", "x/Match-2024-01-02t030405-77_jpg.jpg", "cam:match-2024-01-02t030405-77_jpg", "cam:match"), ("cam", "x/y_03m04s_frame_9_png.png", "cam:y_03m04s_frame_9_png", "cam:y"), ("cam", "plain.jpg", "cam:plain", "cam:plain"),
    ]
    df = spark.createDataFrame(names, "s string, p string, k string, c string")
    for r in df.select("k", "c", C.source_key(F.col("s"), F.col("p")).alias("k2"), C.clip_key(F.col("s"), F.col("p")).alias("c2")).collect():
        assert (r.k, r.c) == (r.k2, r.c2)


def test_spellings(spark):
    rows = [("a:X%20y-1_JPG", "0xABC:12", "Validation "), ("b:batch2_x_y_00001.png", "00000000:0", "val"), (None, None, None), ("a:100%_x", "ffffffff:-1", "other"), ("", "n/a", "")]
    got = spark.createDataFrame(rows, "k string, h string, s string").select(K.frame_name(F.col("k")), K.checksum(F.col("h")), K.split_name(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("x_y_1", "abc:12", "valid"), ("x_y_00001", "", "valid"), (None, None, None), ("100_x", "", ""), ("", "", "")]


def record(i, key, size, boxes=1, clip="c", source="s", h=None):
    return (i, source, "train", f"img{i}.jpg", key, clip, [(0.5, 0.5, 0.1, 0.1)] * boxes, 0, size, h, None)


def test_duplicates_and_negatives(spark):
    rows = [record(1, "k", 5), record(2, "k", 9), record(3, "k", 99, 0), record(4, None, 1), record(5, None, None, 0), record(6, "n", 3, 0)]
    df = spark.createDataFrame(rows, RECORDS)
    assert sorted(r.record_id for r in C.best_variant(df).collect()) == [2, 4, 5, 6]
    kept = {r.record_id for r in C.limit_negatives(df, 0.34).collect()}
    assert {1, 2, 4} < kept and len(kept) == 4
    assert C.limit_negatives(df.limit(0)).count() == 0 and C.best_variant(df.limit(0)).count() == 0
    s = spark.createDataFrame([("s", 1), ("t", 0)], "short_name string, priority int")
    same = spark.createDataFrame([record(1, "a", 9, h="h"), record(2, "b", 5, source="t", h="h"), record(3, "b", 5, source="t", h="h"), record(4, "c", 1)], RECORDS)
    assert sorted(r.record_id for r in C.best_exact(same, s).collect()) == [2, 4]


def test_grouped_split(spark):
    rows = [record(i, f"k{i}", 1, clip=f"clip{i % 40}", source="ab"[i % 40 % 2]) for i in range(400)]
    got = {r.clip_key: r.clean_split for r in C.grouped_split(spark.createDataFrame(rows, RECORDS)).collect()}
    assert len(got) == 40
    sizes = {s: sum(v == s for v in got.values()) * 10 for s in C.SPLITS}
    assert sizes == {"train": 320, "valid": 40, "test": 40}
    assert C.grouped_split(spark.createDataFrame([], RECORDS)).count() == 0
    with pytest.raises(Exception, match="more than 3"):
        C.grouped_split(spark.createDataFrame(rows, RECORDS), 3).collect()
    split = spark.createDataFrame([("c1", "train"), ("c2", "test")], "clip_key string, clean_split string")
    torn = [record(1, "same", 1, clip="c1"), record(2, "same", 1, clip="c2"), record(3, "own", 1, clip="c2"), record(4, None, 1, clip=None)]
    assert tuple(C.split_overlap(spark.createDataFrame(torn, RECORDS), split).first()) == (0, 1)


def test_manifest_and_negatives(spark):
    df = spark.createDataFrame([record(1, "k", 5, h="aa:5"), record(2, None, 5, 0)], RECORDS).withColumn("assigned_split", F.lit("train"))
    rows = {r.source_image: r for r in C.manifest(df).collect()}
    import hashlib

    assert rows["img1.jpg"].clean_image == "train/images/s__" + hashlib.sha1(b"s:k:aa:5").hexdigest()[:16] + ".jpg" and tuple(rows["img1.jpg"].asDict()) == C.MANIFEST
    assert tuple(C.negative_stats(df).first()) == (1, 1, 0, 0.25) and tuple(C.negative_stats(df.limit(0)).first()) == (0, 0, 0, 0.25)
    assert C.manifest(df.limit(0)).count() == 0
