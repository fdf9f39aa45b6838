import csv
import io
import json
import zipfile

import pytest

from trackloom.sources import files
from pyspark.sql import functions as F


def test_discovery(spark, tmp_path):
    (tmp_path / "session").mkdir()
    for n in ("b.MP4", "a.mp4", "notes.txt", "session/c.mov"):
        (tmp_path / n).write_bytes(b"x")
    name = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert name(files.discover(spark, str(tmp_path))) == ["a.mp4", "b.MP4"]
    assert name(files.discover(spark, str(tmp_path), True)) == ["a.mp4", "b.MP4", "c.mov"]
    assert name(files.discover(spark, str(tmp_path / "notes.txt"))) == ["notes.txt"]
    video, lines = files.output_names(F.lit("/r/x/y.mp4"), "/r")
    assert tuple(spark.range(1).select(video, lines).first()) == ("x/y_tracked.mp4", "x/y_tracking.jsonl")


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("train/images/p.jpg", b"pixels")
        z.writestr("train/labels/p.txt", "﻿0 0.5 0.5 0.1 0.1")
        z.writestr("valid/images/q.PNG", b"more")
        z.writestr("other/images/r.jpg", b"no")
        z.writestr("train/images/deep/s.jpg", b"no")
    rows = {r.name: r for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert set(rows) == {"p.jpg", "q.PNG"}
    assert {(r.name, r.error) for r in files.archive_members(spark, str(tmp_path), labels_a_task=1).collect()} == {(n, r.error) for n, r in rows.items()}
    assert rows["p.jpg"].label_text == "0 0.5 0.5 0.1 0.1" and rows["p.jpg"].size == 6 and rows["q.PNG"].error == "missing label"


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("s", 1, '{"a":1}'), ("s", 0, '{"a":0}')], "stream_id string, frame_index long, value string")
    files.write_lines(lines, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/stream_id=s")).collect()] == ['{"a":0}', '{"a":1}']
    rows = spark.createDataFrame([], "clean_split string, source_key string, n int")
    files.write_manifest(rows, str(tmp_path / "m"))
    assert (tmp_path / "m/part-00000.csv").read_bytes() == b"\xef\xbb\xbfclean_split,source_key,n\r\n" and len(list((tmp_path / "m").iterdir())) == 1
    with pytest.raises(FileExistsError):
        files.write_manifest(rows, str(tmp_path / "m"))


def test_frame_lines(spark):
    f = spark.createDataFrame([("s", 0, 0.0, 4, 3), ("s", 1, None, 4, 3)], "stream_id string, frame_index long, ts_s double, width int, height int")
    d = spark.createDataFrame([("s", 0, k, 1.0, 1.0, 2.0, 2.0, 1.5, 1.5, 0.5, None) for k in (1, 0)], "stream_id string, frame_index long, det_idx int, x1 double, y1 double, x2 double, y2 double, cx double, cy double, confidence double, source string")
    t = spark.createDataFrame([("s", 0, 7, "observed", 1.0, 2.0, 0.9)], "stream_id string, frame_index long, track_id long, status string, cx double, cy double, confidence double")
    lines = {r.frame_index: json.loads(r.value) for r in files.frame_json(f, d, t).collect()}
    assert lines[1] == {"frame_index": 1, "timestamp": None, "ball_detections": [], "ball_tracks": [], "ball_track": None, "diagnostics": None, "width": 4, "height": 3}
    assert tuple(lines[0]["ball_track"]) == files.TRACK_FIELDS and lines[0]["ball_tracks"] == [lines[0]["ball_track"]] and lines[0]["ball_track"]["center"] == [1.0, 2.0] and lines[0]["ball_track"]["roi"] is None
    assert len(lines[0]["ball_detections"]) == 2 and set(lines[0]["ball_detections"][0]) == {"bbox", "center", "confidence", "source"}


def test_the_job_from_archives_to_report(spark, tmp_path):
    """Scan, parse, clean, write: pictures by link or out of the archive, labels, manifest, report."""
    from trackloom.operators import cleaning

    source, out = tmp_path / "in", tmp_path / "out"
    (source / "Cam One/train/images").mkdir(parents=True)
    with zipfile.ZipFile(source / "cam-one.zip", "w") as z:
        for i in range(12):
            name = f"clip{i // 3}-{i:04d}_jpg.rf.{i:032x}.jpg"
            z.writestr(f"train/images/{name}", b"x" * (100 + i))
            z.writestr(f"train/labels/{name[:-4]}.txt", "" if i == 4 else "0 0.5 0.5 0.1 0.1\n2 1 1 1 1" if i != 5 else "0 a b c d")
            if i != 7:
                (source / "Cam One/train/images" / name).write_bytes(b"x" * (100 + i))
        z.writestr("train/images/nolabel.png", b"y")
    sources = spark.createDataFrame([("cam", "Cam One", "cam-one.zip", 0, 0)], "short_name string, folder string, archive string, ball_class int, priority int")
    parsed = cleaning.records_of(files.archive_members(spark, str(source)), sources)
    errors = [r.error for r in cleaning.error_list(parsed).collect()]
    assert sorted(e.split(": ", 1)[1] for e in errors) == ["line 1: non-numeric value", "missing label"]
    done = cleaning.clean(parsed.filter("errors = 0"), sources).cache()
    written = files.write_dataset(done, str(out), str(source))
    methods = {r.method: r.n for r in cleaning.method_counts(written).collect()}
    assert methods["zip_extract"] == 1 and sum(methods.values()) == done.count() == 11 and "missing" not in methods
    with pytest.raises(FileExistsError):
        files.write_dataset(done, str(out))
    rows = cleaning.manifest(done, "clean_split")
    files.write_manifest(rows, str(out / "manifest"))
    text = b"".join(p.read_bytes() for p in sorted((out / "manifest").iterdir())).decode("utf-8-sig")
    listed = list(csv.DictReader(io.StringIO(text)))
    assert len(listed) == 11 and [(r["clean_split"], r["source_frame_key"]) for r in listed] == sorted((r["clean_split"], r["source_frame_key"]) for r in listed)
    for r in listed:
        picture = out / r["clean_image"]
        label = picture.parent.parent / "labels" / (picture.stem + ".txt")
        assert picture.stat().st_size == int(r["content_fingerprint"].split(":")[1]) and label.read_text() == ("0 0.50000000 0.50000000 0.10000000 0.10000000\n" if int(r["ball_count"]) else "")
    report = files.write_report(cleaning.report_rows(parsed, sources), cleaning.error_list(parsed), written, str(out), ["ball"])
    assert json.loads((out / "cleaning_report.json").read_text()) == report and report["sources"]["cam"]["images"] == 13 and report["sources"]["cam"]["invalid_images"] == 2
    assert report["raw_valid_records"] == 11 and sum(report["cleaned_splits"].values()) == 11 and report["clip_group_overlap_after_resplit"] == 0 and report["output_image_methods"] == methods
    assert (out / "data.yaml").read_text().endswith("names:\n  0: ball\n") and "kpt_shape: [2, 3]" in files.dataset_descriptor(["p"], 2)
