"""Discovery, archives, JSON lines, dataset and manifest files."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

# Suffixes of videos and pictures.
VIDEOS = ("mp4", "mov", "avi", "mkv", "m4v")
PICTURES = ("jpg", "jpeg", "png", "bmp", "webp")
SPLITS = ("train", "valid", "test")
MEMBERS = "archive string, split string, name string, stem string, crc long, size long, label_text string, error string"


def _opened(uri: str):
    """A seekable file of any file system that Arrow knows (local, HDFS, object stores), by its URI or path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if re.match(r"^[a-zA-Z][\w+.-]*:", uri) else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


def discover(spark: SparkSession, path: str, recursive: bool = False, suffixes: tuple[str, ...] = VIDEOS) -> DataFrame:
    """``path`` of videos in a folder (only the listing is read, no content), in order of lower-case path. A file is itself, whatever its suffix. Any file system that the session can read will do."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) and system.getFileStatus(target).isFile():
        return spark.createDataFrame([(path,)], "path string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    fits = F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$")
    return found.select(F.regexp_replace("path", "^file:", "").alias("path")).filter(fits).orderBy(F.lower("path"))


def output_names(path: Column, root: str) -> tuple[Column, Column]:
    """Video and JSON-lines names for a source below ``root``, subfolders kept."""
    bare = F.regexp_replace(F.regexp_replace(path, f"^{root.rstrip('/')}/", ""), r"\.[^./]*$", "")
    return F.concat(bare, F.lit("_tracked.mp4")), F.concat(bare, F.lit("_tracking.jsonl"))


def frame_range(frames: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Frames from ``max(0, start)`` on, at most ``limit`` of each stream's index range; both bounds reach the scan."""
    start = max(0, start)
    out = frames.filter(F.col("frame_index") >= start)
    return out if limit is None else out.filter(F.col("frame_index") < start + limit)


def archive_members(spark: SparkSession, path: str, labels_a_task: int = 2000) -> DataFrame:
    """Pictures of ZIP archives, from the central directory: ``split/images/name``; the label is read from the same archive, a missing or unreadable one is an error row.

    Archives are opened and sought in, never read whole, and no picture is unpacked. The directories are
    listed a task an archive; the labels are then read in groups of ``labels_a_task``, so that one large
    archive is spread over tasks.
    """

    def directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["path"]:
                rows = []
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    names = set(z.namelist())
                    for info in z.infolist():
                        parts = info.filename.split("/")
                        if len(parts) != 3 or parts[0] not in SPLITS or parts[1] != "images":
                            continue
                        stem, _, suffix = parts[2].rpartition(".")
                        if stem and suffix.lower() in PICTURES:
                            missing = f"{parts[0]}/labels/{stem}.txt" not in names
                            rows.append((archive, parts[0], parts[2], stem, info.CRC, info.file_size, None, "missing label" if missing else None))
                for at in range(0, len(rows), labels_a_task):
                    yield pd.DataFrame(rows[at : at + labels_a_task], columns=_names(MEMBERS)).assign(part=at // labels_a_task)

    def labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, own in pdf.groupby("archive", sort=False):
                texts, errors = [], []
                with _opened(archive) as f, zipfile.ZipFile(f) as z:
                    for split, stem, error in zip(own["split"], own["stem"], own["error"]):
                        text = None
                        if not error:
                            try:
                                text = z.read(f"{split}/labels/{stem}.txt").decode("utf-8-sig")
                            except (OSError, UnicodeError, zipfile.BadZipFile) as e:
                                error = f"unreadable label: {type(e).__name__}"
                        texts.append(text)
                        errors.append(error or None)
                yield own.assign(label_text=texts, error=errors)[_names(MEMBERS)]

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    listed = archives.repartition("path").mapInPandas(directory, f"{MEMBERS}, part int")
    return listed.repartition("archive", "part").sortWithinPartitions("archive").drop("part").mapInPandas(labels, MEMBERS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# The fields of a track in a frame's line, in order.
TRACK_FIELDS = ("track_id", "status", "center", "bbox", "confidence", "velocity", "missing_frames", "source", "roi", "age", "hits", "confirmed", "motion_confirmed", "stationary_frames")


def frame_json(frames: DataFrame, detections: DataFrame, tracks: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One JSON line per frame, nulls written out; ``ball_track`` only where there is exactly one track.

    A track has its 14 fields (``center, bbox, velocity, roi`` are arrays; those that ``tracks`` lacks are null);
    ``diagnostics`` (a row per frame) become an object, null without.
    """
    keys = ["stream_id", "frame_index"]
    det = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("det_idx", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.array("cx", "cy").alias("center"), "confidence", "source"))).alias("ball_detections"))
    det = det.withColumn("ball_detections", F.transform("ball_detections", lambda b: F.struct(*[b[c].alias(c) for c in ("bbox", "center", "confidence", "source")])))
    flat = {"center": ("cx", "cy"), "bbox": ("x1", "y1", "x2", "y2"), "velocity": ("vx", "vy")}

    def field(name: str) -> Column:
        if name in tracks.columns:
            return F.col(name)
        if name in flat and set(flat[name]) <= set(tracks.columns):
            return F.when(F.col(flat[name][0]).isNotNull(), F.array(*flat[name]))
        return F.lit(None).cast("array<double>" if name in flat or name == "roi" else "string")

    trk = tracks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[field(n).alias(n) for n in TRACK_FIELDS]))).alias("ball_tracks"))
    joined = frames.join(det, keys, "left").join(trk, keys, "left")
    if diagnostics is None:
        joined = joined.withColumn("diagnostics", F.lit(None).cast("string"))
    else:
        joined = joined.join(diagnostics.select(*keys, F.struct(*[c for c in diagnostics.columns if c not in keys]).alias("diagnostics")), keys, "left")
    none = lambda c: F.coalesce(c, F.array())
    line = F.struct(
        "frame_index", F.col("ts_s").alias("timestamp"), none(F.col("ball_detections")).alias("ball_detections"), none(F.col("ball_tracks")).alias("ball_tracks"), F.when(F.size("ball_tracks") == 1, F.get("ball_tracks", F.lit(0))).alias("ball_track"), "diagnostics", "width", "height"
    )
    return joined.select("stream_id", "frame_index", F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """JSON lines per stream, in frame order inside a stream's file."""
    lines.repartition("stream_id").sortWithinPartitions("stream_id", "frame_index").select("stream_id", "value").write.mode("overwrite").partitionBy("stream_id").text(path)


def _target(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-zA-Z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    """A whole file at once: written aside and moved, so that a task that runs again leaves no half of one."""
    system, at = _target(path)
    aside = f"{at}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(aside) as f:
        f.write(data)
    system.move(aside, at)


def materialise(source: str, archive: str | None, member: str | None, to: str) -> str:
    """Puts one picture in place and says how: ``hardlink``, else ``copy``, else ``zip_extract`` from its archive; ``missing`` where none works."""
    local = source.removeprefix("file:")
    if not re.match(r"^[a-zA-Z][\w+.-]*:", to):
        aside = f"{to}.{uuid.uuid4().hex}.part"
        for method, put in (("hardlink", os.link), ("copy", shutil.copyfile)):
            try:
                put(local, aside)
                os.replace(aside, to)
                return method
            except OSError:
                continue
    if archive and member:
        with _opened(archive) as f, zipfile.ZipFile(f) as z:
            try:
                data = z.read(member)
            except KeyError:
                return "missing"
        _put(to, data)
        return "zip_extract"
    return "missing"


def write_dataset(records: DataFrame, path: str, root: str = "") -> DataFrame:
    """The cleaned data set: ``split/images/<stem>.<suffix>`` and ``split/labels/<stem>.txt`` for each record of the three splits; refuses an output that exists. Returns ``clean_split, stem, method`` of what was written.

    ``records``: fields of a record with ``clean_split``, perhaps ``archive, member``; pictures are looked for at
    ``root/image``. Files are written by the tasks, whole or not at all; ``path`` must be one that all of them share.
    """
    from ..operators.cleaning import label_lines, output_stem

    system, at = _target(path)
    if system.get_file_info(at).type.name != "NotFound":
        raise FileExistsError(f"the output exists: {path}")
    for split in SPLITS:
        for kind in ("images", "labels"):
            system.create_dir(f"{at}/{split}/{kind}")
    text = label_lines(records)
    rows = records.filter(F.col("clean_split").isin(*SPLITS)).join(text, "record_id")
    more = [F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in ("archive", "member")]
    rows = rows.select("clean_split", output_stem().alias("stem"), "image", F.coalesce("label_text", F.lit("")).alias("label_text"), *more)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            methods = []
            for split, stem, image, label, archive, member in pdf.itertuples(index=False):
                suffix = os.path.splitext(image or "")[1].lower()
                methods.append(materialise(f"{root}/{image}" if root else image or "", archive, member, f"{path}/{split}/images/{stem}{suffix}"))
                _put(f"{path}/{split}/labels/{stem}.txt", label.encode("ascii"))
            yield pd.DataFrame({"clean_split": pdf["clean_split"], "stem": pdf["stem"], "method": methods})

    scratch = Scratch(records.sparkSession)
    return scratch.cut(rows.mapInPandas(write, "clean_split string, stem string, method string"))


def write_manifest(rows: DataFrame, path: str) -> None:
    """CSV by split and key: the files ``part-NNNNN.csv`` in order are the manifest. The first begins with a byte order mark and the header; an empty manifest is just that. Refuses an output that exists."""
    names = rows.columns
    system, at = _target(path)
    if system.get_file_info(at).type.name != "NotFound":
        raise FileExistsError(f"the output exists: {path}")
    system.create_dir(at)

    def lines(values) -> str:
        text = io.StringIO()
        csv.writer(text).writerows(values)
        return text.getvalue()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() + 1
        text = "".join(lines([None if pd.isna(v) else v for v in row] for row in pdf.astype(object).itertuples(index=False)) for pdf in batches)
        if text:
            _put(f"{path}/part-{number:05d}.csv", text.encode("utf-8"))
        yield pd.DataFrame({"part": [number]})

    _put(f"{path}/part-00000.csv", lines([names]).encode("utf-8-sig"))
    rows.orderBy(names[0], names[5] if len(names) > 5 else names[-1]).mapInPandas(write, "part int").write.format("noop").mode("overwrite").save()


def dataset_descriptor(names: list[str], points: int = 0) -> str:
    """Text of data.yaml: where the splits are and what the classes mean; with ``points``, the shape of the key points."""
    shape = f"kpt_shape: [{points}, 3]\nflip_idx: [{', '.join(map(str, range(points)))}]\n\n" if points else ""
    return "path: .\ntrain: train/images\nval: valid/images\ntest: test/images\n\n" + shape + "names:\n" + "".join(f"  {i}: {n}\n" for i, n in enumerate(names))


def write_report(rows: DataFrame, errors: DataFrame, written: DataFrame, path: str, names: list[str]) -> dict:
    """``cleaning_report.json``, a summary in README.md and data.yaml, from the report's rows (``report_rows``), the error list and what was written. All three are small by nature. Returns the report."""
    from ..operators.cleaning import method_counts

    report: dict = {"errors": [r["error"] for r in errors.collect()]}
    whole = lambda v: int(v) if v == int(v) else v
    for r in rows.collect():
        place = report.setdefault(r["section"], {})
        if r["source"] is not None:
            place = place.setdefault(r["source"], {})
        place[r["name"]] = whole(r["value"])
    report |= report.pop("raw", {}) | report.pop("clips", {})
    report["output_image_methods"] = {r["method"]: r["n"] for r in method_counts(written).collect()}
    _put(f"{path}/cleaning_report.json", json.dumps(report, ensure_ascii=False, indent=2).encode("utf-8"))
    splits = report.get("cleaned_splits", {})
    figures = {
        "Images": sum(splits.values()), "Splits": splits, "Clip groups": report.get("clip_groups", 0), "Variants removed": report.get("source_deduplication", {}).get("variants_removed", 0),
        "Exact copies removed": report.get("exact_deduplication", {}).get("exact_duplicates_removed", 0), "Negatives kept": report.get("negative_sampling", {}).get("kept_negative_images", 0),
    }
    _put(f"{path}/README.md", ("# Cleaned data set\n\n" + "".join(f"- {k}: {v}\n" for k, v in figures.items()) + "\nAll figures: cleaning_report.json, every picture: manifest.\n").encode("utf-8"))
    _put(f"{path}/data.yaml", dataset_descriptor(names).encode("ascii"))
    return report
