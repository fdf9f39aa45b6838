"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import Scratch, table
from . import forms, leaks, overlap, packing, runs, splits, survivors


def p1_runs(spark, d):
    tracks, frames = table(spark, d, "ball_tracks"), table(spark, d, "frames")
    return runs.with_duration(runs.runs(tracks, Scratch(spark)), frames).select("stream_id", "track_id", "status", "first_frame", "last_frame", "frames", "duration_s")


def p1_found(spark, d):
    return runs.runs(table(spark, d, "ball_tracks"), Scratch(spark)).filter("last_frame > first_frame").select("stream_id", "track_id", "first_frame", "last_frame")


def p2_found(spark, d):
    return splits.straddling(table(spark, d, "records"), Scratch(spark))


def p2_split(spark, d):
    return splits.assign_splits(table(spark, d, "records"), table(spark, d, "split_targets"), Scratch(spark))


def p2_report(spark, d):
    return splits.split_report(p2_split(spark, d))


def p3_found(spark, d):
    return overlap.cross_split_pairs(table(spark, d, "records"), Scratch(spark))


def p3_report(spark, d):
    return overlap.overlap_report(table(spark, d, "records"), Scratch(spark))


def p3_overlaps(spark, d):
    return overlap.overlap_members(table(spark, d, "records"), Scratch(spark))


def p4_found(spark, d):
    return survivors.duplicate_members(table(spark, d, "records"), Scratch(spark))


def p4_survivors(spark, d):
    best = survivors.survivors(table(spark, d, "records"), table(spark, d, "sources"), Scratch(spark))
    return best.withColumn("boxes", survivors.box_text(F.col("boxes")))


def p6_pack(spark, d):
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_profiles"), Scratch(spark))


def p6_report(spark, d):
    return packing.packing_report(p6_pack(spark, d), table(spark, d, "pack_profiles"))


def p7_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p7_leaks(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return forms.same_looking(table(spark, d, "documents"), Scratch(spark))


def p8_classes(spark, d):
    return forms.same_looking_classes(table(spark, d, "documents"), Scratch(spark))


def p8_forms(spark, d):
    return forms.forms(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_split, p2_report, p3_found, p3_report, p3_overlaps, p4_found, p4_survivors, p6_pack, p6_report, p7_found, p7_leaks, p8_found, p8_classes, p8_forms)}
