"""Problem 3: the same record content across splits, by content-defined chunks.

The normalised fields of a record are cut where a rolling hash has a local minimum, so that equal stretches
give equal chunks wherever they stand. Chunk digests are joined across splits; the lengths of a record's
chunks that stand in the other split, summed, are its overlap with it (``overlaps``). Two values overlap
fully, each by the other, where all their chunks are the same in the same order: such values have one
``cover``, and records are linked by the covers of their frames and checksums (``image_groups``), closed
under "A is B, B is C".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import checksum, frame_name, split_name
from ..session import Scratch
from .components import linked_groups

REACH = 10  # a cut is the least hash within so many bytes on both sides: chunks of about 2 * REACH bytes
WINDOW = 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Offsets where chunks begin, in ascending order; every non-empty value begins one. Depends on the value's own bytes alone."""
    n = len(data)
    begin = np.zeros(n, bool)
    lengths = ends - starts
    begin[starts[lengths > 0]] = True
    own = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(n) - np.repeat(starts, lengths)
    rolling = np.zeros(n, np.uint64)
    for j, power in enumerate(_powers(np.uint64(0x9E3779B97F4A7C15), WINDOW)):
        rolling[j:] += (data[: n - j].astype(np.uint64) + np.uint64(1)) * power
    # The first bytes' windows reach into the value before: they are nobody's least.
    hashed = np.where(place < WINDOW - 1, np.uint64(0xFFFFFFFFFFFFFFFF), _mix(rolling))
    least = (place >= reach) & (place >= WINDOW - 1)
    for d in range(1, min(reach, n - 1) + 1 if n else 1):
        same = own[d:] == own[:-d]
        least[d:] &= ~same | (hashed[d:] < hashed[:-d])
        least[:-d] &= ~same | (hashed[:-d] <= hashed[d:])
    return np.flatnonzero(begin | least)


FIELDS = ("frame", "checksum", "boxes")
IDENTITY = FIELDS[:2]  # what says which image a record shows
NEAR = 0.8  # least overlap of a record that is nearly in the other split
STEP, TURN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _cut(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, digest and length of each chunk of a string column, in order; null and empty values have none."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cuts = cut_points(data, offsets[:-1], offsets[1:])
    if not len(cuts):
        return cuts, np.zeros(0, np.uint64), cuts
    sizes = np.diff(np.append(cuts, len(data)))
    place = np.arange(len(data)) - np.repeat(cuts, sizes)
    with np.errstate(over="ignore"):
        digest = _mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _powers(STEP, int(sizes.max()))[place], cuts) + sizes.astype(np.uint64) ^ np.uint64(seed + 1))
    return np.searchsorted(offsets, cuts, "right") - 1, digest, sizes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "side")]
        for field, name in enumerate(FIELDS):
            row, digest, sizes = _cut(batch.column(batch.schema.get_field_index(name)), field)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[k.take(taken) for k in keep], pa.array(digest.view(np.int64)), pa.array(sizes.astype(np.int32))], names=["record_id", "side", "digest", "length"])


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays, names = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "side")], ["record_id", "side"]
        for field, name in enumerate(IDENTITY):
            row, digest, _ = _cut(batch.column(batch.schema.get_field_index(name)), field)
            head = np.flatnonzero(np.diff(row, prepend=-1))
            place = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
            for k, base in enumerate((STEP, TURN)):
                out, none = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
                if len(row):
                    with np.errstate(over="ignore"):
                        sums = _mix(np.add.reduceat(_mix(digest + np.uint64(k)) * _powers(base, int(place.max()) + 1)[place], head))
                    out[row[head]], none[row[head]] = sums.view(np.int64), False
                arrays.append(pa.array(out, mask=none))
                names.append(f"{name}_{k}")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _sided(records: DataFrame, *more: F.Column) -> DataFrame:
    """``record_id, side, frame, checksum``, normalised. side: T train, E valid or test, N neither."""
    side = F.element_at(F.create_map(*map(F.lit, ("train", "T", "valid", "E", "test", "E"))), split_name(F.col("assigned_split")))
    return records.select("record_id", F.coalesce(side, F.lit("N")).alias("side"), frame_name(F.col("source_key")).alias("frame"), checksum(F.col("image_hash")).alias("checksum"), *more)


def chunk_table(records: DataFrame) -> DataFrame:
    """``record_id, side, digest, length`` for each chunk of a record's frame, checksum and boxes; equal text of different fields has different digests."""
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", *[F.round(b[c], 4) for c in "xywh"])), ";")
    return _sided(records, boxes.alias("boxes")).mapInArrow(_chunks, "record_id long, side string, digest long, length int")


def overlaps(records: DataFrame) -> DataFrame:
    """``record_id, side, overlap``: the share of the record's length in chunks that also stand in the other side (train against valid and test), anywhere in it.

    A record without train, valid or test has nought; one without any value has no row.
    """
    chunks = chunk_table(records)
    # Hot digests (a clip's common part) shrink to one row each before they move.
    seen = chunks.groupBy("digest").agg(F.max(F.col("side") == "T").alias("t"), F.max(F.col("side") == "E").alias("e")).filter("t AND e").select("digest", F.lit(True).alias("both"))
    held = chunks.join(seen, "digest", "left")
    shared = F.when(F.col("both") & (F.col("side") != "N"), F.col("length")).otherwise(0)
    return held.groupBy("record_id", "side").agg((F.sum(shared) / F.sum("length")).alias("overlap"))


def image_groups(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(record_id, side, group_id)`` of every record: records whose frames, or whose checksums, have the same chunks in the same order are one image, directly or by way of others. Covers have 128 bits."""
    schema = "record_id long, side string, " + ", ".join(f"{f}_{k} long" for f in IDENTITY for k in (0, 1))
    covers = _sided(records).mapInArrow(_covers, schema).select("record_id", "side", *[F.unhex(F.concat(*[F.lpad(F.hex(f"{f}_{k}"), 16, "0") for k in (0, 1)])).alias(f) for f in IDENTITY])
    with Scratch(records.sparkSession) as inner:
        covers = inner.cut(covers)
        return scratch.cut(linked_groups(covers, "record_id", list(IDENTITY), inner).join(covers.select("record_id", "side"), "record_id"))


def linked(groups: DataFrame) -> DataFrame:
    """``record_id, side, group_id, links`` of the records that stand in a pair: one row a record with its class and how many records of the other side show the same image. Groups are counted, pairs never built."""
    sides = groups.groupBy("group_id").agg(F.count_if(F.col("side") == "T").alias("t"), F.count_if(F.col("side") == "E").alias("e")).filter("t > 0 AND e > 0")
    return groups.filter("side <> 'N'").join(sides, "group_id").select("record_id", "side", "group_id", F.when(F.col("side") == "T", F.col("e")).otherwise(F.col("t")).alias("links"))


def cross_split_pairs(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``(record_id_a, record_id_b)``, smaller first: one train record and one valid or test record of the same image. Every such pair, and no pair within a split."""
    groups = image_groups(records, scratch)
    both = groups.groupBy("group_id").agg(F.max(F.col("side") == "T").alias("t"), F.max(F.col("side") == "E").alias("e")).filter("t AND e").select("group_id")
    torn = groups.join(both, "group_id", "left_semi")
    train = torn.filter("side = 'T'").select("group_id", F.col("record_id").alias("t"))
    held = torn.filter("side = 'E'").select("group_id", F.col("record_id").alias("e"))
    return train.join(held, "group_id").select(F.least("t", "e").alias("record_id_a"), F.greatest("t", "e").alias("record_id_b")).distinct()


def overlap_members(records: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per record that the other side holds, exactly or nearly: ``record_id, side, group_id`` (its image), ``links`` (records of the other side that show it; 0 for a near one), ``overlap`` (share of its chunks' length in the other side) and ``near``.

    near: no record of the other side shows the image, but at least ``NEAR`` of the record's length stands there.
    """
    groups = image_groups(records, scratch)
    exact = linked(groups).select("record_id", "links")
    both = groups.join(overlaps(records).select("record_id", "overlap"), "record_id", "left").join(exact, "record_id", "left")
    near = F.col("links").isNull() & (F.coalesce("overlap", F.lit(0.0)) >= NEAR)
    out = both.select("record_id", "side", "group_id", F.coalesce("links", F.lit(0)).alias("links"), F.round(F.coalesce("overlap", F.lit(0.0)), 4).alias("overlap"), near.alias("near"))
    return out.filter("links > 0 OR near")


def overlap_report(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Per split and source: records, overlapping (records that stand in a pair of ``cross_split_pairs``) and pairs (those a record of this split and source stands in). A null source or split is one of its own.

    A pair counts once at its train record and once at its valid or test record.
    """
    paired = linked(image_groups(records, scratch)).select("record_id", "links")
    base = records.select("record_id", F.coalesce(F.nullif(split_name(F.col("assigned_split")), F.lit("")), F.lit("none")).alias("split"), F.coalesce("source", F.lit("none")).alias("source"))
    return base.join(paired, "record_id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("links").alias("overlapping"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
