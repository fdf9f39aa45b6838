"""Implausible readings of tracks: robust exponentially weighted control charts, run lengths, physical limits.

Each track runs through a chart in both directions. The chart holds an exponentially weighted mean of the
motion and of the size of its errors; a reading beyond the limit is suspected, and only its clipped value
enters mean and scale. A level shift or a turn suspects readings in one direction only; a spike in both.
Suspects of both directions are then measured exactly, against the line between the nearest right readings.

Tracks lie next to each other in a partition and are charted in step: one NumPy operation moves all tracks
of a batch on by one reading. Memory is bounded by the batch and the longest track of a block; tracks beyond
``HOT_ROWS`` rows are cut into blocks of frames, which only spread the work: all blocks are judged by the exact
medians of the whole track, and a block's margins hold so many moving readings that charts, runs and lines
come out as in one piece (a chart forgets by ``1 - ALPHA`` a reading). A margin grows over repeated readings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

FACTOR = 5.0
LEAST_STEP, LEAST_VELOCITY = 0.6, 0.3
OUTSIDE = 0.05
STUCK = 6
ALPHA, CHART_LIMIT, RESTART = 0.3, 2.0, 6
CHASES = (1.0, 0.4)  # a quick chart follows turns at once, a slow one sees the end of a long spike
HOT_ROWS, BLOCK_FRAMES, MARGIN = 50_000, 20_000, 500
CLOSE, SETTLED = 3, 5  # frames between close neighbours, and readings by which the other chart has settled
BATCH_ROWS = 100_000
MEASURES = "stream_id string, track_id long, at long, kind int, key long, first array<double>, last array<double>, heads array<long>, tails array<long>"
EDGES = "stream_id string, track_id long, at long, block long, lo long, hi long, key long"
NO_KEY = int(np.array([np.nan]).view(np.int64)[0])
OUTPUT = "stream_id string, track_id long, frame_index long, physical boolean, off_line boolean, fast boolean, stuck boolean"


def _medians(value: np.ndarray, track: np.ndarray, n: int) -> np.ndarray:
    """Median of value per track (rows in track order); nan where a track has none."""
    order = np.lexsort((value, track))
    counts = np.bincount(track, minlength=n)
    first = np.cumsum(counts) - counts
    out = np.full(n, np.nan)
    some = counts > 0
    lo, hi = first + (counts - 1) // 2, first + counts // 2
    v = value[order]
    out[some] = (v[lo[some]] + v[hi[some]]) / 2
    return out


def _chart(frame: np.ndarray, xy: np.ndarray, usable: np.ndarray, starts: np.ndarray, lengths: np.ndarray, usual: np.ndarray, chase: float) -> np.ndarray:
    """Suspected rows of one direction (starts and lengths in rows; frames rise along a track)."""
    order = np.argsort(-lengths, kind="stable")
    n = len(order)
    level = np.zeros((n, 2))
    speed = np.zeros((n, 2))
    scale = usual[order].copy()
    least = usual[order]
    last = np.zeros(n)
    seen = np.zeros(n, np.int64)
    strikes = np.zeros(n, np.int64)
    suspect = np.zeros(len(frame), bool)
    sorted_lengths = -lengths[order]
    for t in range(int(lengths.max(initial=0))):
        m = int(np.searchsorted(sorted_lengths, -t, "left"))  # tracks with more than t rows
        rows = starts[order[:m]] + t
        on = np.flatnonzero(usable[rows])
        if not len(on):
            continue
        rows = rows[on]
        at, now = xy[rows], frame[rows]
        gap = np.maximum(np.abs(now - last[on]), 1.0)[:, None]
        fresh = seen[on] == 0
        error = at - (level[on] + speed[on] * gap)
        size = np.hypot(error[:, 0], error[:, 1])
        # The next reading may lie a turn away: the limit grows with the lost frames, the scale doesn't lift it beyond the usual step.
        limit = CHART_LIMIT * np.clip(scale[on], 0.5 * least[on], least[on]) * np.sqrt(gap[:, 0])
        out = (size > limit) & (seen[on] > 1)
        strikes[on] = np.where(out, strikes[on] + 1, 0)
        restart = strikes[on] > RESTART
        suspect[rows] = out
        error *= np.where(out, limit / np.maximum(size, 1e-12), 1.0)[:, None]
        anew = (fresh | restart)[:, None]
        second = (seen[on] == 1)[:, None]
        step = (at - level[on]) / gap
        level[on] = np.where(anew, at, level[on] + speed[on] * gap + error * np.where(out, chase, 1.0)[:, None])
        speed[on] = np.where(anew, 0.0, np.where(second, step, speed[on] + ALPHA * error / gap))
        scale[on] = np.where(anew[:, 0], least[on], scale[on] + ALPHA * (np.minimum(size, limit) / gap[:, 0] - scale[on]))
        last[on] = now
        seen[on] = np.where(restart, 1, seen[on] + 1)
        strikes[on] = np.where(restart, 0, strikes[on])
    return suspect


def _near(right: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the nearest right reading before and after, -1 where the track has none."""
    n = len(right)
    rows = np.arange(n)
    first = np.repeat(starts, lengths)
    end = first + np.repeat(lengths, lengths)
    before = np.maximum.accumulate(np.where(right, rows, -1))
    before = np.concatenate([[-1], before[:-1]])
    after = np.minimum.accumulate(np.where(right, rows, n)[::-1])[::-1]
    after = np.concatenate([after[1:], [n]])
    return np.where(before >= first, before, -1), np.where(after < end, after, -1)


def _possible(xy: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a center is finite, and whether it lies outside the picture."""
    lost = np.isnan(side).any(1)
    with np.errstate(invalid="ignore"):
        outside = ((xy < -OUTSIDE * side) | (xy > (1 + OUTSIDE) * side)).any(1) & ~lost
    return np.isfinite(xy).all(1), outside


def _steps(track: np.ndarray, frame: np.ndarray, xy: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Track and step per frame between readings that can be (``good``: their rows)."""
    pair = np.flatnonzero(track[good][1:] == track[good][:-1]) if len(good) > 1 else np.zeros(0, int)
    a, b = good[pair], good[pair + 1] if len(pair) else good[:0]
    return track[a], np.hypot(*(xy[b] - xy[a]).T) / np.maximum(frame[b] - frame[a], 1)


def judge(track: np.ndarray, frame: np.ndarray, xy: np.ndarray, v: np.ndarray, side: np.ndarray, given: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Flags per row. ``track``: rising numbers from 0, rows in order of track and (distinct) frame. Missing values are nan in ``xy`` with ``side`` rows; a row without a center has nan in both and is no reading. ``given``: median step and velocity per track, nan where they are to be taken from the rows."""
    n = int(track[-1]) + 1 if len(track) else 0
    lengths = np.bincount(track, minlength=n)
    starts = np.cumsum(lengths) - lengths
    given = np.full((n, 2), np.nan) if given is None else given
    finite, outside = _possible(xy, side)
    physical = ~finite | outside | ~np.isfinite(v).all(1)
    wrong = ~finite | outside
    velocity = np.hypot(v[:, 0], v[:, 1])
    fine = np.isfinite(velocity)
    own_v = _medians(velocity[fine], track[fine], n)
    usual_v = np.maximum(np.nan_to_num(np.where(np.isnan(given[:, 1]), own_v, given[:, 1])), LEAST_VELOCITY)
    fast = fine & (np.where(fine, velocity, 0) > FACTOR * usual_v[track])
    # Usual step per frame, between readings that can be.
    of, step = _steps(track, frame, xy, np.flatnonzero(~wrong))
    usual = np.maximum(np.nan_to_num(np.where(np.isnan(given[:, 0]), _medians(step, of, n), given[:, 0])), LEAST_STEP)
    # Run lengths: one or both coordinates stay exactly the same while the ball moves.
    stuck = np.zeros(len(track), bool)
    for k in (0, 1):
        c = xy[:, k]
        same = np.zeros(len(c), bool)
        same[1:] = (c[1:] == c[:-1]) & (track[1:] == track[:-1])
        run = np.cumsum(~same) - 1
        count = np.bincount(run) if len(run) else np.zeros(0, int)
        head = np.cumsum(count) - count
        tail = np.minimum(head + count, len(c) - 1)
        inside = track[tail] == track[head]
        leap = np.where(inside & finite[tail], np.hypot(*(xy[tail] - xy[head]).T), 0)
        pace = np.bincount(run, np.where(fine, velocity, 0)) / np.maximum(count, 1) if len(run) else np.zeros(0)
        moving = (pace > LEAST_VELOCITY) | (leap > 2 * usual[track[head]])
        stuck |= same & ((count >= STUCK) & moving)[run]
    wrong |= stuck
    usable = ~wrong
    forward = np.logical_or.reduce([_chart(frame, xy, usable, starts, lengths, usual, c) for c in CHASES])
    flip = np.repeat(2 * starts + lengths - 1, lengths) - np.arange(len(track))
    backward = np.logical_or.reduce([_chart(-frame[flip], xy[flip], usable[flip], starts, lengths, usual, c) for c in CHASES])[flip]
    # The second reading of a track comes before the forward chart has settled, the last but one before the backward chart: there the other one's word will do, between close neighbours.
    before, after = _near(usable, starts, lengths)
    close = usable & (before >= 0) & (after >= 0) & (frame - frame[before] <= CLOSE) & (frame[np.minimum(after, len(track) - 1)] - frame <= CLOSE)
    ahead = np.cumsum(usable)
    rank = ahead - np.repeat(ahead[starts] - usable[starts], lengths) if len(track) else track
    held = np.repeat(np.bincount(track, usable, n).astype(np.int64), lengths)
    forward |= close & (rank == 2) & (held >= SETTLED)
    backward |= close & (held - rank == 1) & (held >= SETTLED)
    off = forward & backward & usable
    for _ in range(12):
        before, after = _near(usable & ~off, starts, lengths)
        rows = np.flatnonzero(off)
        rows = rows[(before[rows] >= 0) & (after[rows] >= 0)]
        p, q = before[rows], after[rows]
        part = ((frame[rows] - frame[p]) / np.maximum(frame[q] - frame[p], 1))[:, None]
        gone = np.hypot(*(xy[rows] - (xy[p] + part * (xy[q] - xy[p]))).T)
        still = np.zeros(len(track), bool)
        still[rows[gone > FACTOR * usual[track[rows]]]] = True
        if (still == off).all():
            break
        off = still
    return {"physical": physical, "off_line": off, "fast": fast, "stuck": stuck}


def _flat(column: pa.Array, size: int) -> np.ndarray:
    """An array column of two numbers as (rows, 2); nan where null or of another length."""
    out = np.full((size, 2), np.nan)
    lengths = np.diff(column.offsets.to_numpy())
    take = np.flatnonzero((lengths == 2) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(float)
    begin = column.offsets.to_numpy()[:-1][take]
    out[take, 0], out[take, 1] = values[begin], values[begin + 1]
    return out


def _judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Flags of whole tracks; rows come in order of stream, track, block, frame and row_id."""
    stream = table.column("stream_id").combine_chunks().dictionary_encode()
    code = stream.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tid, block, frame = (table.column(c).to_numpy().astype(np.int64) for c in ("track_id", "block", "frame_index"))
    change = np.ones(len(code), bool)
    change[1:] = (code[1:] != code[:-1]) | (tid[1:] != tid[:-1]) | (block[1:] != block[:-1])
    once = change.copy()
    once[1:] |= frame[1:] != frame[:-1]
    track = (np.cumsum(change) - 1)[once]
    keep = np.flatnonzero(once)
    center, velocity = (table.column(c).combine_chunks() for c in ("center", "velocity"))
    xy, v = _flat(center, len(code))[keep], _flat(velocity, len(code))[keep]
    has_center = center.is_valid().to_numpy(zero_copy_only=False)[keep]
    has_velocity = velocity.is_valid().to_numpy(zero_copy_only=False)[keep]
    side = np.column_stack([table.column("width").to_numpy(), table.column("height").to_numpy()]).astype(float)[keep]
    reading = np.flatnonzero(has_center)
    flags = {k: np.zeros(len(keep), bool) for k in ("physical", "off_line", "fast", "stuck")}
    if len(reading):
        heads, numbers = np.unique(track[reading], return_index=True, return_inverse=True)[1:]
        given = None
        if "step_lo" in table.column_names:
            low, high = (np.column_stack([table.column(f"{k}_{e}").fill_null(NO_KEY).to_numpy() for k in ("step", "velocity")]).astype(np.int64)[keep[reading[heads]]].view(np.float64) for e in ("lo", "hi"))
            given = (low + high) / 2
        vr = np.where(has_velocity[reading][:, None], v[reading], 0.0)
        for k, x in judge(numbers, frame[keep][reading].astype(float), xy[reading], vr, side[reading], given).items():
            flags[k][reading] = x
    own = table.column("own").to_numpy(zero_copy_only=False)[keep]
    found = np.flatnonzero(np.logical_or.reduce(list(flags.values())) & own)
    if len(found):
        rows = keep[found]
        yield pa.RecordBatch.from_arrays(
            [table.column("stream_id").combine_chunks().take(pa.array(rows)), pa.array(tid[rows]), pa.array(frame[rows]), *[pa.array(flags[k][found]) for k in flags]],
            names=["stream_id", "track_id", "frame_index", *flags],
        )


def _measured(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole blocks of hot tracks: velocities (kind 0) and steps (kind 1) as the bits of a double, which order as it does; and one row per block (kind 2) of its outermost possible readings and the frames of its outermost ``MARGIN`` moving ones."""
    stream = table.column("stream_id").combine_chunks()
    code = stream.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tid, block, frame = (table.column(c).to_numpy().astype(np.int64) for c in ("track_id", "block", "frame_index"))
    change = np.ones(len(code), bool)
    change[1:] = (code[1:] != code[:-1]) | (tid[1:] != tid[:-1]) | (block[1:] != block[:-1])
    once = change.copy()
    once[1:] |= frame[1:] != frame[:-1]
    keep = np.flatnonzero(once)
    track, at = (np.cumsum(change) - 1)[once], frame[keep]
    velocity = table.column("velocity").combine_chunks()
    has = velocity.is_valid().to_numpy(zero_copy_only=False)[keep]
    xy, v = _flat(table.column("center").combine_chunks(), len(code))[keep], np.where(has[:, None], _flat(velocity, len(code))[keep], 0.0)
    side = np.column_stack([table.column("width").to_numpy(), table.column("height").to_numpy()]).astype(float)[keep]
    finite, outside = _possible(xy, side)
    can = finite & ~outside
    good = np.flatnonzero(can)
    pace = np.hypot(v[:, 0], v[:, 1])
    pace_of, pace = track[np.isfinite(pace)], pace[np.isfinite(pace)]
    step_of, step = _steps(track, at.astype(float), xy, good)
    moving = np.zeros(len(keep), bool)
    moving[1:] = can[1:] & (track[1:] == track[:-1]) & (xy[1:] != xy[:-1]).all(1)
    moved = np.flatnonzero(moving)
    heads = keep[np.flatnonzero(np.diff(track, prepend=-1))]
    number = np.arange(len(heads))

    def outer(rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, np.searchsorted(track[rows], number[1:]))

    first, last, front, back = [], [], [], []
    for own, move in zip(outer(good), outer(moved)):
        first.append([float(at[own[0]]), *xy[own[0]].tolist()] if len(own) else None)
        last.append([float(at[own[-1]]), *xy[own[-1]].tolist()] if len(own) else None)
        front.append(at[move[:MARGIN]].tolist())
        back.append(at[move[-MARGIN:]].tolist())
    nothing = [None] * (len(pace) + len(step))
    of = np.concatenate([pace_of, step_of, number])
    key = pa.array([*pace.astype(np.float64).view(np.int64).tolist(), *step.astype(np.float64).view(np.int64).tolist(), *[None] * len(heads)], pa.int64())
    kind = np.repeat(np.array([0, 1, 2], np.int32), [len(pace), len(step), len(heads)])
    arrays = [pa.array(nothing + x, t) for x, t in ((first, pa.list_(pa.float64())), (last, pa.list_(pa.float64())), (front, pa.list_(pa.int64())), (back, pa.list_(pa.int64())))]
    yield pa.RecordBatch.from_arrays([stream.take(pa.array(heads[of])), pa.array(tid[heads[of]]), pa.array(block[heads[of]]), pa.array(kind), key, *arrays], names=["stream_id", "track_id", "at", "kind", "key", "first", "last", "heads", "tails"])


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _tracks(batches, _measured)


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hot track's blocks: which block takes rows of which, from frame lo to hi, and (key, at the block itself) the step over its front edge."""
    pdf = pdf.sort_values("at", ignore_index=True)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    out, before = [], None
    for i in range(len(pdf)):
        key = None
        first = pdf["first"][i]
        if first is not None:
            if before is not None:
                key = int((np.hypot(first[1] - before[1], first[2] - before[2]) / np.maximum(first[0] - before[0], 1)).view(np.int64))
            before = pdf["last"][i]
        lo, hi = low, high
        taken = [i]
        for way, column in ((-1, "tails"), (1, "heads")):
            left, j = MARGIN, i + way
            while 0 <= j < len(pdf) and left > 0:
                taken.append(j)
                frames = pdf[column][j]
                if len(frames) >= left:
                    lo, hi = (frames[-left], hi) if way < 0 else (lo, frames[left - 1])
                left -= len(frames)
                j += way
        out += [(pdf["stream_id"][i], pdf["track_id"][i], pdf["at"][j], pdf["at"][i], lo, hi, key if j == i else None) for j in taken]
    return pd.DataFrame(out, columns=["stream_id", "track_id", "at", "block", "lo", "hi", "key"]).astype({"key": "Int64"})


def _ranked(values: DataFrame, scratch: Scratch) -> DataFrame:
    """``stream_id, track_id`` and the middle keys of both kinds, exactly: 16 bits a round are counted, so a hot track is never in one task. There are four rows per hot track to broadcast."""
    by = ["stream_id", "track_id", "kind"]
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.expr("(n - 1) div 2").alias("rank")), F.struct(F.lit("hi").alias("end"), F.expr("n div 2").alias("rank"))))
    picked = scratch.cut(values.groupBy(*by).agg(F.count("*").alias("n")).select(*by, ends.alias("e")).select(*by, "e.end", "e.rank", F.lit(0).cast("long").alias("prefix")))
    for shift in (48, 32, 16, 0):
        held = values.join(F.broadcast(picked), by)
        if shift < 48:
            held = held.filter(F.shiftright("key", shift + 16) == F.col("prefix"))
        counts = held.groupBy(*by, "end", "rank", "prefix", F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("up", F.sum("n").over(Window.partitionBy(*by, "end").orderBy("digit")))
        picked = scratch.cut(counts.filter("up > rank AND up - n <= rank").select(*by, "end", (F.col("rank") - F.col("up") + F.col("n")).alias("rank"), (F.col("prefix") * 65536 + F.col("digit")).alias("prefix")))
    return picked.groupBy("stream_id", "track_id").agg(*[F.max(F.when((F.col("kind") == k) & (F.col("end") == e), F.col("prefix"))).alias(f"{name}_{e}") for k, name in ((0, "velocity"), (1, "step")) for e in ("lo", "hi")])


def _tracks(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]] = _judged) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    count, tail = 0, None

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(c))[row].as_py() for c in ("stream_id", "track_id", "block"))

    for batch in batches:
        if not batch.num_rows:
            continue
        same = tail == key(batch, 0) == key(batch, batch.num_rows - 1)  # goes on with one track: nothing to give out, nothing to copy
        tail = key(batch, batch.num_rows - 1)
        held.append(batch)
        count += batch.num_rows
        if count < BATCH_ROWS or same:
            continue
        table = pa.Table.from_batches(held)
        last = {c: table.column(c)[-1].as_py() for c in ("stream_id", "track_id", "block")}
        tid, block = table.column("track_id").to_numpy(), table.column("block").to_numpy()
        other = np.flatnonzero((tid != last["track_id"]) | (block != last["block"]) | (np.asarray(table.column("stream_id").to_pandas() != last["stream_id"])))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from work(table.slice(0, cut))
        rest = table.slice(cut).combine_chunks()
        held, count = rest.to_batches(), rest.num_rows
    if count:
        yield from work(pa.Table.from_batches(held))


def spikes(tracks: DataFrame, frames: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS, block_frames: int = BLOCK_FRAMES) -> DataFrame:
    """``stream_id, track_id, frame_index`` and why: physical, off_line, fast, stuck.

    physical: center or velocity not finite, or center outside the picture by more than 5 % of its side.
    off_line: more than five usual steps off the line between the nearest right readings. fast: velocity
    over five times the usual. stuck: a coordinate repeats exactly in six or more readings of a moving ball.
    Usual is the track's median, at least 0.6 px a frame (velocity 0.3).

    Rows without track, stream or frame are left out; without a center they are no readings; a null
    velocity is judged by center alone. An array of another length than two counts as not finite.
    Deliveries of one frame count once (least row_id). A stream without frames has no picture limit.
    A first or last reading has no line; a second or last but one is judged only between close neighbours. An empty table gives no rows; other columns don't matter.
    """
    sizes = scratch.cut(frames.groupBy("stream_id").agg(F.max("width").cast("double").alias("width"), F.max("height").cast("double").alias("height")))
    rows = tracks.filter("track_id IS NOT NULL AND stream_id IS NOT NULL AND frame_index IS NOT NULL AND center IS NOT NULL")
    keys = ["stream_id", "track_id"]
    hot = scratch.cut(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select(*keys, F.lit(True).alias("hot")))
    rows = rows.select(*keys, "frame_index", "row_id", "center", "velocity")
    if hot.isEmpty():
        rows = rows.withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True)})
    else:
        rows = rows.join(F.broadcast(hot), keys, "left")
        cut = rows.filter("hot").drop("hot").withColumn("block", F.floor(F.col("frame_index") / block_frames))
        laid = cut.join(sizes, "stream_id", "left").repartition(*keys, "block").sortWithinPartitions(*keys, "block", "frame_index", "row_id")
        measures = scratch.cut(laid.drop("row_id").mapInArrow(_measures, MEASURES))
        edges = scratch.cut(measures.filter("kind = 2").groupBy(*keys).applyInPandas(_edges, EDGES))
        values = measures.filter("kind < 2").select(*keys, "kind", "key").unionByName(edges.filter("key IS NOT NULL").select(*keys, F.lit(1).alias("kind"), "key"))
        usual = scratch.cut(_ranked(values, scratch))
        spread = cut.withColumnRenamed("block", "at").join(edges.drop("key"), [*keys, "at"]).filter("frame_index BETWEEN lo AND hi OR block = at").withColumn("own", F.col("block") == F.col("at")).drop("at", "lo", "hi")
        rows = rows.filter("hot IS NULL").drop("hot").withColumns({"block": F.lit(0).cast("long"), "own": F.lit(True)}).unionByName(spread).join(F.broadcast(usual), keys, "left")
    placed = rows.join(sizes, "stream_id", "left").repartition(*keys, "block").sortWithinPartitions(*keys, "block", "frame_index", "row_id")
    return placed.drop("row_id").mapInArrow(_tracks, OUTPUT)
