import math
import random

from trackloom.operators.spikes import spikes
from trackloom.session import Scratch

TRACKS = "row_id long, stream_id string, track_id long, frame_index long, center array<double>, velocity array<double>, block int"
FRAMES = "stream_id string, frame_index long, width int, height int"


def found(spark, centers, velocities=None, **kw):
    rows = [(i, "s", 1, i, c, (velocities or {}).get(i, [6.0, 2.0]), 7) for i, c in enumerate(centers)]
    df = spark.createDataFrame(rows + rows[:5], TRACKS)
    frames = spark.createDataFrame([("s", 0, 1280, 720)], FRAMES)
    return {r.frame_index: {k for k in ("physical", "off_line", "fast", "stuck") if r[k]} for r in spikes(df, frames, Scratch(spark), **kw).collect()}


def line(n=60):
    return [[100.0 + 6 * i + (i % 3) * 0.1, 100.0 + 2 * i] for i in range(n)]


def test_spikes_turns_and_limits(spark):
    c = line()
    c[20], c[40], c[41] = [c[20][0], 400.0], [c[40][0] + 90, 300.0], [c[41][0] + 90, 300.0]
    c[30] = [math.nan, 5.0]
    c[50] = [5000.0, 100.0]
    got = found(spark, c, {10: [200.0, 0.0], 11: [math.inf, 0.0], 12: None})
    assert got == {20: {"off_line"}, 40: {"off_line"}, 41: {"off_line"}, 30: {"physical"}, 50: {"physical"}, 10: {"fast"}, 11: {"physical"}}


def test_second_and_last_but_one_reading(spark):
    c = line()
    c[1], c[58] = [c[1][0], 400.0], [c[58][0] + 90, 500.0]
    assert found(spark, c) == {1: {"off_line"}, 58: {"off_line"}}
    c = line()
    c[0], c[59] = [c[0][0], 400.0], [c[59][0], 700.0]  # the ends have no line, and their neighbours are right
    assert found(spark, c) == {}


def test_turn_rest_and_jump_are_no_cases(spark):
    turn = line(30) + [[100.0 + 6 * 29 - 6 * i, 158.0 + 2 * i] for i in range(1, 30)]
    rest = [[300.0 + (i * 7 % 5) * 0.1, 300.0 + (i * 3 % 4) * 0.1] for i in range(40)]
    assert found(spark, turn) == {} and found(spark, rest, {i: [0.05, 0.0] for i in range(40)}) == {}
    jump = [*line(30), *[[700.0 + 6 * i, 500.0 + 2 * i] for i in range(30)]]
    assert found(spark, jump) == {}


def test_stuck(spark):
    c = line()
    for i in range(20, 28):
        c[i] = list(c[19])
    got = found(spark, c)
    assert set(got) == set(range(20, 28)) and all("stuck" in v for v in got.values())
    c = line()
    for i in range(20, 24):
        c[i] = [c[19][0], c[i][1]]
    assert not any("stuck" in v for v in found(spark, c).values())


def test_hot_tracks_are_cut_into_blocks(spark):
    c = line(400)
    for i in (5, 99, 100, 101, 250, 333):
        c[i] = [c[i][0], 9.0]
    c = [[x % 1200, y % 700] for x, y in c]
    assert set(found(spark, c, hot_rows=100, block_frames=120)) >= {5, 250, 333}


def test_empty_and_null(spark):
    frames = spark.createDataFrame([], FRAMES)
    assert spikes(spark.createDataFrame([], TRACKS), frames, Scratch(spark)).count() == 0
    rows = [(1, None, 1, 1, [1.0, 1.0], None, 0), (2, "s", None, 1, [1.0, 1.0], None, 0), (3, "s", 1, 1, None, None, 0), (4, "s", 1, 2, [1.0], None, 0), (5, "s", 2, 1, [-9.0, 1.0], [1.0, 1.0], 0)]
    got = spikes(spark.createDataFrame(rows, TRACKS), frames, Scratch(spark)).collect()
    assert [(r.track_id, r.frame_index) for r in got] == [(1, 2)]


def test_blocks_only_spread_the_work(spark):
    rng = random.Random(4)
    c, x, y = [], 100.0, 100.0
    for i in range(2400):  # slow, then fast, then slow
        pace = 8.0 if 900 <= i < 1500 else 1.0
        x, y = x + pace * (1 if i // 60 % 2 else -1), y + rng.uniform(0.1, 0.4) * (1 if i // 80 % 2 else -1)
        c.append([x + rng.uniform(-0.2, 0.2), y])
    for i in range(25, 2400, 97):
        c[i] = [c[i][0], c[i][1] + rng.choice([4.0, 12.0, 30.0, 60.0])]
    for i in [*range(395, 410), *range(1195, 1203)]:
        c[i] = list(c[i - 1])
    for i in range(790, 1000):
        c[i] = None
    velocities = {i: [rng.uniform(20, 50) if i % 31 == 0 else 8.0 if 900 <= i < 1500 else 1.0, 0.0] for i in range(2400)}
    whole = found(spark, c, velocities)
    assert {"off_line", "fast", "stuck"} <= set().union(*whole.values())
    assert found(spark, c, velocities, hot_rows=100, block_frames=200) == whole
