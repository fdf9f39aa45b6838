"""Problems 2 to 4 on small tables: spellings, nulls, ties, hot values, empty tables, extra columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackloom.llm import components, overlap, splits, survivors
from trackloom.session import Scratch

SCHEMA = (
    "record_id long, source string, original_split string, image string, source_key string, clip_key string, boxes array<struct<x:double,y:double,w:double,h:double>>, ignored_objects int, file_size long, "
    "image_hash string, assigned_split string, scanned_at timestamp_ntz, group_id string, side int, n long"
)
B = [(0.5, 0.5, 0.1, 0.1)]


def row(i, key=None, clip=None, h=None, split=None, source="a", boxes=B, ignored=0, size=10):
    return (i, source, split, f"img{i}", key, clip, boxes, ignored, size, h, split, None, "x", 1, 2)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", "hot", *[f"k{j}" for j in range(60)]]) if rng.random() < 0.9 else "hot", rng.choice([None, *[f"h{j}" for j in range(150)]])) for i in range(300)]
    got = {r.id: r.group_id for r in components.linked_groups(spark.createDataFrame(rows, "id long, k string, h string"), "id", ["k", "h"], Scratch(spark)).collect()}
    by = defaultdict(list)
    for i, k, h in rows:
        if k:
            by["k", k].append(i)
        if h:
            by["h", h].append(i)
    assert got == brute([(v[0], x) for v in by.values() for x in v[1:]], [r[0] for r in rows])


def test_long_chain(spark):
    rows = [(i, f"k{i // 2}", f"h{(i + 1) // 2}") for i in range(200)]
    got = components.linked_groups(spark.createDataFrame(rows, "id long, k string, h string"), "id", ["k", "h"], Scratch(spark)).collect()
    assert {r.group_id for r in got} == {0} and len(got) == 200


def test_straddling_clips(spark):
    rows = [
        row(1, clip="a:Clip_x_mp4", split="train"), row(2, clip="b:reexp_clip%20x%20MP4", split="VALIDATION"), row(3, clip="a:clip_x_mp4", split=None), row(4, clip=None, split="train"), row(5, clip="a:y", split="train"),
        row(6, clip="a:y", split=" TRAIN "), row(7, clip="a:z", split="test"), row(7, clip="a:z", split="test"),
    ]
    assert sorted(r.record_id for r in splits.straddling(table(spark, rows), Scratch(spark)).collect()) == [1, 2]
    assert splits.straddling(table(spark, []), Scratch(spark)).count() == 0


def test_splits_keep_clips_and_ratios(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for c in range(300):
        for _ in range(rng.choice([1, 2, 5, 20])):
            i += 1
            rows.append(row(i, key=f"a:clip{c}_{i:05d}_jpg", clip=rng.choice([f"a:clip{c}", f"b:Clip{c} "]) if rng.random() < 0.9 else None, source="ab"[c % 2]))
    rows.append(row(i + 1))
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, ratio double")
    got = splits.assign_splits(table(spark, rows), targets, Scratch(spark)).collect()
    assert len(got) == len(rows)
    at = {r.record_id: r.new_split for r in got}
    clips = defaultdict(set)
    for r in rows[:-1]:
        clips[r[4].split("_")[0]].add(at[r[0]])
    assert all(len(s) == 1 for s in clips.values())
    for source in ("a", "b", None):
        own = Counter(at[r[0]] for r in rows if source in (None, r[1]))
        total = sum(own.values())
        assert abs(own["train"] / total - 0.8) < 0.03 and abs(own["valid"] / total - 0.1) < 0.03 and abs(own["test"] / total - 0.1) < 0.03
    hot = [row(k, clip="a:hot" if k < 40 else f"a:c{k}") for k in range(100)]
    shares = Counter(r.new_split for r in splits.assign_splits(table(spark, hot), targets, Scratch(spark)).collect())
    assert shares["train"] == 80
    assert splits.assign_splits(table(spark, []), targets, Scratch(spark)).count() == 0


def test_chunks_depend_on_their_value_alone():
    rng = np.random.default_rng(3)
    values = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(0, 90, 200)]
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum([len(v) for v in values])
    starts = ends - [len(v) for v in values]
    cuts = overlap.cut_points(data, starts, ends)
    for v, a, b in zip(values, starts, ends):
        own = np.frombuffer(v, np.uint8)
        assert list(overlap.cut_points(own, np.array([0]), np.array([len(v)]))) == [c - a for c in cuts if a <= c < b]
    # A change at the front leaves the far chunks alone.
    long = bytes(rng.integers(97, 123, 600).astype(np.uint8))
    a, b = (overlap.cut_points(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in (long, b"zz" + long))
    assert len(a) > 10 and len(set(a + 2) & set(b)) > len(a) - 4


def test_pairs_across_splits(spark):
    rows = [
        row(1, "a:x_00001_jpg", h="aa:5", split="train"), row(2, "b:X%2000001.png", h="bb:6", split="test"), row(3, "a:y_00009_jpg", h="0xBB:6", split=None), row(4, "a:y_00009_png", h=None, split="valid"),
        row(5, "a:z_1_jpg", h="aa:6", split="train"), row(6, None, h=None, split="test"), row(7, None, h="n/a", split="train"), row(8, "a:x_00002_jpg", h="00000000:0", split="test"), row(9, "a:w_1_jpg", h="00000000:0", split="train"),
    ]
    got = sorted(tuple(r) for r in overlap.cross_split_pairs(table(spark, rows), Scratch(spark)).collect())
    assert got == [(1, 2), (1, 4)]
    shares = {r.record_id: r.overlap for r in overlap.overlaps(table(spark, rows)).collect()}
    assert shares[1] > shares[5] and shares[3] == 0
    empty = table(spark, [])
    assert overlap.cross_split_pairs(empty, Scratch(spark)).count() == 0 and overlap.overlap_report(empty, Scratch(spark)).count() == 0 and overlap.overlap_members(empty, Scratch(spark)).count() == 0
    assert {r.record_id: (r.group_id, r.links, r.near) for r in overlap.overlap_members(table(spark, rows), Scratch(spark)).collect()} == {
        1: (1, 2, False), 2: (1, 1, False), 4: (1, 1, False), **{i: (i, 0, True) for i in (6, 7, 9)},  # 6, 7 and 9 name nothing: all there is of them are boxes
    }
    report = {(r["split"], r["source"]): r.overlapping for r in overlap.overlap_report(table(spark, rows), Scratch(spark)).collect()}
    assert report["train", "a"] == 1


def test_covers_are_equal_where_values_are(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.choice([3, 30, 300, 9000]))) for _ in range(40)]
    rows = [row(i, key=f"a:{rng.choice(words)}_{rng.choice('12')}_jpg" if rng.random() < 0.9 else None, h=None) for i in range(300)]
    got = {r.record_id: r.group_id for r in overlap.image_groups(table(spark, rows), Scratch(spark)).collect()}
    by = defaultdict(list)
    for r in rows:
        if r[4]:
            by[r[4]].append(r[0])
    assert got == brute([(v[0], x) for v in by.values() for x in v[1:]], [r[0] for r in rows])


def test_near_copies_are_found_by_chunks_alone(spark):
    rng = random.Random(4)
    long = "_".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(40))
    many = [(round(rng.random(), 4), round(rng.random(), 4), 0.1, 0.1) for _ in range(30)]
    near = [(0.3, 0.3, 0.1, 0.1), *many[1:]]
    rows = [row(1, f"a:{long}_00001_jpg", h="aa:5", split="train", boxes=many), row(2, f"b:{long}_00002_jpg", h="ab:6", split="test", boxes=near), row(3, "a:other_1_jpg", h="ac:7", split="valid"), row(4, f"b:{long}_00003_jpg", h="ad:6", split=None, boxes=near)]
    got = {r.record_id: r for r in overlap.overlap_members(table(spark, rows), Scratch(spark)).collect()}
    assert set(got) == {1, 2} and all(r.near and r.links == 0 and r.overlap >= 0.8 for r in got.values())
    assert overlap.cross_split_pairs(table(spark, rows), Scratch(spark)).count() == 0


@pytest.mark.parametrize("edges", [[(0, 2), (2, 4)], [(1, 3), (3, 5), (5, 7), (7, 1), (2, 2), (None, 4)], [(i, i + 2) for i in range(0, 300, 2)], [(0, i) for i in range(1, 200)]])
def test_any_graph_contracts(spark, edges):
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = brute(real, {v for e in real for v in e})
    assert set(got) == set(want) and len(set(zip(got.values(), (want[v] for v in got)))) == len(set(want.values())) == len(set(got.values()))


def test_more_targets_than_can_be_are_refused(spark):
    targets = spark.createDataFrame([(f"s{i}", 0.1) for i in range(1001)], "split_name string, ratio double")
    with pytest.raises(ValueError):
        splits.assign_splits(table(spark, [row(1)]), targets, Scratch(spark))


def test_slots_change_nothing(spark):
    rows = [row(i, key=f"a:c{i % 97}_{i:05d}_jpg", clip=f"a:c{i % 97}" if i % 5 else None, source="ab"[i % 2]) for i in range(600)]
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split_name string, ratio double")
    few, many = ({r.record_id: (r.group_id, r.new_split) for r in splits.assign_splits(table(spark, rows), targets, Scratch(spark), slot_groups=n).collect()} for n in (10**6, 3))
    assert few == many and len(few) == 600


def test_weights_that_do_not_settle_are_no_result(spark):
    sources = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "short_name string, priority int, n int")
    df = spark.createDataFrame([(1, "clip", "x", "a", 1, None), (1, "clip", "y", "b", 2, None)], "group_id long, field string, value string, source string, n long, latest timestamp_ntz")
    with pytest.raises(RuntimeError):
        survivors.source_weights(df, sources, Scratch(spark), rounds=1)


def test_survivors(spark):
    sources = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("c", 2, 1)], "short_name string, priority int, n int")
    rows, i = [], 0
    for g in range(60):  # source c is wrong about sizes, a and b agree
        for s in "abc":
            i += 1
            rows.append(row(i, f"{s}:f{g}_00001_jpg", source=s, size=100 + g if s != "c" else 7, boxes=None if s == "b" else B if s == "a" else []))
    rows += [row(i + 1, "c:solo_1_jpg", source="c", size=7), row(i + 2, "a:two_1_jpg", source="a", size=5), row(i + 3, "c:two_1_png", source="c", size=9), row(i + 4, source=None, boxes=None, size=None)]
    out = {r.group_id: r for r in survivors.survivors(table(spark, rows), sources, Scratch(spark)).collect()}
    assert len(out) == 63 and all(out[1 + 3 * g].file_size == 100 + g and len(out[1 + 3 * g].boxes) == 1 and out[1 + 3 * g].copies == 3 for g in range(60))
    assert out[i + 1].file_size == 7 and out[i + 2].file_size == 5 and out[i + 4].boxes is None
    members = survivors.duplicate_members(table(spark, rows), Scratch(spark)).collect()
    assert len(members) == 182 and (i + 1) not in {m.record_id for m in members}
    assert survivors.survivors(table(spark, []), sources, Scratch(spark)).count() == 0 and survivors.duplicate_members(table(spark, []), Scratch(spark)).count() == 0


def test_report_counts_the_records_and_pairs_across_splits(spark):
    rows = [
        row(1, "a:x_00001_jpg", h="aa:5", split="train"), row(2, "b:X%2000001.png", h="bb:6", split=None), row(3, "a:y_00009_jpg", h="0xBB:6", split=" Valid", source="b"), row(4, "a:y_00009_png", h=None, split="test", source=None),
        row(5, "a:z_1_jpg", h="cc:6", split="train"), row(6, "a:z_1_png", h=None, split="train"), row(7, None, h="dd:7", split="test"),
    ]
    df = table(spark, rows)
    pairs = [tuple(r) for r in overlap.cross_split_pairs(df, Scratch(spark)).collect()]
    assert sorted(pairs) == [(1, 3), (1, 4)]
    want = {("train", "a"): (3, 1, 2), ("none", "a"): (1, 0, 0), ("valid", "b"): (1, 1, 1), ("test", "none"): (1, 1, 1), ("test", "a"): (1, 0, 0)}
    got = {(r["split"], r["source"]): (r.records, r.overlapping, r.pairs) for r in overlap.overlap_report(df, Scratch(spark)).collect()}
    assert got == want and sum(x[1] for x in got.values()) == len({i for p in pairs for i in p})


def test_all_votes_count(spark):
    sources = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "short_name string, priority int, n int")
    rows = [row(i, "a:hot_00001_jpg", source="b" if i < 20 else "a", size=5 if i < 20 else 6) for i in range(30)]
    assert [r.file_size for r in survivors.survivors(table(spark, rows), sources, Scratch(spark)).collect()] == [5]
    claims = [
        (1, "file_size", "5", "a", 1, None), (1, "file_size", "6", "b", 1, None), (2, "file_size", "7", "b", 100, None),  # b's undisputed claims count for it
        (1, "boxes", "[]", "a", 5, None), (1, "boxes", "[{}]", "b", 1, None),
        (1, "clip", "x", "b", 1, None), (1, "clip", "y", "a", 1, None),  # a tie goes to the trusted source
    ]
    df = spark.createDataFrame(claims, "group_id long, field string, value string, source string, n long, latest timestamp_ntz")
    weights = {(r.field, r.source): r.weight for r in survivors.source_weights(df, sources, Scratch(spark)).collect()}
    want = {("file_size", "a"): np.log(2 / 3) / np.log(1 / 103), ("boxes", "a"): np.log(6 / 7) / np.log(1 / 3), ("clip", "b"): np.log(2 / 3) / np.log(1 / 3)}
    assert len(weights) == 6 and all(weights[k] == pytest.approx(want.get(k, 1.0)) for k in weights)
