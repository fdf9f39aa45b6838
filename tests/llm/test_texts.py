"""Problems 6 to 8 on small tables."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import forms, leaks, packing
from trackloom.session import Scratch

DOCS = "doc_id long, text string, n long, form string, item_id int"


def fold(texts):
    column = pa.array(texts, pa.string())
    points, ends = forms.folded(*forms.code_points(column))
    return forms.text_array(points, ends, column.is_valid().to_numpy(zero_copy_only=False)).to_pylist()


ALPHABET = "aAеЕiі1lо0ȩ́́̈​  ﬁＡ，。⼈人K\n -‑ßйё﻿Ｚ한가각\u1112\u1161\u11ab\u1100\u1175"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), max_size=8))
def test_forms_equal_a_fold_by_character(texts):
    want = [unicodedata.normalize("NFC", "".join(forms._one(c) for c in t)) for t in texts]
    assert fold(texts) == want and fold(want) == want


def test_what_looks_the_same_and_what_does_not():
    same = [("café", "café"), ("paddle", "pаddlе"), ("a b", "a b"), ("ab", "a​b"), ("１２", "12"), ("ﬁn", "fin"), ("⼈", "人"), ("no-go", "no‑go"), ("ё", "ё"), ("x\ny", "x\r\ny"), ("한국어", unicodedata.normalize("NFD", "한국어")), ("Set V", "Ꮪet Ⅴ"), ("HAND", "Ⲏꓮꓠꓓ"), ("5 µm", "5 μm")]
    for a, b in same:
        x, y = fold([a, b])
        assert x == y, (a, b)
    for a, b in [("a", "A"), ("cafe", "café"), ("1", "2"), ("l", "1"), ("O", "0"), ("a b", "ab"), ("x² ", "x2 "), ("З", "3"), ("한", "하"), ("Ⅷ", "VIII"), ("𝐀", "A")]:
        x, y = fold([a, b])
        assert x != y, (a, b)
    assert fold([None, "", "​"]) == [None, "", ""]


def test_same_looking_pairs(spark):
    rows = [(1, "café x"), (2, "café x"), (3, "café x"), (4, "café x"), (5, "Café x"), (6, None), (7, ""), (8, "​"), (9, "‌"), (2, "café x")]
    df = spark.createDataFrame([(*r, 1, "f", 1) for r in rows], DOCS)
    assert sorted(tuple(r) for r in forms.same_looking(df, Scratch(spark)).collect()) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert forms.forms(df).count() == 10 and forms.same_looking(df.limit(0), Scratch(spark)).count() == 0
    assert sorted(tuple(r) for r in forms.same_looking_classes(df, Scratch(spark)).collect()) == [(1, 1, 3), (2, 1, 3), (2, 1, 3), (3, 1, 4), (4, 1, 3)] and forms.same_looking_classes(df.limit(0), Scratch(spark)).count() == 0


WORDS = ["gate", "net", "ball", "racket", "court", "umpire", "camera", "frame", "lens", "track", "shadow", "label", "box", "line", "serve", "drive", "clip", "paddle", "corner", "light"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(7)
    opening = "Read the following court log and answer with one track number only. "
    zh = "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(160))
    items = [(i, (opening if i < 6 else "") + sentence(rng, 90)) for i in range(8)] + [(8, zh), (9, None), (10, "")]
    words = items[3][1].split()
    changed = " ".join(w if i % 12 else "other" for i, w in enumerate(words))
    dropped = " ".join(w for i, w in enumerate(items[7][1].split()) if i % 11)
    noise = lambda n: sentence(rng, n)
    docs = [
        (1, noise(50) + " " + items[0][1] + " " + noise(50)), (2, noise(30) + "\n* ".join(changed.upper().split(" "))), (3, dropped), (4, noise(40) + " " + " ".join(items[6][1].split()[20:60]) + " " + noise(40)),
        (5, opening + noise(80)), (6, noise(20) + " " + " ".join(items[6][1].split()[:9]) + " " + noise(60)), (7, "前言。" + "，".join(zh[i : i + 7] for i in range(20, 100, 7))), (8, noise(20) + zh[10:30]), (9, None), (10, ""), (11, "a"),
        (12, "".join(c + "​" for c in items[1][1].replace("a", "а"))), (13, noise(3000) + items[2][1] + noise(3000)),
    ]
    df = spark.createDataFrame([(*d, 1, "f", 1) for d in docs], DOCS)
    ev = spark.createDataFrame([(i, "s", "en", t, 1) for i, t in items], "item_id long, suite string, lang string, item_text string, doc_id int")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(df, ev).collect())
    assert got == [(1, 0), (2, 3), (3, 7), (4, 6), (7, 8), (12, 1), (13, 2)]
    assert leaks.leaks(df.limit(0), ev).count() == 0 and leaks.leaks(df, ev.limit(0)).count() == 0


def test_recall_against_edits():
    """Items with one word in twelve changed, inside other text: found by nearly all; with every other word changed an item is contained no more."""
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.choice([40, 80, 150]))) for i in range(30)]
    index = leaks.build_index(items, [0] * len(items))

    def found(every):
        docs = [sentence(rng, 40) + " " + " ".join(w if rng.random() > 1 / every else sentence(rng, 1) for w in t.split()) + " " + sentence(rng, 40) for _, t in items]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], names=["doc_id", "text"])
        return {(d, i) for r in leaks._leaks(iter([batch]), [index]) for d, i in zip(r.column(0).to_pylist(), r.column(1).to_pylist())}

    got = found(12)
    assert len(got & {(i, i) for i in range(30)}) >= 28 and not got - {(i, i) for i in range(30)}
    assert len(found(2)) <= 2


def test_blocks_of_items_change_nothing(spark):
    """Openings are found over all items, and openings and rows are the same in one block and in many."""
    rng = random.Random(21)
    opening = "Read the following court log and answer with one track number only. "
    items = [(i, opening + sentence(rng, 60)) for i in range(8)] + [(i, sentence(rng, 60)) for i in range(8, 12)] + [(3, sentence(rng, 60))]
    docs = [(i, sentence(rng, 30) + " " + t) for i, t in items[::2]] + [(90, opening + sentence(rng, 50)), (91, opening * 9)]
    df = spark.createDataFrame([(*d, 1, "f", 1) for d in docs], DOCS)
    ev = spark.createDataFrame([(i, "s", "en", t, 1) for i, t in items], "item_id long, suite string, lang string, item_text string, doc_id int")
    opened = {(r.item_id, r.item_text): r.opening for r in leaks.shared_openings(ev).collect()}
    assert [opened[i] for i in items] == [len(opening.replace(" ", "")) - 1] * 8 + [0] * 5
    whole, cut = (sorted((r.doc_id, r.item_id, r.share) for r in leaks.leaks(df, ev, n).collect()) for n in (10**6, 500))
    assert whole == cut and [x[:2] for x in whole] == sorted((i, i) for i, _ in items[::2])


def test_least_squares_are_those_of_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        table = np.sort(rng.integers(0, 5, (6, 3)), axis=1)[:, ::-1]
        table = table[table[:, 0] > 0]
        a = np.array([[np.sum(row == e) for row in table] for e in range(1, 5)], float)
        b = np.concatenate([[0], rng.integers(1, 20, 4)]).astype(float)
        held, x = packing.nnls(table, b)
        best = np.inf
        for mask in range(1 << len(table)):
            cols = [j for j in range(len(table)) if mask >> j & 1]
            z = np.linalg.lstsq(a[:, cols], b[1:], rcond=None)[0] if cols else np.zeros(0)
            if (z >= -1e-9).all():
                best = min(best, ((a[:, cols] @ z - b[1:]) ** 2).sum())
        assert (x >= 0).all() and ((a[:, held] @ x - b[1:]) ** 2).sum() <= best + 1e-2


def test_patterns_are_all_that_fill_a_unit():
    got = {tuple(r) for r in packing.patterns(9, True, 1)}
    want = set()
    for a in range(1, 10):
        for b in range(10):
            for c in range(b + 1):
                if a + b + c in (8, 9):
                    if a >= b:
                        want.add((a, b, c))
                    if a < 9:
                        want.add((9 + a, b, c))
    assert got == want and len(packing.patterns(9, True, 1)) == len(want)


def best_fit(sizes, capacity):
    free, n = [], 0
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in free if r >= s]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - s)
        else:
            n += 1
            free.append(capacity - s)
    return n


@pytest.mark.parametrize("capacity", [10, 256, 1000, 4096])
def test_packing_fits_and_is_tight(capacity):
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(np.log(min(capacity / 3, 160)), 0.9, 4000), 1, capacity).astype(int)
    where, fitted = packing.pack(sizes, capacity)
    filled = np.bincount(where, sizes)
    assert (where >= 0).all() and filled.max() <= capacity and filled.min() > 0
    assert len(filled) <= 1.01 * best_fit(sizes, capacity) + 1 and fitted.mean() > 0.85
    for few in ([], [capacity], [1], [capacity] * 3, [capacity // 2 + 1] * 5):
        w, _ = packing.pack(np.array(few, np.int64), capacity)
        assert len(w) == len(few) and (not few or np.bincount(w, few).max() <= capacity)


def test_containers(spark):
    rng = random.Random(3)
    docs = [(i, sentence(rng, rng.choice([1, 5, 30, 200]))) for i in range(120)] + [(500, None), (501, ""), (502, sentence(rng, 3000))]
    df = spark.createDataFrame([(*d, 1, "f", 1) for d in docs], DOCS)
    profiles = spark.createDataFrame([("short", 256), ("long", 1024), (None, 5), ("bad", 0)], "profile string, capacity_tokens int")
    packed = packing.containers(df, profiles, Scratch(spark), shard_items=40)
    counts = {r.doc_id: r.n for r in packing.token_counts(df).collect()}
    for profile, capacity in (("short", 256), ("long", 1024)):
        rows = packed.filter(f"profile = '{profile}'").collect()
        room, texts = {}, {}
        for r in rows:
            room[r.container] = room.get(r.container, 0) + r.tokens
            texts.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        assert max(room.values()) <= capacity and set(texts) == {d for d, n in counts.items() if n}
        for d, parts in texts.items():
            parts.sort()
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) == counts[d]
            assert len(parts) == 1 or counts[d] > capacity
    assert packing.containers(df.limit(0), profiles, Scratch(spark)).count() == 0 and packing.containers(df, profiles.limit(0), Scratch(spark)).count() == 0
    assert {r.profile for r in packing.packing_report(packed, profiles).collect()} == {"short", "long"}


def test_a_replaced_part_does_not_hide_the_verbatim_ends(spark):
    rng = random.Random(11)
    zh = lambda n: "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(n))
    words, chars = sentence(rng, 90).split(), zh(160)
    docs = [
        (1, " ".join(words[:36] + sentence(rng, 18).split() + words[54:])), (2, chars[:70] + zh(20) + chars[90:]), (3, sentence(rng, 40) + " " + " ".join(words[:33] + sentence(rng, 24).split() + words[57:])),
        (4, " ".join(words[:20] + sentence(rng, 20).split() + words[40:60] + sentence(rng, 20).split() + words[80:])), (5, chars[:40] + zh(30) + chars[70:110] + zh(30) + chars[140:]),
    ]
    df = spark.createDataFrame([(*d, 1, "f", 1) for d in docs], DOCS)
    ev = spark.createDataFrame([(0, "s", "en", " ".join(words), 1), (1, "s", "zh", chars, 1)], "item_id long, suite string, lang string, item_text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.share for r in leaks.leaks(df, ev).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 0)} and all(0.3 <= x < 0.6 for x in got.values())
