"""Problem 7: evaluation texts inside training text, by q-gram lemma filtering and banded alignment.

The evaluation items are the stated query set. Openings that items share are found over all of them; then the
items are dealt to blocks of bounded size, each indexed in a task. Several blocks go to all tasks together, and
the corpus is read once for them; it is never shuffled. In a task a slice of documents is one array of letters
(one form, no case, accents, space or punctuation). Its q-grams are looked up at once; hits of one item are
counted in overlapping diagonal bands, bands that meet the lemma's bound for the edit budget are kept, and what
is left is verified by local alignment inside the band, many bands in step; a loose alignment is cut and its
pieces are aligned on their own. Bound and share are of the same thing: the item behind its opening.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .forms import code_points, folded, slices, tables

SHARE = 0.3  # of an item's words (characters in Chinese)
Q_LETTERS, Q_IDEOGRAPHS = 14, 6
LOST = 0.5  # edit budget: the part of a stretch's q-grams that changed words may destroy
DENSITY = 0.7  # least score per letter of a verified stretch: a changed word in eight leaves as much, common phrases strung together do not
BAND = 64
HALF = 56  # of the verified band, around its middle
OPENING_ITEMS, OPENING_LETTERS = 4, 20
BLOCK_LETTERS, BLOCKS_A_PASS = 1_000_000, 4  # of items: one index, and those that the corpus is read once for
TOP = 20  # bits of a hash that the index is laid out by
TOGETHER = 96
PATH_CELLS = 16_000_000  # of the alignments traced back at once, or a single one


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point its letter without case and accent (0: no letter), and whether it is an ideograph."""
    size = 0x110000
    fold = np.zeros(size, np.uint32)
    # Look-alikes of the other case: the pairs of capital look-alikes, lowered.
    lower = {"в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "ζ": "z", "β": "b", "η": "h", "ι": "i", "κ": "k", "μ": "m", "ρ": "p", "τ": "t", "υ": "y", "χ": "x"}
    for cp in range(0x30, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            low = unicodedata.normalize("NFD", ch.lower())[0]
            fold[cp] = ord(lower.get(low, low))
    ideograph = np.zeros(size, bool)
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000)):
        ideograph[a:b] = True
    return fold, ideograph


def letters(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all rows end to end, where each row ends, and each letter's word number (an ideograph is a word)."""
    fold, ideograph = _letters()
    mapped = fold[points]
    keep = mapped > 0
    head = np.zeros(len(points) + 1, bool)
    head[np.concatenate([[0], ends])] = True
    begin = keep.copy()
    begin[1:] &= ~keep[:-1] | ideograph[points[1:]] | ideograph[points[:-1]] | head[1:-1]
    words = np.cumsum(begin) - 1
    return mapped[keep], np.concatenate([[0], np.cumsum(keep)])[ends], words[keep]


def grams(text: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q letters from each place on (the last q - 1 places have none)."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = text.astype(np.uint64)
    for j in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += wide[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shared_openings(items: DataFrame) -> DataFrame:
    """``item_id, item_text, opening``: distinct items with the letters of the longest opening that at least ``OPENING_ITEMS`` items share letter for letter; 0 where it is short, or most of the item.

    One row a letter of the items is counted, whatever blocks they are cut into later.
    """
    key = ["item_id", "item_text"]
    once = items.filter("item_text <> ''").select(*key).distinct().withColumn("key", F.xxhash64(*key))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "item_text"):
                text, stop, _ = letters(*folded(*code_points(part.column(part.schema.get_field_index("item_text")))))
                start = np.concatenate([[0], stop[:-1]])
                size = stop - start
                place = np.arange(len(text)) - np.repeat(start, size)
                with np.errstate(over="ignore"):
                    powers = np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
                    powers[:1] = 1
                    powers = np.multiply.accumulate(powers)
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
                    head = total[1:] - np.repeat(total[start], size)
                owner = np.repeat(np.arange(len(stop)), size)
                zh = np.repeat(_is_ideographic(text, start, stop), size)
                long = place + 1 >= np.where(zh, OPENING_LETTERS // 2, OPENING_LETTERS)
                keys = part.column(part.schema.get_field_index("key"))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[long])), pa.array(head[long].view(np.int64)), pa.array(place[long] + 1), pa.array(size[owner[long]])], names=["key", "head", "length", "size"])

    heads = once.mapInArrow(prefixes, "key long, head long, length long, size long")
    common = heads.groupBy("head", "length").agg(F.count("*").alias("n")).filter(F.col("n") >= OPENING_ITEMS).select("head", "length")
    best = heads.join(common, ["head", "length"]).groupBy("key").agg(F.max("length").alias("opening"), F.max("size").alias("size"))
    best = best.filter(F.col("opening") <= 0.7 * F.col("size")).select("key", "opening")
    return once.join(best, "key", "left").select(*key, F.coalesce("opening", F.lit(0)).cast("long").alias("opening"))


def _is_ideographic(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    cum = np.concatenate([[0], np.cumsum(_letters()[1][text])])
    return (stop > start) & (2 * (cum[stop] - cum[start]) > stop - start)


def build_index(items: list[tuple[int, str]], openings: list[int]) -> dict:
    """Arrays over the items: letters, word weights, openings, and the q-grams behind the openings sorted by hash."""
    text, stop, words = letters(*folded(*code_points(pa.array([t for _, t in items], pa.string()))))
    start = np.concatenate([[0], stop[:-1]])
    index = {"ids": np.array([i for i, _ in items], np.int64), "text": text, "start": start, "stop": stop, "opening": np.array(openings, np.int64)}
    _, inverse, per = np.unique(words, return_inverse=True, return_counts=True)
    index["weight"] = 1.0 / per[inverse] if len(words) else np.zeros(0)
    index["zh"] = _is_ideographic(text, start, stop)
    # Letters of the shortest stretch behind the opening that holds the share.
    least = np.zeros(len(items), np.int64)
    for i, (a, b) in enumerate(zip(start + index["opening"], stop)):
        cum = np.concatenate([[0], np.cumsum(index["weight"][a:b])])
        reach = np.searchsorted(cum, cum + SHARE * cum[-1] - 1e-6)
        ends = reach < len(cum)
        least[i] = (reach - np.arange(len(cum)))[ends].min() if b > a else 0
    index["least"] = least
    for q, zh in ((Q_LETTERS, False), (Q_IDEOGRAPHS, True)):
        hashes, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(index["zh"] == zh):
            first = index["opening"][i]
            g = grams(text[start[i] + first : stop[i]], q)
            hashes.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)) + first)
        h = np.concatenate(hashes)
        o = np.argsort(h, kind="stable")
        h = h[o]
        top = np.searchsorted(h, np.arange(1 << TOP, dtype=np.uint64) << np.uint64(64 - TOP)).astype(np.int32)
        index[q] = (h, np.concatenate(item)[o].astype(np.int32), np.concatenate(place)[o].astype(np.int32), np.append(top, np.int32(len(h))))
    index["need"] = {q: need(least, q) for q in (Q_LETTERS, Q_IDEOGRAPHS)}
    return index


def need(least: np.ndarray, q: int) -> np.ndarray:
    """The q-gram lemma's bound for a stretch of so many letters, of whose q-grams changed words may destroy the part ``LOST``."""
    return np.maximum(3, np.ceil((1 - LOST) * (least - q + 1)))


def candidates(index: dict, hashed: dict[int, np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """doc, item, middle diagonal and q-gram count of each band that meets the bound. ``hashed``: the documents' q-grams by q."""
    found = []
    doc_start = np.concatenate([[0], stop[:-1]])
    items = len(index["ids"])
    for q, g in hashed.items():
        h, item, place, top = index[q]
        if not len(h) or not len(g):
            continue
        slot = (g >> np.uint64(64 - TOP)).astype(np.int32)
        lo = top[slot]
        n = top[slot + 1] - lo
        at = np.flatnonzero(n)
        lo, n = lo[at], n[at]
        each = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        same = h[each] == g[at]
        at, each = at[same], each[same]
        d = np.searchsorted(stop, at, "right")
        inside = at + q <= stop[np.minimum(d, len(stop) - 1)]
        at, each, d = at[inside], each[inside], d[inside]
        i = item[each].astype(np.int64)
        bound = index["need"][q]
        pair = d * items + i
        # A pair with too few hits in all has too few in any band.
        if len(stop) * items <= 1 << 24:
            often = np.bincount(pair, minlength=len(stop) * items)[pair]
        else:
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            often = count[inverse]
        keep = often >= bound[i]
        if not keep.any():
            continue
        pair, at, each, d = pair[keep], at[keep], each[keep], d[keep]
        key = np.sort(pair << 32 | ((at - doc_start[d]) - place[each] + (1 << 31)))
        for shift in (0, BAND // 2):
            band = (key + shift) // BAND  # 2 ** 32 is a multiple of it: a band never joins two pairs but at the far end, where no diagonal is
            head = np.flatnonzero(np.diff(band, prepend=-1))
            count = np.diff(np.append(head, len(band)))
            who = (key[head] >> 32) % items
            good = count >= bound[who]
            head, count, who = head[good], count[good], who[good]
            found.append(((key[head] >> 32) // items, who, (band[head] * BAND - shift & 0xFFFFFFFF) - (1 << 31) + BAND // 2, count))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _align(index: dict, text: np.ndarray, stop: np.ndarray, doc: np.ndarray, item: np.ndarray, middle: np.ndarray, low: np.ndarray, high: np.ndarray, cut: bool = False) -> tuple[np.ndarray, ...]:
    """Score, begin and end (letters of the item) of the best local alignment of each band's letters from low to high (match 1, gap -1, other letter -2).

    With ``cut``, also where the alignment's worst-scoring part begins and ends; without one, both are where the alignment begins.
    """
    m = len(doc)
    rows = int((high - low).max())
    width = 2 * HALF + 1
    doc_start = np.concatenate([[0], stop[:-1]])[doc]
    doc_end = stop[doc]
    padded = np.append(text, 0)
    # Score above, where the alignment began (counted from the end) below: in 32 bits where both fit.
    bits, kind = (15, np.int32) if rows < 1 << 15 else (24, np.int64)
    mask = (1 << bits) - 1
    ramp = np.arange(width).astype(kind) << bits
    one = kind(1 << bits)
    h = np.zeros((m, width), kind)
    best = np.zeros(m, kind)
    best_end = np.zeros(m, np.int64)
    best_at = np.zeros(m, np.int64)
    shifted = np.full((m, width), -one, kind)
    # Letters of the texts along each band, once: row r sees the window from r on.
    reach = doc_start[:, None] + low[:, None] + middle[:, None] - HALF + np.arange(rows + width)
    along = padded[np.where((reach >= doc_start[:, None]) & (reach < doc_end[:, None]), reach, len(text))]
    along = np.where((reach >= doc_start[:, None]) & (reach < doc_end[:, None]), along, np.uint32(0))
    own = index["text"][np.minimum(index["start"][item][:, None] + low[:, None] + np.arange(rows), len(index["text"]) - 1)]
    left = high - low
    shortest = int(left.min())
    ways = np.zeros((rows if cut else 0, m, width), np.int8)  # 1 match, 2 other letter, 3 item letter left out, 4 letter of the text left out
    for r in range(rows):
        same = along[:, r : r + width] == own[:, r, None]
        start = np.maximum(h, kind(rows - r))  # what has no score begins here
        new = np.where(same, start + one, h - 2 * one)
        shifted[:, :-1] = h[:, 1:] - one
        straight = new.copy() if cut else new
        np.maximum(new, shifted, out=new)
        np.maximum(np.maximum.accumulate(new + ramp, axis=1) - ramp, 0, out=new)
        new[new < one] = 0
        if r >= shortest:
            new[r >= left] = 0
        h = new
        if cut:
            ways[r] = np.where(h == straight, np.where(same, 1, 2), np.where(h == shifted, 3, 4))
        top = h.max(1)
        better = (top >> bits) > (best >> bits)
        best = np.where(better, top, best)
        best_end = np.where(better, r + 1, best_end)
        best_at = np.where(better, h.argmax(1), best_at)
    begin = np.where(best > 0, rows - (best & mask).astype(np.int64), 0)
    out = (best >> bits).astype(np.int64), low + begin, low + best_end
    if not cut:
        return out
    gain = np.zeros((m, rows), np.int64)
    r, k, who = best_end - 1, best_at, np.flatnonzero(best > 0)
    while len(who):  # back along all alignments in step
        way = ways[r[who], who, k[who]]
        gain[who, r[who]] += np.array([0, 1, -2, -1, -1])[way]
        k[who] += np.array([0, 0, 0, 1, -1])[way]
        r[who] -= way != 4
        who = who[r[who] >= begin[who]]
    total = np.concatenate([np.zeros((m, 1), np.int64), np.cumsum(gain, axis=1)], axis=1)
    drop = total - np.maximum.accumulate(total, axis=1)
    cut_end = np.where((drop < 0).any(1), drop.argmin(1), begin)
    place = np.arange(rows + 1)
    ahead = np.where((place <= cut_end[:, None]) & (place >= begin[:, None]), total, -(1 << 40))
    cut_begin = np.where((drop < 0).any(1), ahead.shape[1] - 1 - ahead[:, ::-1].argmax(1), begin)
    return *out, low + cut_begin, low + cut_end


def verify(index: dict, text: np.ndarray, stop: np.ndarray, doc: np.ndarray, item: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Share of the item's words, the opening apart, in the best dense stretch inside each band.

    An alignment that fails by density is cut at its worst-scoring part; what is left on both sides of the
    cut, or of an alignment that is dense but short, is aligned on its own, as long as it can hold the share.
    """
    cum = np.concatenate([[0], np.cumsum(index["weight"])])
    first, opening = index["start"][item], index["opening"][item]
    whole = np.maximum(cum[index["stop"][item]] - cum[first + opening], 1e-9)

    def part(who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        outside = np.minimum(np.maximum(begin, opening[who]), end)
        return (cum[first[who] + end] - cum[first[who] + outside]) / whole[who]

    out = np.zeros(len(doc))
    who = np.arange(len(doc))
    low, high = np.zeros(len(doc), np.int64), (index["stop"] - index["start"])[item]
    score, begin, end = _align(index, text, stop, doc, item, middle, low, high)
    while True:
        share = np.where((score > 0) & (score >= DENSITY * (end - begin)), part(who, begin, end), 0.0)
        np.maximum.at(out, who, share)
        # No stretch of a range scores more than its best: below the least score that counts, nothing is left to find.
        again = np.flatnonzero((out[who] < SHARE) & (score >= DENSITY * index["least"][item[who]]))
        if not len(again):
            return out
        who, low, high = who[again], low[again], high[again]
        nxt = []
        room = max(1, PATH_CELLS // ((2 * HALF + 1) * int((high - low).max())))
        for at in range(0, len(who), room):
            w, lo, hi = (x[at : at + room] for x in (who, low, high))
            score, begin, end, cut_begin, cut_end = _align(index, text, stop, doc[w], item[w], middle[w], lo, hi, cut=True)
            loose = score < DENSITY * (end - begin)
            nxt += [(w, lo, np.where(loose, cut_begin, begin)), (w, np.where(loose, cut_end, end), hi)]
        who, low, high = (np.concatenate(x) for x in zip(*nxt))
        keep = np.flatnonzero((high > low) & (part(who, low, high) >= SHARE))
        if not len(keep):
            return out
        who, low, high = who[keep], low[keep], high[keep]
        got = [_align(index, text, stop, doc[w], item[w], middle[w], lo, hi) for w, lo, hi in ((x[k : k + TOGETHER] for x in (who, low, high)) for k in range(0, len(who), TOGETHER))]
        score, begin, end = (np.concatenate(x) for x in zip(*got))


def _leaks(batches: Iterator[pa.RecordBatch], indexes: list[dict]) -> Iterator[pa.RecordBatch]:
    tables()
    for batch in batches:
        for part in slices(batch, "text"):
            text, stop, _ = letters(*folded(*code_points(part.column(part.schema.get_field_index("text")))))
            hashed = {q: grams(text, q) for q in (Q_LETTERS, Q_IDEOGRAPHS) if any(len(index[q][0]) for index in indexes)}
            for index in indexes:
                yield from _found(index, part.column(part.schema.get_field_index("doc_id")), text, stop, hashed)


def _found(index: dict, ids: pa.Array, text: np.ndarray, stop: np.ndarray, hashed: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of one slice of documents with one block of items."""
    doc, item, middle, count = candidates(index, hashed, stop)
    order = np.lexsort((-count, item, doc))
    doc, item, middle = doc[order], item[order], middle[order]
    out_doc, out_item, out_share = [], [], []
    while len(doc):  # the fullest band of each pair first; the others only if it fails
        lead = np.ones(len(doc), bool)
        lead[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        pair = np.cumsum(lead) - 1
        first = np.flatnonzero(lead)
        # Items of like length are aligned in step.
        share, by_length = np.zeros(len(first)), np.argsort((index["stop"] - index["start"])[item[first]], kind="stable")
        for k in range(0, len(first), TOGETHER):
            some = by_length[k : k + TOGETHER]
            at = first[some]
            share[some] = verify(index, text, stop, doc[at], item[at], middle[at])
        hit = share >= SHARE
        out_doc.append(doc[first[hit]])
        out_item.append(item[first[hit]])
        out_share.append(share[hit])
        rest = ~lead & ~hit[pair]
        doc, item, middle = doc[rest], item[rest], middle[rest]
    if out_doc and sum(map(len, out_doc)):
        d = np.concatenate(out_doc)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(d)), pa.array(index["ids"][np.concatenate(out_item)]), pa.array(np.round(np.concatenate(out_share), 4))], names=["doc_id", "item_id", "share"]
        )


def leaks(documents: DataFrame, items: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``doc_id, item_id, share``: documents that hold an item, or a stretch of three tenths of its words.

    ``share`` counts the item's words in the best stretch, a shared opening instruction left out on both
    sides. Null and empty texts and items, and items shorter than a q-gram, match nothing; repeated
    documents are each reported; an item id that stands twice is reported for either text. Items are dealt to
    blocks of about ``block_letters`` characters, so that what goes to a task stays bounded however many there
    are; ``BLOCKS_A_PASS`` blocks share one pass over the corpus. Blocks don't change the rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    opened = scratch.cut(shared_openings(items))
    size = opened.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0)), F.count("*")).first()
    schema = "doc_id long, item_id long, share double"
    if not size[1]:
        return spark.createDataFrame([], schema)
    blocks = max(-(-size[0] // block_letters), -(-size[1] // 50_000))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "item_text"])
        return pd.DataFrame({"index": [pickle.dumps(build_index(list(zip(pdf["item_id"], pdf["item_text"])), pdf["opening"].tolist()), protocol=5)]})

    built = scratch.cut(opened.groupBy(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)).alias("block")).applyInPandas(build, "index binary"))
    docs = documents.filter("text <> ''").select("doc_id", "text")
    # The driver hands the indexes on, one block at a time.
    held = [spark.sparkContext.broadcast(bytes(row["index"])) for row in built.toLocalIterator()]
    out = None
    for at in range(0, len(held), BLOCKS_A_PASS):

        def task(batches: Iterator[pa.RecordBatch], some=held[at : at + BLOCKS_A_PASS]) -> Iterator[pa.RecordBatch]:
            return _leaks(batches, [pickle.loads(b.value) for b in some])

        part = docs.mapInArrow(task, schema)
        out = part if out is None else out.unionByName(part)
    return out
