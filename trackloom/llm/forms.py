"""Problem 8: one consistent form for text that looks the same.

Arrow text is copied into an array of code points for a whole slice of rows at a time. A lookup table
gives each code point its replacement (none, one or more code points); counts and offsets expand them in
one gather. Marks are then put in canonical order and composed with their bases, again for the whole
slice. No Python call is made per row.

Folded: full-width and narrow forms, Latin ligatures, CJK radicals for their ideographs, canonical
equivalents; look-alike letters to one of them; all spaces to one, line ends to one; characters without
any ink are dropped. Kept apart: case, accents, digits, words, blank lines and the number of spaces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɡ": "g", "ɑ": "a", "ı": "i", "µ": "μ",
    "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "Լ": "L", "Ս": "U", "Տ": "S", "Օ": "O", "զ": "q", "հ": "h", "յ": "j", "ո": "n", "ս": "u", "ց": "g", "օ": "o",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲥ": "c",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O",
    "ꓴ": "U",
}
HYPHENS = "‐‑﹣"
LINE_ENDS = "  \x85"
SLICE = 1_500_000  # code points handled at once


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" and not 0x600 <= cp <= 0x8FF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x0D) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def _one(ch: str) -> str:
    """The replacement of one character, before composition."""
    if _invisible(ch):
        return ""
    if ch in LINE_ENDS:
        return "\n"
    if ch in HYPHENS:
        return "-"
    if unicodedata.category(ch) == "Zs":
        return " "
    cp = ord(ch)
    if 0xAC00 <= cp <= 0xD7A3:
        return ch
    tag = unicodedata.decomposition(ch).split(" ")[0]
    folds = tag in ("<wide>", "<narrow>") or tag == "<compat>" and (0x2E80 <= cp <= 0x2FDF or 0xFB00 <= cp <= 0xFB06)
    plain = unicodedata.normalize("NFKD" if folds else "NFD", ch) if tag else ch
    return "".join(LOOKALIKES.get(c, c) for c in plain)


@cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points: start and count of the replacement in ``flat``, combining class, UTF-8 length; composition pairs, sorted."""
    size = 0x110000
    start = np.arange(size, dtype=np.int64)
    count = np.ones(size, np.int64)
    flat = list(range(size))
    ccc = np.zeros(size, np.uint8)
    pairs: dict[int, int] = {}
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        out = _one(ch)
        if out != ch:
            start[cp], count[cp] = len(flat), len(out)
            flat.extend(map(ord, out))
        two = unicodedata.decomposition(ch).split(" ")
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch and unicodedata.combining(chr(int(two[1], 16))):
            pairs[int(two[0], 16) << 21 | int(two[1], 16)] = cp
    for cp in [0x0D, *range(0xE0000, 0xE0200)]:
        if _invisible(chr(cp)):
            count[cp] = 0
    keys = np.array(sorted(pairs), np.int64)
    width = np.full(size, 4, np.int64)
    width[:0x10000], width[:0x800], width[:0x80] = 3, 2, 1
    return {"start": start, "count": count, "flat": np.array(flat, np.uint32), "ccc": ccc, "keys": keys, "made": np.array([pairs[k] for k in keys], np.uint32), "width": width}


def folded(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of each row: ``points`` are the rows' code points end to end, ``ends`` where each row ends in them."""
    t = tables()
    lengths = t["count"][points]
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = total[ends]
    if (lengths == 1).all():
        out = t["flat"][t["start"][points]]
    else:
        base = t["start"][points] - total[:-1]
        out = t["flat"][np.repeat(base, lengths) + np.arange(total[-1])]
    head = np.zeros(len(out) + 1, bool)
    head[np.concatenate([[0], ends])] = True
    head = head[:-1]
    ccc = t["ccc"][out]
    if ccc.any():
        while True:  # canonical order of neighbouring marks
            swap = np.flatnonzero((ccc[:-1] > ccc[1:]) & (ccc[1:] > 0) & ~head[1:])
            if not len(swap):
                break
            swap = swap[np.concatenate([[True], np.diff(swap) > 1])]
            out[swap], out[swap + 1] = out[swap + 1], out[swap]
            ccc[swap], ccc[swap + 1] = ccc[swap + 1], ccc[swap]
        while len(out) > 1:  # a base takes the mark next to it
            at = np.flatnonzero((ccc[1:] > 0) & (ccc[:-1] == 0) & ~head[1:])
            key = out[at].astype(np.int64) << 21 | out[at + 1]
            place = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = t["keys"][place] == key
            if not hit.any():
                break
            at, place = at[hit], place[hit]
            out[at] = t["made"][place]
            keep = np.ones(len(out), bool)
            keep[at + 1] = False
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            out, ccc = out[keep], ccc[keep]
            head = np.zeros(len(out) + 1, bool)
            head[np.concatenate([[0], ends])] = True
            head = head[:-1]
    return syllables(out, ends, head)


# First code points of Hangul syllables and their letters, and how many letters there are of each kind.
SYLLABLE, LEAD, VOWEL, TRAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
LEADS, VOWELS, TRAILS = 19, 21, 28


def syllables(out: np.ndarray, ends: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters composed into syllables: a leading one with a vowel, then such a syllable with a trailing one."""
    for open_, last, first, count in ((lambda c: (c >= LEAD) & (c < LEAD + LEADS), lambda a, b: SYLLABLE + ((a - LEAD) * VOWELS + b - VOWEL) * TRAILS, VOWEL, VOWELS), (lambda c: (c >= SYLLABLE) & (c < SYLLABLE + LEADS * VOWELS * TRAILS) & ((c - SYLLABLE) % TRAILS == 0), lambda a, b: a + b - TRAIL, TRAIL + 1, TRAILS - 1)):
        second = (out >= first) & (out < first + count) & ~head
        if not second.any():
            continue
        at = np.flatnonzero(second[1:] & open_(out[:-1].astype(np.int64)))
        out[at] = last(out[at].astype(np.int64), out[at + 1].astype(np.int64))
        keep = np.ones(len(out), bool)
        keep[at + 1] = False
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        out, head = out[keep], head[keep]
    return out, ends


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows end to end, and where each row ends; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    data = np.frombuffer(raw, np.uint8)
    points = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets[1:] - offsets[0]]


def text_array(points: np.ndarray, ends: np.ndarray, valid: np.ndarray) -> pa.Array:
    """An Arrow string array from code points."""
    sizes = np.concatenate([[0], np.cumsum(tables()["width"][points])])
    offsets = np.concatenate([[0], sizes[ends]]).astype(np.int64)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    bits = np.packbits(valid, bitorder="little").tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(ends), [pa.py_buffer(bits), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.string())


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most SLICE bytes, or a single row."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column(part.schema.get_field_index("text"))
            points, ends = folded(*code_points(text))
            valid = text.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), text_array(points, ends, valid)], names=["doc_id", "form"])


def forms(documents: DataFrame) -> DataFrame:
    """``doc_id, form`` for every row; a null text has a null form, an empty one an empty form. Other columns are ignored; repeated rows stay."""
    return documents.select("doc_id", "text").mapInArrow(_forms, "doc_id long, form string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column(part.schema.get_field_index("text"))
            points, ends = folded(*code_points(text))
            form = text_array(points, ends, text.is_valid().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), text, form], names=["doc_id", "text", "form"])


def _seen(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``doc_id, raw, form`` (digests) of all texts with ink, and ``form, raw, n`` of forms that have two or more texts.

    Texts are read and folded once; only 128-bit digests of text and form are kept and moved. Forms of one text
    alone, however often it was copied, go here.
    """
    both = documents.filter("text <> ''").select("doc_id", "text").mapInArrow(_digests, "doc_id long, text string, form string")
    seen = scratch.cut(both.filter("form <> ''").select("doc_id", F.unhex(F.md5("text")).alias("raw"), F.unhex(F.md5("form")).alias("form")))
    texts = seen.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    mixed = texts.groupBy("form").agg(F.count("*").alias("texts"), F.sum("n").alias("all"), F.min("least").alias("class_id")).filter("texts > 1")
    return seen, texts.join(mixed, "form").select("form", "raw", "n", "class_id", (F.col("all") - F.col("n")).alias("links"))


def same_looking_classes(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, class_id, links`` of every document that looks like one with another text: the least doc_id of those that look the same, and how many of them have another text. One row a document, whatever the size of a class; no pair is built. Null and empty texts, and texts without any ink, don't count."""
    seen, texts = _seen(documents, scratch)
    return seen.join(texts.select("form", "raw", "class_id", "links"), ["form", "raw"]).select("doc_id", "class_id", "links")


def same_looking(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id_a, doc_id_b`` (smaller first): the classes of ``same_looking_classes`` written out as pairs of documents with different texts, as long as the pairs themselves are wanted."""
    seen, texts = _seen(documents, scratch)
    rows = seen.join(texts.select("form", "raw"), ["form", "raw"], "left_semi")
    a = rows.select("form", F.col("raw").alias("raw_a"), F.col("doc_id").alias("a"))
    b = rows.select("form", F.col("raw").alias("raw_b"), F.col("doc_id").alias("b"))
    return a.join(b, "form").filter("a < b AND raw_a <> raw_b").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()
