"""Names, keys and spellings as column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scanned data: prefixes that a repeated export or labelling put before a name,
# picture suffixes, and the spellings of splits.
EXPORT_PREFIXES = ("batch2", "reexp", "relabel")
PICTURE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
SPLIT_SPELLINGS = {"train": "train(?:ing)?", "valid": "val(?:id(?:ation)?)?|dev", "test": "test(?:ing)?"}


# Each function names its input once: Catalyst inlines expressions, and a chain stays small where a
# CASE over the same value would double at every step. "" means: names nothing.


def name_tokens(key: Column) -> Column:
    """The words of the name in a ``source:name`` key, whatever its spelling or source; null stays null.

    Percent escapes, letter case, separators, outer space, export hashes and export prefixes don't count.
    """
    body = F.regexp_replace(F.regexp_replace(key, "^[^:]*:", ""), "%(?![0-9A-Fa-f]{2})", "%25")
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.try_url_decode(body), r"\s+", " "))), r"\.rf\.[0-9a-f]{16,}", "")
    words = F.regexp_replace(F.regexp_replace(plain, "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(words, f"^(?:(?:{'|'.join(EXPORT_PREFIXES)})_)+", "")


def frame_name(source_key: Column) -> Column:
    """The source frame that a source_key names; "" where it names none, null for null."""
    return F.regexp_replace(name_tokens(source_key), f"(?:_(?:{'|'.join(PICTURE_SUFFIXES)}))+$", "")


def clip_name(clip_key: Column) -> Column:
    """The clip that a clip_key names; "" where it names none, null for null."""
    return name_tokens(clip_key)


def clip_of_frame(frame: Column) -> Column:
    """The clip that a frame name begins with (the name without its last number); "" without a number."""
    return F.regexp_extract(frame, r"^(.+)_[0-9]+$", 1)


def checksum(image_hash: Column) -> Column:
    """``checksum:size`` in one spelling (lower case, no leading zeros), "" where it identifies nothing, null for null.

    Case, spaces, a 0x and lost leading zeros don't count. No size, a size of nought or less, and a
    checksum of nothing but 0 or f are placeholders.
    """
    flat = F.regexp_replace(F.lower(image_hash), r"\s+", "")
    return F.regexp_extract(flat, r"^(?:0x)?(?!f{8,}:)0*([1-9a-f][0-9a-f]{0,15}:[1-9][0-9]*)$", 1)


def split_name(split: Column) -> Column:
    """train, valid or test, whatever the spelling; "" for anything else, null for null."""
    word = F.regexp_replace(F.lower(split), "[^a-z]", "")
    for name, spellings in SPLIT_SPELLINGS.items():
        word = F.regexp_replace(word, f"^(?:{spellings})$", name)
    return F.regexp_extract(word, f"^({'|'.join(SPLIT_SPELLINGS)})$", 1)
