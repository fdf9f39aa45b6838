"""Problem 6: texts into containers of fixed token capacity, by pattern packing.

Token counts of a public tokenizer are the sizes. A container is a row of units of about ``UNIT`` tokens. What
is packed by patterns is a unit: one to three texts of exact sizes, or the tail of a text longer than a unit
with up to two others, that fill it. All such patterns are enumerated, their repeat counts fitted to the
histogram of sizes by non-negative least squares and rounded; what a fit leaves is fitted again, with a little
slack at last. Units of a long text and its tail stay together, and rows of whole units are laid into containers
without loss. The few texts that no pattern takes are packed best fit, largest first, into the room left.

Items are dealt to shards of bounded size by hash, and each shard is packed in a task of its own: with a hundred
thousand items a shard's histogram is the corpus's, so sharding costs a few part-filled containers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .forms import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern that belongs to byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT = 256
SLACKS = (0, 0, 0, 1, 2)  # tokens that the patterns of each fit may leave free in a unit
ENOUGH = 0.95  # share of the texts placed after which no further fit is made
SHARD_ITEMS = 100_000
PACKED = "profile string, container string, doc_id long, piece int, first_token long, tokens int, placed_by string"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n``: tokens of the whole text. Null texts have no row; an empty one has 0. The vocabulary file need only be where the driver is: it goes to the executors with the job."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                n = np.fromiter((len(encode(t)) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n)], names=["doc_id", "n"])

    return documents.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(count, "doc_id long, n long")


@cache
def patterns(unit: int, tails: bool, slack: int) -> np.ndarray:
    """Rows of three: sizes 1..unit of texts, or unit + t for the tail t (first, at most one), 0 for none. All that fill a unit but for ``slack`` tokens."""
    x, y = np.meshgrid(np.arange(unit + 1), np.arange(unit + 1), indexing="ij")
    out = []
    for total in range(max(1, unit - slack), unit + 1):
        z = total - x - y
        rest = (z >= 0) & (z <= y)
        for own, first in ((x >= y) & (x > 0), 0), (tails & (x > 0) & (x < unit), unit):
            fits = rest & own
            out.append(np.column_stack([x[fits] + first, y[fits], z[fits]]))
    return np.concatenate(out)


def nnls(table: np.ndarray, b: np.ndarray, rounds: int = 200, together: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Columns (rows of ``table``: which entries of b one repeat uses, 0 for none) and counts >= 0 that make the error over b least, up to half a percent of it.

    Columns enter by gradient, some that share no entry at a time, and leave where the unbounded solution on the
    columns held would turn them negative.
    """
    held, x = np.zeros(0, np.int64), np.zeros(0)
    error = b.copy()
    error[0] = 0

    def dense(columns: np.ndarray) -> np.ndarray:
        n = len(columns)
        d = np.bincount((table[columns] * n + np.arange(n)[:, None]).ravel(), minlength=len(b) * n).reshape(len(b), n).astype(float)
        d[0] = 0
        return d

    for _ in range(rounds):
        gradient = error[table].sum(1)
        gradient[held] = -np.inf
        best = np.argpartition(-gradient, min(200, len(gradient) - 1))[:200]
        used, new = np.zeros(len(b), bool), []
        for j in best[np.argsort(-gradient[best], kind="stable")]:
            own = table[j][table[j] > 0]
            if gradient[j] <= 1e-6 * b.max() or len(new) == together:
                break
            if not used[own].any():
                used[own] = True
                new.append(j)
        if not new:
            break
        held, x = np.concatenate([held, np.array(new)]), np.concatenate([x, np.zeros(len(new))])
        while len(held):
            d = dense(held)
            z = np.linalg.solve(d.T @ d + 1e-9 * np.eye(len(held)), d.T @ b)
            low = z <= 0
            if not low.any():
                x = z
                break
            x = x + np.min(x[low] / np.maximum(x[low] - z[low], 1e-12)) * (z - x)
            stay = x > 1e-9
            if stay.all():
                stay[np.argmin(x)] = False
            held, x = held[stay], x[stay]
        error = b - dense(held) @ x
        error[0] = 0
        if np.abs(error).sum() < 0.005 * b[1:].sum():
            break
    return held, x


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each size (1..capacity), and whether a pattern placed it."""
    units = max(1, capacity // UNIT)
    unit = capacity // units
    count = len(sizes)
    whole = np.where((sizes > unit) | (sizes > unit * units), sizes // unit, 0)
    rest = np.where(whole < units, sizes - whole * unit, 0)  # what a row of all units can't hold, the container can
    entry = np.where((whole > 0) & (rest > 0), unit + rest, rest)  # 0: whole units without a tail
    order = np.argsort(entry, kind="stable")
    first = np.searchsorted(entry[order], np.arange(2 * unit + 1))
    left = np.diff(first)
    left[0] = 0
    row = np.full(count, -1, np.int64)
    rows, total = 0, left.sum()
    for slack in SLACKS:
        table = patterns(unit, units > 1, slack)
        some = left > 0
        some[0] = True
        table = table[some[table].all(1)]
        if not len(table) or left.sum() <= (1 - ENOUGH) * total:
            continue
        held, wanted = nnls(table, left.astype(float))
        for k in np.argsort(-wanted, kind="stable"):
            own, each = np.unique(table[held[k]][table[held[k]] > 0], return_counts=True)
            times = min(int(np.ceil(wanted[k] - 0.3)), int((left[own] // each).min()))
            if times <= 0:
                continue
            for e, n in zip(own, each * times):
                taken = order[first[e] : first[e] + n]
                row[taken] = rows + np.arange(n) % times
                first[e] += n
                left[e] -= n
            rows += times
    # Rows of whole units: a pattern's unit with those of its long text, and long texts without a tail.
    height = np.ones(rows, np.int64)
    tail = np.flatnonzero((row >= 0) & (whole > 0))
    height[row[tail]] += whole[tail]
    alone = np.flatnonzero(entry == 0)
    row[alone] = rows + np.arange(len(alone))
    height = np.concatenate([height, whole[alone]])
    of = np.full(len(height), -1, np.int64)
    stacks = [np.flatnonzero(height == h).tolist() for h in range(units + 1)]
    number = 0
    for tallest in range(units, 0, -1):
        while stacks[tallest]:
            room = h = units
            while room and h:
                h = min(h, room)
                if stacks[h]:
                    of[stacks[h].pop()] = number
                    room -= h
                else:
                    h -= 1
            number += 1
    fitted = row >= 0
    where = np.full(count, -1, np.int64)
    where[fitted] = of[row[fitted]]
    # The rest: the fullest container that still has room, by exact size. Bit r of ``open_``: a container with r free tokens.
    free: dict[int, list[int]] = {}
    open_ = 0
    for k, room in enumerate((capacity - np.bincount(where[fitted], sizes[fitted], number).astype(np.int64)).tolist()):
        if room:
            free.setdefault(room, []).append(k)
            open_ |= 1 << room
    others = np.flatnonzero(~fitted)
    others = others[np.argsort(-sizes[others], kind="stable")]
    for item, size in zip(others.tolist(), sizes[others].tolist()):
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                open_ &= ~(1 << room)
        else:
            k, room = number, capacity
            number += 1
        where[item] = k
        room -= size
        if room:
            free.setdefault(room, []).append(k)
            open_ |= 1 << room
    return where, fitted


def containers(documents: DataFrame, profiles: DataFrame, scratch: Scratch, tokenizer: str = TOKENIZER, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``profile, container, doc_id, piece, first_token, tokens, placed_by`` (pattern, best_fit; whole for a piece of the capacity) for each profile.

    No container holds more than its capacity. A text is cut only if it alone exceeds the capacity: into
    pieces of the capacity, each a container of its own, and a remainder that is packed with other texts.
    Null and empty texts have no tokens and no container. Profiles without a name or a positive capacity
    are ignored; there may be at most 1,000. Repeated rows are packed each.
    """
    sizes = scratch.cut(token_counts(documents, tokenizer).filter("n > 0"))
    shards = max(1, -(-sizes.count() // shard_items))
    wanted = profiles.filter("profile IS NOT NULL AND capacity_tokens > 0").select("profile", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("more than 1,000 profiles")
    each = F.explode(F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["capacity"]).alias("capacity")) for r in wanted])) if wanted else None
    if each is None:
        return sizes.sparkSession.createDataFrame([], PACKED)
    items = sizes.withColumn("p", each).select("p.profile", "p.capacity", "doc_id", "n").withColumn("whole", F.expr("n div capacity"))
    named = F.concat_ws("-", "profile", "doc_id", "piece")
    full = items.filter("whole > 0").select("profile", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    full = full.select("profile", named.alias("container"), "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("int").alias("tokens"), F.lit("whole").alias("placed_by"))
    rest = items.filter("n > whole * capacity").select("profile", "capacity", "doc_id", F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("capacity")).alias("first_token"), (F.col("n") - F.col("whole") * F.col("capacity")).cast("int").alias("tokens"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"))

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable")
        number, fitted = pack(rows["tokens"].to_numpy(np.int64), int(rows["capacity"].iloc[0]))
        name = f"{rows['profile'].iloc[0]}-{rows['shard'].iloc[0]}:"
        return pd.DataFrame({"profile": rows["profile"], "container": name + pd.Series(number, index=rows.index).astype(str), "doc_id": rows["doc_id"], "piece": rows["piece"], "first_token": rows["first_token"], "tokens": rows["tokens"], "placed_by": np.where(fitted, "pattern", "best_fit")})

    return rest.groupBy("profile", "shard").applyInPandas(pack_shard, PACKED).unionByName(full)


def packing_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: containers, texts, tokens, the share of room used, and the share of texts (remainders of cut ones among them) that patterns placed."""
    ours = F.col("placed_by") != "whole"
    total = packed.groupBy("profile").agg(
        F.countDistinct("container").alias("containers"), F.countDistinct("doc_id").alias("texts"), F.sum("tokens").alias("tokens"), F.round(F.count_if(F.col("placed_by") == "pattern") / F.nullif(F.count_if(ours), F.lit(0)), 4).alias("by_pattern")
    )
    return total.join(profiles, "profile").select("profile", "containers", "texts", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"), "by_pattern")
