"""Connected components by random-mate contraction, in SQL joins.

Each round every vertex that still has an edge draws a coin from a hash of its id and the round (so a
recomputed task draws the same). A tails vertex with heads neighbours collapses into the least of
them; edges are renamed, loops and repeats go. When no edge is left, the rounds' moves are unwound
in one plan, which gives each vertex its final representative.

Nothing is collected but the number of edges left. A hub vertex costs no quadratic work: its edges are
a plain table, its choice a partial minimum, and renaming joins against one row for the hub, which
AQE's skew join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _heads(vertex: str):
    """Heads every other time. In the first round odd ids, which ``linked_groups`` gives to shared values, are heads seven times in eight and even ids once: that melts stars at once and costs other graphs a slow first round."""
    draw = F.pmod(F.xxhash64(F.col(vertex), F.col("turn")), F.lit(8))
    return draw < F.when(F.col("turn") > 0, 4).when(F.col(vertex) % 2 != 0, 7).otherwise(1)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """``(a, b)`` long edges -> ``(vertex, root)`` for each vertex that has an edge to another one. Any graph will do.

    Null ends, loops and repeated edges are allowed and don't count. An empty table gives an empty
    table. ``root`` is one vertex of the component, the same for all its vertices.
    """
    left = scratch.cut(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("turn")).distinct()
    )
    # The round's number is a column, not a literal: all rounds then run the same generated code.
    moves = []
    for _ in range(rounds):
        if not left._scratch_rows:
            break
        ends = left.select(F.col("a").alias("v"), F.col("b").alias("w"), "turn").union(left.select("b", "a", "turn"))
        move = scratch.cut(ends.filter(~_heads("v") & _heads("w")).groupBy("v").agg(F.min("w").alias("w")))
        moves.append(move)
        after = (
            left.join(move.select(F.col("v").alias("a"), F.col("w").alias("a2")), "a", "left")
            .join(move.select(F.col("v").alias("b"), F.col("w").alias("b2")), "b", "left")
            .select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), (F.col("turn") + 1).alias("turn"))
            .filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "turn").distinct()
        )
        renamed = scratch.cut(after)
        scratch.drop(left)
        left = renamed
    else:
        if left._scratch_rows:
            raise RuntimeError(f"edges are left after {rounds} rounds")
    scratch.drop(left)
    if not moves:
        return edges.sparkSession.createDataFrame([], "vertex long, root long")
    # A vertex goes once, and what it went into goes, if at all, in a later round: one pass over the moves, each
    # joined once, settles the ends of all of them.
    settled = scratch.cut(unwound(moves))
    for move in moves:
        scratch.drop(move)
    return settled.unionByName(settled.select(F.col("root").alias("vertex"), "root").distinct())


def unwound(moves: list[DataFrame]) -> DataFrame:
    """``(vertex, root)`` of all vertices that moved, from the rounds' ``(v, w)``."""
    ends = None
    for move in moves:
        this = move.select(F.col("v").alias("vertex"), F.col("w").alias("root"))
        if ends is not None:
            ends = ends.join(move, ends["root"] == move["v"], "left").select("vertex", F.coalesce("w", "root").alias("root"))
            this = ends.unionByName(this)
        ends = this
    return ends


def linked_groups(rows: DataFrame, row_id: str, links: list[str], scratch: Scratch) -> DataFrame:
    """``(row_id, group_id)``: rows that share a value of any link column, directly or by way of others, get one group.

    ``group_id`` is the least row id of the group; a row without any link value is a group of its own.
    Rows with the same link values become one vertex before anything is contracted, so copies and hot
    values add no edges. Link columns are all strings or all binary; null and empty link nothing. Repeated row ids are one row.
    """
    filled = rows.select(F.col(row_id).alias("_id"), *[F.coalesce(F.col(c), F.lit("").cast(rows.schema[c].dataType)).alias(c) for c in links])
    has = " OR ".join(f"length(`{c}`) > 0" for c in links)
    nodes = scratch.cut(filled.groupBy(*links).agg(F.min("_id").alias("node")).filter(has))
    values = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("value")) for i, c in enumerate(links)])).alias("x"))
    values = values.select("node", "x.kind", "x.value").filter("length(value) > 0")
    shared = values.groupBy("kind", "value").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    # Vertices: 2 * node for a row, 2 * k + 1 for a shared value, k being unique by least row and kind.
    edges = values.join(shared, ["kind", "value"]).select((F.col("node") * 2).alias("a"), ((F.col("rep") * len(links) + F.col("kind")) * 2 + 1).alias("b"))
    roots = components(edges, scratch)
    least = roots.filter("vertex % 2 = 0").groupBy("root").agg(F.min(F.expr("vertex div 2")).alias("group_id"))
    groups = nodes.join(roots.filter("vertex % 2 = 0").join(least, "root").select(F.expr("vertex div 2").alias("node"), "group_id"), "node", "left")
    groups = groups.select(*links, F.coalesce("group_id", "node").alias("group_id"))
    # A row without links would meet all others of its kind in one task: it goes round the join.
    joined = filled.filter(has).join(groups, links).select(F.col("_id").alias(row_id), "group_id")
    return joined.unionByName(filled.filter(f"NOT ({has})").select(F.col("_id").alias(row_id), F.col("_id").alias("group_id")))
