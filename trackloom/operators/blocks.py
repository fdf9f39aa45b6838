"""Places, last values and rolling frames in long sequences, by blocks: one hot sequence is spread over many tasks.

A sequence is cut into blocks of its order column. What a block needs of those before it is one row each
(a count, a last value), summed up in a table of blocks; no window is longer than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16384


def _blocked(rows: DataFrame, order: str, block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(order) / block))


def numbered(rows: DataFrame, by: list[str], order: str, name: str = "n", block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the place of each row, from 1, in its sequence. ``order`` is a whole number, distinct in a sequence and not null."""
    keys = [*by, "_block"]
    cut = _blocked(rows, order, block)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_c")).select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    placed = cut.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return placed.join(counts, keys).withColumn(name, F.col("_in") + F.col("_before")).select(*rows.columns, name)


def carried(rows: DataFrame, by: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null, at the row or before it."""
    keys = [*by, "_block"]
    cut = _blocked(rows, order, block).withColumn("_v", value)
    ends = cut.groupBy(*keys).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_e"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, F.last("_e", ignorenulls=True).over(before).alias("_e"))
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_own", own).join(ends, keys).withColumn(name, F.coalesce("_own", "_e")).select(*rows.columns, name)


def haloed(rows: DataFrame, by: list[str], order: str, reach: int, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """Rows in blocks of equal length, each with the ``reach`` rows before it (``halo`` true), and the keys of a block: a window over them may look ``reach`` rows back."""
    placed = numbered(rows, by, order, "_n", max(block, reach))
    size = max(block, reach)
    own = F.floor((F.col("_n") - 1) / size)
    late = (F.col("_n") - 1) % size >= size - reach
    spread = placed.withColumn("_o", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("halo", F.col("_o") != own)
    return spread.withColumnRenamed("_o", "part").drop("_n"), [*by, "part"]
