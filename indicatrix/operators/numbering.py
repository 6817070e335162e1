"""Dense numbers for the rows of a distributed table, without a task that sees them all.

Each block of rows is counted, the counts before a block are its offset, and rows are numbered
within their block. Only the counts meet in one place.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from indicatrix.plans.tables import stored

_ID, _BLOCK, _BEFORE = "_number_id", "_number_block", "_number_before"


def overall(rows: DataFrame, *order: str, into: str = "ord") -> DataFrame:
    """``rows`` with their places from 0 in the order of some columns; ties in any order.

    Rows are dealt out by ranges of the order and sorted there, so blocks are partitions, and the
    driver sees one count for each. The sorted rows are stored, as both steps read them.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn(_ID, F.monotonically_increasing_id()), "numbered").withColumn(_BLOCK, F.shiftright(_ID, 33))
    counts = sorted(placed.groupBy(_BLOCK).count().collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = [(block, place - (block << 33)) for (block, _), place in zip(counts, before)]
    offsets = rows.sparkSession.createDataFrame(offsets, f"{_BLOCK} long, {_BEFORE} long")
    # One row for each partition of the table.
    kept = [c for c in rows.columns if c != into]
    return placed.join(F.broadcast(offsets), _BLOCK).select(*kept, (F.col(_ID) + F.col(_BEFORE)).alias(into))


def ranked(rows: DataFrame, group: str, *order: str, into: str = "rank") -> DataFrame:
    """``rows`` with their places from 1 within each of a few groups, however large those are."""
    placed = overall(rows, group, *order, into=_BLOCK)
    firsts = placed.groupBy(group).agg(F.min(_BLOCK).alias(_BEFORE))
    # One row for each group; a join by the group would bring its rows to one task.
    return placed.join(F.broadcast(firsts), group).withColumn(into, F.col(_BLOCK) - F.col(_BEFORE) + 1).drop(_BLOCK, _BEFORE)


def along(rows: DataFrame, group: list[str], block: list[str], into: str = "ord", without: str | None = None) -> DataFrame:
    """``rows``, just read, with their places from 0 within each ``group``, by ``block``, then as they were read.

    A block is what one task reads in one stretch, such as a split of a file. Rows are stored with
    their numbers in the task, and are never sorted or dealt out. Blocks with a row where ``without``
    holds are left out.
    """
    placed = stored(rows.withColumn(_ID, F.monotonically_increasing_id()), "placed")
    earlier = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy(*group, *block).agg(F.count(F.lit(1)).alias(_BLOCK), F.min(_ID).alias("_first"), F.max(F.col(without) if without else F.lit(False)).alias("_out"))
    blocks = blocks.where("NOT _out")
    before = F.coalesce(F.sum(_BLOCK).over(earlier), F.lit(0)) - F.col("_first")
    # Stored, so that its size is known to the join.
    offsets = stored(blocks.select(*group, *block, before.alias(_BEFORE)), "offsets")
    return placed.join(offsets, [*group, *block]).withColumn(into, F.col(_ID) + F.col(_BEFORE)).drop(_ID, _BEFORE)


def within(rows: DataFrame, group: list[str], block: list[str], order: list[str], into: str = "ord") -> DataFrame:
    """``rows`` with their places from 0 within each ``group``, by ``block``, then by ``order``.

    A block is sorted by itself; a group is only as many counts as it has blocks. ``rows`` are read
    twice, so they should be stored or cheap.
    """
    local = Window.partitionBy(*group, *block).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, *block).agg(F.count(F.lit(1)).alias(_BLOCK))
    offsets = offsets.select(*group, *block, F.coalesce(F.sum(_BLOCK).over(earlier), F.lit(0)).alias(_BEFORE))
    placed = rows.withColumn(_ID, F.row_number().over(local) - 1)
    return placed.join(offsets, [*group, *block]).withColumn(into, F.col(_ID) + F.col(_BEFORE)).drop(_ID, _BEFORE)
