"""Global row numbers, and what needs them, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.columns import named
from pagesift.sources.staging import stage

_IN_PARTITION = 33  # monotonically_increasing_id keeps the row index in its low 33 bits
_BLOCK = 1 << 16


def with_row_number(
    df: DataFrame, order_by: Sequence[str], name: str = "row_no"
) -> DataFrame:
    """Adds 1..N in the order of ``order_by``, which must identify a row.

    ``df`` is read twice, to sample its order and to sort it, so pass a table.
    The rows are range-partitioned and sorted once and written with their place in
    their partition. The number of rows per partition then gives each partition its
    offset; that table has one row per shuffle partition, so it is broadcast and
    its running sum needs one task only.
    """
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    rows = stage(placed, "numbered")
    part = F.shiftright("_place", _IN_PARTITION)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_place").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select((F.col("_offset") + place + 1).alias(name), *named(df.columns))
    )


def mark_page_breaks(numbered: DataFrame, row_no: str = "row_no") -> DataFrame:
    """Adds ``is_break``: the row's URL differs from that of the row before it.

    Neighbours are compared within blocks of 65,536 row numbers. The last row of a
    block is sent to the next block too, as the neighbour of that block's first row.
    """
    block = F.floor((F.col(row_no) - 1) / _BLOCK).cast("long")
    is_last = (F.col(row_no) % _BLOCK) == 0
    homes = F.when(is_last, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_block", F.explode(homes))
    previous = F.lag("url").over(W.partitionBy("_block").orderBy(row_no))
    marked = spread.withColumn("_previous", previous).where(F.col("_block") == block)
    is_break = (F.col("_previous") != "") & (F.col("_previous") != F.col("url"))
    return marked.select(
        *named(numbered.columns), F.coalesce(is_break, F.lit(False)).alias("is_break")
    )
