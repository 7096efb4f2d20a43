"""Numbers for the rows of a table, in order and without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.sources.scratch import stored

#: Places of the row's number within its partition in ``monotonically_increasing_id``.
BITS = 33


def number_rows(df: DataFrame, order: Column | str | None = None, out: str = "row_id", total: str | None = None) -> DataFrame:
    """Add ``out``: 0, 1, .. in the order of a column (nulls first), equal ones in the order of the input, or all in that order.

    Rows are dealt out by ranges of (order, place in the input), so a frequent value is spread over tasks too, and then
    written with their partition and place before anything is counted: ranges are sampled once, and a second reading can't
    see others. The partitions' counts, a row each, are summed and joined on. No task holds all rows. ``total`` names a column
    for the number of all rows. All other columns stay, whatever their names; columns of the new names are replaced. Runs when called.
    """
    row = F.struct("*").alias("row")
    if order is None:
        dealt = df.select(row)
    else:
        by = F.col(order) if isinstance(order, str) else order
        dealt = df.select(row, by.alias("by"), F.monotonically_increasing_id().alias("tie")).repartitionByRange("by", "tie").sortWithinPartitions("by", "tie")
    rows = stored(dealt.select("row", F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", BITS))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(every).alias("all"))
    number = (F.col("start") + F.col("at").bitwiseAND((1 << BITS) - 1)).cast("long")
    added = [number.alias(out), *([F.col("all").alias(total)] if total else [])]
    keep = [F.col("row")[c].alias(c) for c in df.columns if c not in (out, total)]
    return rows.join(F.broadcast(starts), "part").select(*keep, *added)
