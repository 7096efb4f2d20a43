"""What needs the rows of a group in order: values carried forward, and values at a rank. No task holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.operators.numbering import number_rows

#: Rows of a slice at least. Slices grow with the root of the table, and so do the slices' own rows.
SLICE = 1 << 16


def _slice(at: str, total: str) -> Column:
    return F.floor(F.col(at) / F.greatest(F.lit(SLICE), F.ceil(F.sqrt(total)))).cast("long")


def carry_forward(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, own: bool = True) -> DataFrame:
    """Add ``out``: the last ``value`` that isn't null, in the order given, among the rows of the same group up to this one.

    With ``own`` false the row itself doesn't count. Rows are numbered over all groups and cut into slices of numbers, so a slice is one
    task's work, whatever group it is of; the last value of each slice is carried into the slices after it, as one row a slice.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    said = F.when(value.isNotNull(), F.struct(group.alias("g"), value.alias("v")))
    rows = df.select(F.struct("*").alias("row"), group.alias("g"), said.alias("said"), F.struct(*order).alias("o"))
    rows = number_rows(rows, F.struct("g", "o"), "at", "n").withColumn("slice", _slice("at", "n"))
    inside = Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    ends = rows.where("said IS NOT NULL").groupBy("slice").agg(F.max_by("said", "at").alias("end"))
    whole = rows.select("slice").distinct().join(ends, "slice", "left")
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("slice", F.last("end", True).over(before).alias("carried"))
    rows = rows.withColumn("near", F.last("said", True).over(inside)).join(carried, "slice")
    last = F.coalesce("near", "carried")
    return rows.select("row.*", F.when(last["g"].eqNullSafe(F.col("g")), last["v"]).alias(out))


def values_at_ranks(df: DataFrame, col: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, a column for each name): the quantiles of a column's values that aren't null, interpolated as by ``percentile``.

    Values are numbered in order over all groups, groups are counted, and only the values whose numbers are wanted are joined on.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    rows = df.where(F.col(col).isNotNull()).select(group.alias("g"), F.col(col).cast("double").alias("v"))
    rows = number_rows(rows, F.struct("g", "v"), "at")
    groups = rows.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    place = lambda share: F.lit(share) * (F.col("n") - 1)
    wanted = []
    for name, share in shares.items():
        low = F.floor(place(share))
        wanted.append(F.struct(F.lit(name).alias("name"), (F.col("first") + low).alias("at"), (1 - (place(share) - low)).alias("w")))
        wanted.append(F.struct(F.lit(name).alias("name"), (F.col("first") + low + 1).alias("at"), (place(share) - low).alias("w")))
    found = groups.select("g", F.inline(F.array(*wanted))).where("w > 0").join(rows.select("at", "v"), "at")
    sums = [F.sum(F.when(F.col("name") == name, F.col("w") * F.col("v"))).alias(name) for name in shares]
    return found.groupBy("g").agg(*sums).select(*(F.col("g")[c].alias(c) for c in by), *shares)


def running_ranks(rows: DataFrame, col: str, by: list[str], step: str, steps: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(by, step, a column for each name): for each step the quantiles of all values of this and earlier steps of the group.

    ``rows`` has the step from which a value counts, ``steps`` (by, step) is a small table of all steps. Values are numbered in order once and cut
    into ranges of equal numbers of values; counts by range and step, added up over steps and ranges, tell the range of each wanted rank, and only
    that range's values are ranked for the step. Steps before a group's first value have none.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_one"))
    values = rows.where(F.col(col).isNotNull()).select(group.alias("g"), F.col(step).alias("s"), F.col(col).cast("double").alias("v"))
    values = number_rows(values, F.struct("g", "v"), "at", "n").withColumn("range", F.floor(F.col("at") / F.greatest(F.lit(256), F.ceil(F.sqrt("n")))).cast("long"))
    counts = values.groupBy("g", "range", "s").agg(F.count(F.lit(1)).alias("k"))
    every = steps.select(group.alias("g"), F.col(step).alias("t")).distinct()
    upto = every.join(counts, "g").where("s <= t").groupBy("g", "t", "range").agg(F.sum("k").alias("k"))
    over = Window.partitionBy("g", "t").orderBy("range")
    total = F.sum("k").over(Window.partitionBy("g", "t"))
    before = F.coalesce(F.sum("k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = upto.select("g", "t", "range", "k", before.alias("before"), total.alias("all"))
    wanted = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("all") - 1)
        low = F.floor(place)
        wanted += [F.struct(F.lit(name).alias("name"), (low + up).alias("rank"), ((place - low) if up else 1 - (place - low)).alias("w")) for up in (0, 1)]
    looked = ranges.select("g", "t", "range", "k", "before", F.inline(F.array(*wanted))).where("w > 0 AND rank >= before AND rank < before + k")
    places = looked.select("g", "t", "range", "before").distinct().join(values.select("g", "range", "s", "v", "at"), ["g", "range"]).where("s <= t")
    ranked = places.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("g", "t", "range").orderBy("at")) - 1)
    found = looked.drop("before", "k").join(ranked.select("g", "t", "range", "rank", "v"), ["g", "t", "range", "rank"])
    sums = [F.sum(F.when(F.col("name") == name, F.col("w") * F.col("v"))).alias(name) for name in shares]
    return found.groupBy("g", "t").agg(*sums).select(*(F.col("g")[c].alias(c) for c in by), F.col("t").alias(step), *shares)
