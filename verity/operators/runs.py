"""Analysis of client run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.operators.ordered import carry_forward

RUN = "run_file"


def _pick(log: DataFrame, where: Column, by: list[str], last: bool = False) -> DataFrame:
    """The first or last row of each run for which ``where`` holds."""
    row = F.struct(*(c for c in log.columns if c not in by))
    best = (F.max_by if last else F.min_by)(row, "time")
    return log.where(where).groupBy(*by).agg(best.alias("_row")).select(*by, "_row.*")


def first_active(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    return _pick(log, F.col("num_responses_recv") > 0, by or [RUN])


def last_increase(log: DataFrame, col: str = "num_requests_sent", by: list[str] | None = None) -> DataFrame:
    """The last row whose count is above 0 and above all earlier ones."""
    by = by or [RUN]
    before = F.max(col).over(Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, -1))
    rising = log.withColumn("_before", F.coalesce(before, F.lit(0)))
    return _pick(rising, F.col(col) > F.col("_before"), by, last=True).drop("_before")


def entry_at_or_after(log: DataFrame, t: Column | float, by: list[str] | None = None) -> DataFrame:
    """One entry of each run, for one time (a number, or a column of the log)."""
    return _pick(log, F.col("time") >= (t if isinstance(t, Column) else F.lit(t)), by or [RUN])


def entry_at_or_before(log: DataFrame, t: Column | float, by: list[str] | None = None) -> DataFrame:
    return _pick(log, F.col("time") <= (t if isinstance(t, Column) else F.lit(t)), by or [RUN], last=True)


def entries_at(log: DataFrame, times: DataFrame, by: list[str] | None = None, after: bool = False) -> DataFrame:
    """The log entry at or before (or ``after``) each of any number of times: times(by, at, ..) and the log's other columns.

    Entries and times are put in one order and the last entry is carried to the times that follow, in one sort for all. Times
    without an entry keep nulls. Equal times get each an entry; a run has one entry at a time.
    """
    by = by or [RUN]
    rest = [c for c in log.columns if c not in by]
    sign = -1 if after else 1
    entry = F.struct(*rest)
    asked = times.select(*by, F.struct("*").alias("_asked"), F.lit(None).cast(log.select(entry.alias("e")).schema["e"].dataType).alias("_entry"), (sign * F.col("at")).alias("_at"))
    told = log.select(*by, F.lit(None).cast(times.select(F.struct("*").alias("a")).schema["a"].dataType).alias("_asked"), entry.alias("_entry"), (sign * F.col("time")).alias("_at"))
    order = [F.col("_at").alias("a"), F.col("_asked").isNotNull().alias("b")]
    found = carry_forward(told.unionByName(asked), by, order, F.col("_entry"), "_found").where("_asked IS NOT NULL")
    return found.select("_asked.*", "_found.*")


def run_stats(log: DataFrame, start_offset: float = 0, end_offset: float = 0, test_length: float | None = None, start_nonzero: bool = True, end_increase: bool = True) -> DataFrame:
    """Start, end, latencies, achieved rate and throughput of each run; all runs at once.

    The start is the first row with responses (or the first), moved on by ``start_offset``; the end is the last
    increase, or the first row ``test_length`` after the start, or the last row; a negative ``end_offset`` moves it
    back.
    """
    if test_length is not None and (end_increase or end_offset):
        raise ValueError("test_length goes with neither end_increase nor end_offset")
    always = F.lit(True)
    start = first_active(log) if start_nonzero else _pick(log, always, [RUN])
    moved = lambda rows, by, name: rows.select(RUN, (F.col("time") + by).alias("at"), F.lit(name).alias("_of"))
    found = lambda rows, name: rows.where((F.col("_of") == name) & F.col("time").isNotNull()).drop("at", "_of")
    end = None if test_length is not None else last_increase(log) if end_increase else _pick(log, always, [RUN], last=True)
    if start_offset:
        start = found(entries_at(log, moved(start, start_offset, "start"), after=True), "start")
    if test_length is not None:
        end = found(entries_at(log, moved(start, test_length, "end"), after=True), "end")
    elif end_offset:
        end = found(entries_at(log, moved(end, end_offset, "end")), "end")
    both = start.select(RUN, *(F.col(c).alias(f"_{c}") for c in ("time", "num_requests_sent", "num_responses_recv"))).join(end, RUN)
    took = F.col("time") - F.col("_time")
    rate = lambda c: F.when(took != 0, (F.col(c) - F.col(f"_{c}")) / took)
    return both.select(
        RUN, F.col("_time").alias("start_time"), F.col("time").alias("end_time"), took.alias("time_length"),
        F.col("avg_latency").alias("latency_avg"), F.col("median_latency").alias("latency_median"), F.col("p99_latency").alias("latency_p99"),
        rate("num_requests_sent").alias("achieved_rate"), rate("num_responses_recv").alias("throughput_avg"),
    )
