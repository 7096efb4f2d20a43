"""Statistics over requests, stages and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verity.operators.ordered import carry_forward, running_ranks, values_at_ranks


def request_latency(sent: DataFrame, recv: DataFrame, strict: bool = False) -> DataFrame:
    """(request_id, sent_time, recv_time, latency) of answered requests. ``strict`` raises on unknown responses."""
    if strict and not orphans(sent, recv).isEmpty():
        raise ValueError("there are responses to unknown requests")
    return sent.join(recv, "request_id").select("request_id", "sent_time", "recv_time", (F.col("recv_time") - F.col("sent_time")).alias("latency"))


def unfinished(sent: DataFrame, recv: DataFrame, now: Column | float | None = None) -> DataFrame:
    """Requests without a response; with ``now`` also how long they have waited."""
    left = sent.join(recv.select("request_id"), "request_id", "left_anti")
    return left if now is None else left.withColumn("waited", (now if isinstance(now, Column) else F.lit(now)) - F.col("sent_time"))


def orphans(sent: DataFrame, recv: DataFrame) -> DataFrame:
    return recv.join(sent.select("request_id"), "request_id", "left_anti")


def sent_minus_received(sent: DataFrame, recv: DataFrame) -> DataFrame:
    return sent.select("request_id").subtract(recv.select("request_id"))


def all_received(sent: DataFrame, recv: DataFrame) -> DataFrame:
    """One row: distinct ids sent, received, and whether the numbers are equal."""
    one = lambda df, name: df.agg(F.countDistinct("request_id").alias(name))
    return one(sent, "n_sent").crossJoin(F.broadcast(one(recv, "n_recv"))).withColumn("all_received", F.col("n_sent") == F.col("n_recv"))


def _same(a: str, b: str, cols: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols] or [F.lit(True)]


def summary_stats(df: DataFrame, col: str, by: list[str] | None = None, approx: bool = False, high: float = 0.99) -> DataFrame:
    """Mean, median, high percentile and count; null where there is nothing.

    Exact ones are found by rank, so no task holds a group's values; ``approx`` takes one pass, and values off by a ten-thousandth of the ranks.
    """
    by = by or []
    name = f"p{round(high * 100)}"
    plain = [F.avg(col).alias("avg"), F.count(col).alias("count")]
    if approx:
        quantile = lambda q: F.percentile_approx(col, F.lit(q), F.lit(10_000))
        return df.groupBy(*by).agg(plain[0], quantile(0.5).alias("median"), quantile(high).alias(name), plain[1])
    ranks = values_at_ranks(df, col, by, {"median": 0.5, name: high})
    sums = df.groupBy(*by).agg(*plain)
    return sums.alias("a").join(ranks.alias("b"), _same("a", "b", by), "left").select(*(f"a.{c}" for c in by), "avg", "median", name, "count")


def latency_benchmark(runs: DataFrame, col: str = "latency", by: list[str] | None = None) -> DataFrame:
    return summary_stats(runs, col, by, high=0.95)


def _first_tick(rows: DataFrame, ticks: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Add _tick, the first tick at or after a row's time; rows after the last tick drop out. Ticks are broadcast."""
    lists = ticks.groupBy(*by).agg(F.sort_array(F.collect_set("time")).alias("_ticks"))
    own = rows.alias("a").join(F.broadcast(lists).alias("b"), _same("a", "b", by)).select("a.*", F.array_min(F.filter("_ticks", lambda t: t >= F.col(time))).alias("_tick"))
    return own.where("_tick IS NOT NULL")


def latency_snapshots(sent: DataFrame, recv: DataFrame, ticks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a client log would hold at each tick: counts, last times and statistics of all that came before.

    ``ticks`` (by, time) is a small table, as ticks are few beside events. An event counts at its first tick; what a tick adds is summed
    once and carried on by running totals, and quantiles by counts of value ranges.
    """
    by = by or []
    marks = [*by, "time"]
    ticks = ticks.select(*marks).distinct()
    answered = recv.join(sent.select("request_id", "sent_time"), "request_id").withColumn("latency", F.col("recv_time") - F.col("sent_time"))
    out = _first_tick(sent, ticks, "sent_time", by).groupBy(*by, "_tick").agg(F.count("request_id").alias("n"), F.max("sent_time").alias("last"))
    came = _first_tick(answered, ticks, "recv_time", by)
    got = came.groupBy(*by, "_tick").agg(F.count("request_id").alias("n"), F.max("recv_time").alias("last"), F.sum("latency").alias("sum"), F.count("latency").alias("values"))
    running = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def at_ticks(sums: DataFrame) -> DataFrame:
        return ticks.alias("a").join(sums.withColumnRenamed("_tick", "time").alias("b"), _same("a", "b", marks), "left").select(*(f"a.{c}" for c in marks), *(f"b.{c}" for c in sums.columns if c not in (*by, "_tick")))

    total = lambda c: F.coalesce(F.sum(c).over(running), F.lit(0))
    sums = at_ticks(out).select(*marks, total("n").alias("num_requests_sent"), F.max("last").over(running).alias("last_request_sent_time"))
    more = at_ticks(got).select(*marks, total("n").alias("num_responses_recv"), F.max("last").over(running).alias("last_response_recv_time"), (F.sum("sum").over(running) / F.sum("values").over(running)).alias("avg_latency"))
    steps = ticks.withColumnRenamed("time", "_tick")
    ranks = running_ranks(came, "latency", by, "_tick", steps, {"median_latency": 0.5, "p99_latency": 0.99}).withColumnRenamed("_tick", "time")
    both = sums.alias("a").join(more.alias("b"), _same("a", "b", marks)).select("a.*", "num_responses_recv", "last_response_recv_time", "avg_latency")
    return both.alias("a").join(ranks.alias("b"), _same("a", "b", marks), "left").select("a.*", "median_latency", "p99_latency")


def stage_fanout(ins: DataFrame, outs: DataFrame, by: list[str]) -> DataFrame:
    """For each stage key: time from its input to the first and the last output, and the number of outputs.

    ins(by, in_time), outs(by, out_time).
    """
    out = outs.groupBy(*by).agg(F.min("out_time").alias("_first"), F.max("out_time").alias("_last"), F.count(F.lit(1)).alias("num_out"))
    first = F.col("_first") - F.col("in_time")
    return ins.join(out, by).select(*by, first.alias("min_latency"), (F.col("_last") - F.col("in_time")).alias("max_latency"), "num_out")


def edge_latency(messages: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of receive less send time for each edge."""
    return summary_stats(messages.withColumn("_took", F.col("recv_time") - F.col("sent_time")), "_took", by)


def trailing_throughput(df: DataFrame, time: str, count: str, window: float, by: list[str]) -> DataFrame:
    """Change of a running count over time, back to the nearest row at least ``window`` old, or else the oldest.

    Each row asks at its time less the window; askers and rows are put in one order, and the last row is carried to the asker.
    """
    entry = F.struct(F.col(time).alias("t"), F.col(count).alias("c"))
    rows = df.select(F.struct("*").alias("_row"), *by, entry.alias("_entry"), F.col(time).alias("_at"), F.lit(0).alias("_asks"))
    both = rows.unionByName(rows.withColumns({"_at": F.col("_at") - window, "_asks": F.lit(1)}))
    order = [F.col("_at").alias("a"), F.col("_asks").alias("b"), F.col("_entry").alias("c")]
    found = carry_forward(both, by, order, F.when(F.col("_asks") == 0, F.col("_entry")), "_old").where("_asks = 1")
    first = rows.groupBy(*by).agg(F.min("_entry").alias("_first"))
    found = found.alias("a").join(first.alias("b"), _same("a", "b", by)).select("_row", "_entry", F.coalesce("_old", "_first").alias("_old"))
    took = F.col("_entry.t") - F.col("_old.t")
    return found.select("_row.*", F.when(took > 0, (F.col("_entry.c") - F.col("_old.c")) / took).alias("throughput"))


def arrival_gaps(df: DataFrame, time: str, by: list[str]) -> DataFrame:
    """Rate and variation of the gaps between arrivals: the variation is near 1 for Poisson arrivals, 0 for even ones."""
    rows = df.select(*by, F.col(time).alias("_time"))
    gaps = carry_forward(rows, by, [F.col("_time")], F.col("_time"), "_before", own=False).withColumn("_gap", F.col("_time") - F.col("_before"))
    return gaps.groupBy(*by).agg(F.count("_gap").alias("gaps"), F.avg("_gap").alias("mean_gap"), (1 / F.avg("_gap")).alias("rate"), (F.stddev_pop("_gap") / F.avg("_gap")).alias("cv"))


def key_bucket(df: DataFrame, n: int, keys: list[str] | None = None, out: str = "bucket", hashed: bool = True) -> DataFrame:
    """Bucket of each row: by hash of its keys (or by the remainder of one integer key), or else in turn.

    Rows without keys are taken in turn within each partition of the input, so no task sees them all.
    """
    if keys and not hashed:
        return df.withColumn(out, F.pmod(F.col(keys[0]), F.lit(n)).cast("int"))
    if keys:
        return df.withColumn(out, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    return df.withColumn(out, F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))


def bucket_load(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rows of each bucket, and their ratio to the mean; buckets are few."""
    load = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("items"))
    mean = load.agg(F.avg("items").alias("_mean"))
    return load.crossJoin(F.broadcast(mean)).select(bucket, "items", (F.col("items") / F.col("_mean")).alias("skew"))
