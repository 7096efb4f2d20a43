"""Carried values, ranks and running ranks against plain Python, with slices of a few rows and one hot group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from verity.operators import latency, ordered, runs


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(ordered, "SLICE", 7)


def data(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        g = rng.choice(["hot", "hot", "hot", "a", "b", None, f"g{rng.randrange(40)}"])
        rows.append((k, g, rng.choice([rng.uniform(0, 9), float(rng.randint(0, 3))]), rng.choice([None, rng.randint(0, 9)]), "x"))
    return rows


def quantile(values, share):
    values = sorted(values)
    place = share * (len(values) - 1)
    low = math.floor(place)
    return values[low] + (place - low) * (values[min(low + 1, len(values) - 1)] - values[low])


@pytest.mark.parametrize("own", [True, False])
def test_carry_forward(spark, own):
    rows = data(1)
    df = spark.createDataFrame(rows, "k int, g string, t double, v int, slice string").repartition(5)
    got = {r["k"]: r["last"] for r in ordered.carry_forward(df, ["g"], [F.col("t"), F.col("k")], F.col("v"), "last", own).collect()}
    last, want = {}, {}
    for k, g, _, v, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if own and v is not None:
            last[g] = v
        want[k] = last.get(g)
        if v is not None:
            last[g] = v
    assert got == want
    assert ordered.carry_forward(df.where("false"), ["g"], [F.col("t")], F.col("v"), "last").count() == 0


def test_values_at_ranks(spark):
    rows = data(2)
    df = spark.createDataFrame(rows, "k int, g string, t double, v int, x string").withColumn("t", F.when(F.col("k") % 11 != 0, F.col("t")))
    got = {r["g"]: (r["m"], r["h"], r["all"]) for r in ordered.values_at_ranks(df, "t", ["g"], {"m": 0.5, "h": 0.99, "all": 1.0}).collect()}
    kept = {}
    for k, g, t, _, _ in rows:
        if k % 11:
            kept.setdefault(g, []).append(t)
    assert got.keys() == kept.keys()
    for g, values in kept.items():
        assert got[g] == pytest.approx((quantile(values, 0.5), quantile(values, 0.99), max(values)))
    stats = {r["g"]: tuple(r) for r in latency.summary_stats(df, "t", ["g"]).collect()}
    assert stats["hot"] == pytest.approx(("hot", sum(kept["hot"]) / len(kept["hot"]), quantile(kept["hot"], 0.5), quantile(kept["hot"], 0.99), len(kept["hot"])))
    assert stats[None][4] == len(kept[None])
    none = latency.summary_stats(spark.createDataFrame([("a", None)], "g string, t double"), "t", ["g"]).first()
    assert tuple(none) == ("a", None, None, None, 0)


def test_running_ranks(spark):
    rows = data(3, 3000)
    df = spark.createDataFrame([(k % 9, g, t) for k, g, t, _, _ in rows], "s int, g string, t double")
    steps = df.select("g").distinct().crossJoin(spark.range(10).select(F.col("id").cast("int").alias("s")))
    got = {(r["g"], r["s"]): (r["m"], r["h"]) for r in ordered.running_ranks(df, "t", ["g"], "s", steps, {"m": 0.5, "h": 0.99}).collect()}
    for g in {r[1] for r in rows}:
        for s in range(10):
            values = [t for k, h, t, _, _ in rows if h == g and k % 9 <= s]
            assert (g, s) in got if values else (g, s) not in got
            if values:
                assert got[g, s] == pytest.approx((quantile(values, 0.5), quantile(values, 0.99)))


def test_trailing_throughput_and_gaps(spark):
    rng = random.Random(4)
    rows, n = [], {}
    for k in range(600):
        g = rng.choice(["hot", "hot", "a"])
        n[g] = n.get(g, 0) + 1
        rows.append((k, g, k * 3 + rng.randrange(3), n[g]))
    df = spark.createDataFrame(rows, "k int, g string, t long, n long").repartition(4)
    got = {r["k"]: r["throughput"] for r in latency.trailing_throughput(df, "t", "n", 50, ["g"]).collect()}
    for k, g, t, c in rows:
        own = [(x[2], x[3]) for x in rows if x[1] == g]
        old = max((x for x in own if x[0] <= t - 50), default=own[0])
        assert got[k] == (pytest.approx((c - old[1]) / (t - old[0])) if t > old[0] else None)
    gaps = {r["g"]: r for r in latency.arrival_gaps(df, "t", ["g"]).collect()}
    for g in ("hot", "a"):
        times = [x[2] for x in rows if x[1] == g]
        steps = [b - a for a, b in zip(times, times[1:], strict=False)]
        assert gaps[g]["gaps"] == len(steps) and gaps[g]["mean_gap"] == pytest.approx(sum(steps) / len(steps))


def test_entries_at_many_times(spark):
    rng = random.Random(5)
    log = [(f"r{k % 3}", float(k // 3 * 10), k) for k in range(120)]
    times = [(f"r{rng.randrange(4)}", float(rng.randrange(-20, 500)), k, "x") for k in range(300)] + [("r1", 50.0, 300, "x")] * 2
    left = spark.createDataFrame(log, "run_file string, time double, n int")
    asked = spark.createDataFrame(times, "run_file string, at double, id int, note string")
    for after in (False, True):
        got = sorted((r["id"], r["time"], r["n"]) for r in runs.entries_at(left, asked, after=after).collect() if r["time"] is not None)
        want = []
        for f, at, i, _ in times:
            own = [(t, n) for g, t, n in log if g == f and (t >= at if after else t <= at)]
            if own:
                want.append((i, *(min(own) if after else max(own))))
        assert got == sorted(want)
    assert runs.entries_at(left, asked).columns == ["run_file", "at", "id", "note", "time", "n"]
