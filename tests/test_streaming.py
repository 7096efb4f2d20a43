"""Streams give what their batch twins give, in whatever order the parts arrive."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verity.sources import generator
from verity.streaming import stages

PARTS = {
    "answers": ("request_id long, generation string", [(1, "g")]),
    "claims": ("request_id long, claim_id int, claim string, last_claim boolean", [(1, 1, "d", True), (1, 0, "c", False)]),
    "questions": ("request_id long, claim_id int, question_id int, question string, last_question boolean", [(1, 0, 0, "x", True), (1, 1, 0, "y", True)]),
    "hits": ("request_id long, claim_id int, question_id int, doc array<struct<rank:int,doc_id:bigint,score:double>>", [(1, 0, 0, [(1, 5, 1.0)]), (1, 1, 0, [])]),
}


@pytest.mark.parametrize("order", [("answers", "claims", "questions", "hits"), ("hits", "questions", "claims", "answers")])
def test_response_in_any_order(spark, tmp_path, order):
    stages.use_state_store(spark)
    streams = {}
    for name, (schema, _) in PARTS.items():
        (tmp_path / name).mkdir()
        streams[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    out = stages.stream_response(*(streams[n] for n in ("answers", "claims", "questions", "hits")), timeout_ms=None)
    for name in order:
        schema, rows = PARTS[name]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        assert stages.run_stream(out, str(tmp_path / "out"), str(tmp_path / "state"))
    schema, rows = PARTS["answers"]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
    stages.run_stream(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("status").collect()
    assert [r["status"] for r in got] == ["complete", "late"]
    assert got[0]["payload"] == '{"generation": "g", "claims": [{"claim": "c", "questions": [{"question": "x", "doc": [{"rank": 1, "doc_id": 5, "score": 1.0}]}]}, {"claim": "d", "questions": [{"question": "y", "doc": []}]}]}'


def test_split_over_batches(spark, tmp_path):
    stages.use_state_store(spark)
    source = tmp_path / "in"
    source.mkdir()
    schema = "request_id long, text string, done boolean"
    out = stages.stream_split(spark.readStream.schema(schema).parquet(str(source)))
    for rows in ([(1, "a\nb", False), (2, "", False)], [(1, "a\nbc\n", False)], [(1, "a\nbc\n", True), (2, None, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stages.run_stream(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "a", False), (1, 1, "bc", True), (2, 0, "", True)]


def test_split_keeps_a_state_row_a_block(spark, tmp_path):
    """Texts of a request are split in one group, so calls to the state don't grow with their number; children are those of each text."""
    stages.use_state_store(spark)
    source, keys = tmp_path / "in", ["request_id", "claim_id", "question_id"]
    source.mkdir()
    schema = "request_id long, claim_id int, question_id int, text string, done boolean"
    out = stages.stream_split(spark.readStream.schema(schema).parquet(str(source)), keys, "pos", "word", "last_token", " \n")
    ids = [(r, c, q) for r in (-1, 1 << 60) for c in range(16) for q in range(-1, 4)]
    whole = {k: f'a"{k[1]} \\é{k[2]} b/\tc' if k[2] else "" for k in ids}
    for rows in ([(*k, t[:5], False) for k, t in whole.items()], [(*k, t, True) for k, t in whole.items()], [(*k, t + " later", True) for k, t in whole.items()]):
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(source))
        query = out.writeStream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    words = {k: t.split(" ") for k, t in whole.items()}
    assert got == sorted((*k, i, w, i == len(ws) - 1) for k, ws in words.items() for i, w in enumerate(ws))
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4  # question -1 is in a block of its own


def test_latency_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 0.5), (2, 1.5)], "request_id long, latency double").write.parquet(str(source))
    rows = spark.readStream.schema("request_id long, latency double").parquet(str(source))
    stages.stream_latency(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/stats")).first()["avg"] == 1.0


def test_unfinished_requests_time_out(spark, tmp_path):
    stages.use_state_store(spark)
    streams = {}
    for name, (schema, _) in PARTS.items():
        (tmp_path / name).mkdir()
        streams[name] = spark.readStream.schema(schema).parquet(str(tmp_path / name))
    out = stages.stream_response(*(streams[n] for n in ("answers", "claims", "questions", "hits")), timeout_ms=1)
    for number in (1, 2):
        spark.createDataFrame([(number, "g")], PARTS["answers"][0]).coalesce(1).write.mode("append").parquet(str(tmp_path / "answers"))
        stages.run_stream(out, str(tmp_path / "out"), str(tmp_path / "state"), timeout_s=20)  # timers keep it awake
    got = [(r["key"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert ("1", "incomplete") in got and "complete" not in {s for _, s in got}


def test_rendezvous_within_an_hour(spark, tmp_path):
    stages.use_state_store(spark)
    left = [(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 10:00:00", "b")]
    right = [(1, "2024-01-01 10:30:00", "x"), (2, "2024-01-01 12:30:00", "y")]
    streams = []
    for name, rows in (("left", left), ("right", right)):
        spark.createDataFrame(rows, f"k long, at string, {name} string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(f"k long, at timestamp, {name} string").parquet(str(tmp_path / name)))
    stages.run_stream(stages.stream_rendezvous(*streams, ["k"], "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [(r["k"], r["left"], r["right"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "a", "x")]


def test_latency_batches_count_once(spark, tmp_path):
    schema = "request_id long, latency double"
    source = tmp_path / "in"
    for value in (1.0, 3.0):
        spark.createDataFrame([(1, value)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stages.stream_latency(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    # a batch that is tried again leaves what it left before
    (tmp_path / "state/commits/1").unlink()
    (tmp_path / "state/commits/.1.crc").unlink(missing_ok=True)
    stages.stream_latency(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    stats = {r["batch"]: (r["avg"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out/stats")).collect()}
    assert stats == {0: (1.0, 1), 1: (2.0, 2)}


def test_running_quantiles_stay_near(spark, tmp_path):
    rng = random.Random(3)
    schema = "request_id long, latency double"
    source, seen = tmp_path / "in", []
    for n in (700, 1, 400):
        values = [rng.choice([rng.lognormvariate(0, 2), -rng.random(), 0.0]) for _ in range(n)]
        seen += values
        spark.createDataFrame([*enumerate(values), (9, None)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stages.stream_latency(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        last = spark.read.parquet(str(tmp_path / "out/stats")).orderBy(F.desc("batch")).first()
        assert last["count"] == len(seen) and last["avg"] == pytest.approx(sum(seen) / len(seen))
        for name, share in (("median", 0.5), ("p99", 0.99)):
            value = sorted(seen)[int(share * (len(seen) - 1))]
            assert last[name] == pytest.approx(value, rel=0.0051, abs=1e-12)
    assert spark.read.parquet(str(tmp_path / "out/state")).count() < 3 * 1100


class Held:
    """A state that counts how often its parts are read."""

    def __init__(self):
        self.values, self.reads = {}, 0

    def exists(self):
        return bool(self.values)

    def containsKey(self, key):
        return key in self.values

    def updateValue(self, key, value):
        self.values[key] = value

    def get(self):
        return self.values[()]

    def update(self, value):
        self.values[()] = value

    def clear(self):
        self.values = {}

    def iterator(self):
        self.reads += 1
        return iter(list(self.values.items()))


def test_parts_are_read_once(spark):
    """Thousands of parts in many batches, some twice, some stray: read when all are there, not at each arrival."""
    one = stages.Collector(stages.RESPONSE)
    one.parts, one.counted, one.sent = Held(), Held(), Held()
    one.handle = type("Handle", (), {"registerTimer": lambda self, at: None})()
    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    parts = [("answer", "", {"generation": "g"})]
    for c in range(20):
        parts.append(("claim", f"{c}", {"claim_id": c, "claim": f"c{c}", "last_claim": c == 19}))
        for q in range(30):
            parts.append(("question", f"{c}/{q}", {"claim_id": c, "question_id": q, "question": "x", "last_question": q == 29}))
            parts.append(("hits", f"{c}/{q}", {"claim_id": c, "question_id": q, "doc": []}))
    random.Random(1).shuffle(parts)
    part = lambda p: type("Part", (), {"tag": p[0], "part": p[1], "payload": json.dumps(p[2])})()
    out = []
    for k in range(0, len(parts), 3):
        out += one.handleInputRows(("r",), [part(p) for p in (*parts[k : k + 3], parts[k])], clock)
    assert [r.status for r in out] == ["complete"] and one.parts.reads == 1 and not one.parts.exists()
    claims = json.loads(out[0].payload)["claims"]
    assert len(claims) == 20 and all(len(c["questions"]) == 30 for c in claims)
    assert [r.status for r in one.handleInputRows(("r",), [part(parts[0])], clock)] == ["late"]


def test_generated_stream_goes_on_after_a_restart(spark, tmp_path):
    there = tmp_path / "blocks"

    def blocks(k):
        return [(k, 10 * k + j) for j in range(3)]

    def available():
        return int(there.read_text())

    generator.register_generator(spark, "blocks_of_three", blocks, "k int, v int", 2, available)
    assert spark.read.format("blocks_of_three").load().count() == 6
    for n in (2, 2, 5):
        there.write_text(str(n))
        rows = spark.readStream.format("blocks_of_three").load()
        assert stages.run_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"), timeout_s=60)
        got = sorted(r["v"] for r in spark.read.schema("k int, v int").parquet(str(tmp_path / "out")).collect())
        assert got == [10 * k + j for k in range(n) for j in range(3)]


def test_parts_of_one_batch_cost_no_calls_for_each():
    """A key whose parts come together leaves only its mark; in two batches each part is stored once, the last payload counts, and later parts are late."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.kept = name, {}

        def __getattr__(self, call):
            def made(*args):
                calls.append((self.name, call))
                of = {"exists": lambda: bool(self.kept), "get": lambda: self.kept.get(0), "update": lambda v: self.kept.update({0: v}), "clear": self.kept.clear, "containsKey": lambda k: k in self.kept, "updateValue": lambda k, v: self.kept.update({k: v}), "iterator": lambda: iter(list(self.kept.items()))}
                return of[call](*args)

            return made

    class Handle:
        getMapState = getValueState = lambda self, name, *_: State(name)

    class Part:
        def __init__(self, pos, word, last):
            self.tag, self.part, self.payload = "token", str(pos), json.dumps({"pos": pos, "word": word, "last_token": last})

    def run(*batches):
        one = stages.Collector(stages.WORDS)
        one.init(Handle())
        calls.clear()
        return [[(r.status, r.payload) for r in one.handleInputRows(("k",), iter(rows), None)] for rows in batches]

    words = [Part(k, f"w{k}", k == 49) for k in range(50)]
    want = " ".join(f"w{k}" for k in range(50))
    assert run(words) == [[("complete", want)]] and len(calls) <= 4
    assert run(words[:30] + [Part(29, "new", False)], words[25:], words[:1]) == [[], [("complete", want)], [("late", words[0].payload)]]
    assert sum(c == ("parts", "updateValue") for c in calls) == 30
