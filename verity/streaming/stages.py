"""Stateful stages as structured streams; each gives what its batch twin gives, in whatever order rows arrive."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verity.operators.index import Index
from verity.operators.search import search

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HIT = "struct<rank:int,doc_id:bigint,score:double>"


def use_state_store(spark: SparkSession) -> None:
    """The state store that these stages need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Bits by which the last two keys of a text may differ from those of others in its block, where nothing else is asked for.
IN_BLOCK = 4


class Splitter(StatefulProcessor):
    """Complete pieces of growing snapshots, each once; the rest, or a blank child, when the text is done.

    One child is held back until the next is known, so that the last one is marked. Rows are (block, part: JSON of [keys, text, done]); a block is
    a bounded number of keys. State: by keys the length of what has been taken, the next id, the child held back, and whether the text is done. So a block
    costs two calls to the state and a row out, whatever keys it has: a call costs Spark's Python worker more than the splitting of many texts.
    """

    def __init__(self, separators: str):
        self.separators = separators

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "held string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came: dict[str, list[tuple[str, bool]]] = {}
        for row in rows:
            keys, text, done = json.loads(row.part)
            came.setdefault(keys, []).append((text or "", done == "true"))
        found = self.state.get()
        held = json.loads(found[0]) if found else {}
        out = []
        for keys, texts in came.items():
            first = held[keys][1] if keys in held else 0
            held[keys], pieces = self.taken(texts, *held.get(keys, (0, 0, None, False)))
            if pieces:
                out.append({"keys": keys, "first": first, "pieces": pieces, "done": held[keys][3]})
        self.state.update((json.dumps(held, ensure_ascii=False),))
        return iter([Row(made=json.dumps(out, ensure_ascii=False))] if out else [])

    def taken(self, texts: list[tuple[str, bool]], taken: int, number: int, held: str | None, done: bool) -> tuple[tuple, list[str]]:
        """What is kept of a text from now on, and its new children; of a text that was done before there are none."""
        if done:
            return (taken, number, None, True), []
        pieces = [] if held is None else [held]
        for text, last in sorted(texts, key=lambda x: (len(x[0]), x[1])):
            if done or len(text) < taken:
                continue
            rest = text[taken:]
            cut = len(rest) if last else max(rest.rfind(c) for c in self.separators) + 1
            pieces += [piece for piece in re.split(f"[{re.escape(self.separators)}]", rest[:cut]) if piece]
            taken, done = taken + cut, last
        if done:
            pieces = pieces or [""]
            held = None
        else:
            held = pieces.pop() if pieces else None
        return (taken, number + len(pieces), held, done), pieces

    def close(self) -> None: ...


def stream_split(snapshots: DataFrame, keys: list[str] | None = None, id_col: str = "claim_id", value_col: str = "claim", last_col: str = "last_claim", separators: str = "\n", bits: dict[str, int] | None = None) -> DataFrame:
    """snapshots(keys, text, done) to children; a text must be cleaned on the left already, as it grows. Null texts are empty.

    By default answers to claims; claims to questions and questions to words (``separators`` " \\n") with other names. Texts are grouped by
    their keys less the last ``bits`` of each; by default ``IN_BLOCK`` of the last two, if they are whole numbers, so a block has 256 texts at most. Where ids have
    gaps, more bits make blocks that are worth their calls to the state; a block is written again whenever one of its texts grows.
    """
    keys = keys or ["request_id"]
    own = T.StructType([snapshots.schema[k] for k in keys])
    if bits is None:
        bits = {k: IN_BLOCK for k in keys[-2:] if isinstance(own[k].dataType, T.IntegerType | T.LongType)}
    block = F.to_json(F.struct(*(F.shiftright(k, bits[k]).alias(k) if k in bits else F.col(k) for k in keys)))
    part = F.to_json(F.array(F.to_json(F.struct(*keys)), F.col("text"), F.col("done").cast("string")))
    made = snapshots.select(block.alias("block"), part.alias("part")).groupBy("block").transformWithState(Splitter(separators), "made string", "Append", "None")
    rows = made.select(F.inline(F.from_json("made", "array<struct<keys:string,first:int,pieces:array<string>,done:boolean>>")))
    rows = rows.select(F.from_json("keys", own).alias("_keys"), "first", "done", F.size("pieces").alias("_n"), F.posexplode("pieces").alias("_at", "_piece"))
    last = F.col("done") & (F.col("_at") == F.col("_n") - 1)
    return rows.select(*(F.col("_keys")[k].alias(k) for k in keys), (F.col("first") + F.col("_at")).alias(id_col), F.col("_piece").alias(value_col), last.alias(last_col))


class Parts:
    """What a key waits for: ``counts`` gives what a part adds to named counters, ``full`` tells from the counters that all
    may be there, and ``build`` makes the payload from {tag: {part id: payload}}, or None if it isn't after all."""

    def __init__(self, counts: Callable[[str, dict], dict[str, int]], full: Callable[[dict], bool], build: Callable[[dict], str | None]):
        self.counts, self.full, self.build = counts, full, build


#: How long unready parts are kept where a stream runs on and nothing else is asked for.
KEEP_MS = 24 * 3_600_000


class Collector(StatefulProcessor):
    """Keeps the parts of a key until all have arrived, emits once, and drops them; later parts are ``late``.

    A part that arrives is counted, and stored if more are to come; parts are read again only when the counters say that all are there, so each
    costs the same however many came before, and a key whose parts come in one batch costs as many calls to the state whatever their number. With ``timeout_ms`` an unready key is emitted as ``incomplete`` then, and the mark
    of a key that was sent is forgotten ``keep_ms`` after (by default ten times as long), so the state is bounded by what
    came of late.
    """

    def __init__(self, parts: Parts, timeout_ms: int | None = None, keep_ms: int | None = None):
        self.spec, self.timeout_ms = parts, timeout_ms
        self.keep_ms = keep_ms or (10 * timeout_ms if timeout_ms else None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "tag string, part string", "payload string")
        self.counted = handle.getValueState("counted", "counters string")
        self.sent = handle.getValueState("sent", "status string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.sent.exists():
            return iter([Row(key=key[0], status="late", payload=row.payload) for row in rows])
        counted = self.counted.exists()
        counters = json.loads(self.counted.get()[0]) if counted else {}
        came: dict[tuple[str, str], str] = {}
        for row in rows:
            part = (row.tag, row.part)
            if part not in came and not (counted and self.parts.containsKey(part)):
                for name, n in self.spec.counts(row.tag, json.loads(row.payload)).items():
                    counters[name] = counters.get(name, 0) + n
            came[part] = row.payload
        payload = None
        if self.spec.full(counters):
            found: dict[str, dict[str, str]] = {}
            for (tag, part), (value,) in self.parts.iterator() if counted else ():
                found.setdefault(tag, {})[part] = value
            for (tag, part), value in came.items():
                found.setdefault(tag, {})[part] = value
            payload = self.spec.build(found)
        if payload is None:
            for part, value in came.items():
                self.parts.updateValue(part, (value,))
            self.counted.update((json.dumps(counters),))
            if not counted and self.timeout_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            return iter(())
        self._spend("complete", counted)
        return iter([Row(key=key[0], status="complete", payload=payload)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.sent.exists():
            return iter(())
        held = {f"{tag}/{part}": payload for (tag, part), (payload,) in self.parts.iterator()}
        self._spend("incomplete")
        return iter([Row(key=key[0], status="incomplete", payload=json.dumps(held, sort_keys=True))])

    def _spend(self, status: str, stored: bool = True) -> None:
        if stored:
            self.parts.clear()
            self.counted.clear()
        self.sent.update((status,))

    def close(self) -> None: ...


def collect_parts(parts: DataFrame, spec: Parts, timeout_ms: int | None = KEEP_MS) -> DataFrame:
    """parts(key, tag, part, payload: JSON) to (key, status, payload).

    ``timeout_ms`` None keeps state without bound, for streams that end; with timers a stream goes on till it is stopped.
    """
    return parts.groupBy("key").transformWithState(Collector(spec, timeout_ms), "key string, status string, payload string", "Append", "ProcessingTime" if timeout_ms else "None")


def _tagged(df: DataFrame, key: list[str], tag: str, part: list[str]) -> DataFrame:
    payload = F.to_json(F.struct(*df.columns))
    return df.select(F.concat_ws("/", *key).alias("key"), F.lit(tag).alias("tag"), F.concat_ws("/", *part).alias("part") if part else F.lit("").alias("part"), payload.alias("payload"))


KEYS = ["request_id", "claim_id", "question_id"]


def _question(found: dict) -> str:
    words = sorted((json.loads(p) for p in found["token"].values()), key=lambda w: w["pos"])
    return " ".join(w.get("word", "") for w in words)


#: All words of a question: as many as the last one's place tells.
WORDS = Parts(lambda tag, w: {"words": 1, "told": w["pos"] + 1 if w["last_token"] else 0}, lambda c: 0 < c.get("told", 0) <= c["words"], _question)


def stream_bm25(tokens: DataFrame, index: Index, path: str, checkpoint: str, k: int = 200, timeout_ms: int | None = None, **trigger):
    """tokens(keys, pos, word, last_token) to the k best documents of each question, written once its last word has come.

    The state holds a question's words only. The questions that a batch completes are searched as any others are, and
    written to ``path``/batch=n in place of what is there, so a batch that is tried again leaves the same. Unfinished questions are
    given up after ``timeout_ms``, by default a day where a ``trigger`` is given; a run that takes what is there and ends has no timers.
    Returns the started query.
    """
    timeout_ms = timeout_ms or (KEEP_MS if trigger else None)
    out = collect_parts(_tagged(tokens.select(*KEYS, "pos", "word", "last_token"), KEYS, "token", ["pos"]), WORDS, timeout_ms)
    ids = F.split("key", "/")
    complete = out.where("status = 'complete'").select(*(ids[i].cast("long" if not i else "int").alias(c) for i, c in enumerate(KEYS)), F.col("payload").alias("question"))

    def step(batch: DataFrame, number: int) -> None:
        # Kept, so that the state is read once though the questions are used more than once.
        asked = batch.persist()
        search(asked, index, k, "bag", KEYS, "question").write.mode("overwrite").parquet(f"{path}/batch={number}")
        asked.unpersist()

    return complete.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_rendezvous(left: DataFrame, right: DataFrame, keys: list[str], time_col: str | None = None, within: str = "1 hour") -> DataFrame:
    """Inner join of two streams. With ``time_col`` rows wait for each other for ``within`` only, which bounds the state."""
    if time_col is None:
        return left.join(right, keys)
    a, b = left.withWatermark(time_col, within).alias("a"), right.withColumnRenamed(time_col, "_time").withWatermark("_time", within).alias("b")
    near = F.expr(f"b._time BETWEEN a.{time_col} - INTERVAL {within} AND a.{time_col} + INTERVAL {within}")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, [*cond, near]).drop(*(F.col(f"b.{k}") for k in keys), "_time")


def _add(tag: str, row: dict) -> dict[str, int]:
    """What a claim, question or list of hits adds: itself, and how many the last of its kind announces."""
    if tag == "claim":
        return {"claims": 1, "told_claims": row["claim_id"] + 1 if row.get("last_claim") else 0}
    if tag == "question":
        return {"questions": 1, "asked_claims": int(row["last_question"]), "told_questions": row["question_id"] + 1 if row["last_question"] else 0}
    return {tag: 1}


def _rows(found: dict, tag: str) -> list[dict]:
    return [json.loads(p) for p in found.get(tag, {}).values()]


def _response(found: dict) -> str | None:
    """Nest answer, claims, questions and their hits; None if a question has no hits though as many lists came."""
    hits = {(h["claim_id"], h["question_id"]): h["doc"] for h in _rows(found, "hits")}
    asked: dict[int, list[dict]] = {}
    for q in sorted(_rows(found, "question"), key=lambda q: q["question_id"]):
        if (q["claim_id"], q["question_id"]) not in hits:
            return None
        asked.setdefault(q["claim_id"], []).append({"question": q["question"], "doc": hits[q["claim_id"], q["question_id"]]})
    claims = sorted(_rows(found, "claim"), key=lambda c: c["claim_id"])
    if any(c["claim_id"] not in asked for c in claims):
        return None
    return json.dumps({"generation": _rows(found, "answer")[0]["generation"], "claims": [{"claim": c["claim"], "questions": asked[c["claim_id"]]} for c in claims]}, ensure_ascii=False)


def _response_full(c: dict) -> bool:
    claims, questions = c.get("told_claims", 0), c.get("told_questions", 0)
    return bool(c.get("answer") and claims) and c["claims"] >= claims and c.get("asked_claims", 0) >= claims and c["questions"] >= questions and c.get("hits", 0) >= questions


#: Answer, all claims, all questions of each and their hits.
RESPONSE = Parts(_add, _response_full, _response)


def stream_response(answers: DataFrame, claims: DataFrame, questions: DataFrame, hits: DataFrame, timeout_ms: int | None = KEEP_MS) -> DataFrame:
    """The nested response of a request, once, when all its parts have come. hits(keys, doc: array) has a row for each question.

    Returns key (request id), status, payload (JSON).
    """
    key = ["request_id"]
    parts = _tagged(answers, key, "answer", []).unionByName(_tagged(claims, key, "claim", ["claim_id"]))
    parts = parts.unionByName(_tagged(questions, key, "question", ["claim_id", "question_id"])).unionByName(_tagged(hits, key, "hits", ["claim_id", "question_id"]))
    return collect_parts(parts, RESPONSE, timeout_ms)


def _appraisal(found: dict) -> str | None:
    hits = {h["question_id"]: h["doc"] for h in _rows(found, "hits")}
    if any(q["question_id"] not in hits for q in _rows(found, "question")):
        return None
    scores: dict[int, float] = {}
    for doc in hits.values():
        for h in doc:
            scores[h["doc_id"]] = scores.get(h["doc_id"], 0.0) + 1 / h["rank"]
    best = sorted((-round(v, 4), d) for d, v in scores.items())[:3]
    return json.dumps({"claim": _rows(found, "claim")[0]["claim"], "evidence": [d for _, d in best]}, ensure_ascii=False)


#: A claim, all its questions and their hits.
APPRAISAL = Parts(_add, lambda c: bool(c.get("claims") and c.get("asked_claims")) and min(c["questions"], c.get("hits", 0)) >= c["told_questions"], _appraisal)


def stream_appraise(claims: DataFrame, questions: DataFrame, hits: DataFrame, timeout_ms: int | None = KEEP_MS) -> DataFrame:
    """For each claim, once all its questions have their hits: the claim and its three best documents, as JSON."""
    key = ["request_id", "claim_id"]
    parts = _tagged(claims, key, "claim", []).unionByName(_tagged(questions, key, "question", ["question_id"])).unionByName(_tagged(hits, key, "hits", ["question_id"]))
    return collect_parts(parts, APPRAISAL, timeout_ms)


def _buckets(df: DataFrame, col: str, error: float) -> DataFrame:
    """(bucket, n, total): values by sign and powers of a ratio, so that a bucket's values differ by ``error`` of themselves from its middle."""
    ratio = math.log((1 + error) / (1 - error))
    size = F.abs(F.col(col))
    power = F.ceil(F.log(size) / ratio) + (1 << 20)
    bucket = F.when(size == 0, F.lit(0)).otherwise(F.signum(col) * power).cast("long")
    return df.where(F.col(col).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"))


def bucket_stats(buckets: DataFrame, error: float, high: float = 0.99) -> DataFrame:
    """Mean and count, and median and high percentile off by ``error`` of themselves at most, of (bucket, n, total)."""
    ratio = (1 + error) / (1 - error)
    power = F.abs("bucket") - (1 << 20)
    middle = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.signum("bucket") * F.pow(F.lit(ratio), power) * 2 / (ratio + 1))
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = buckets.select("n", "total", middle.alias("v"), upto.alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.lit(share) * (F.col("all") - 1)), F.struct("upto", "v")))["v"]
    return rows.agg((F.sum("total") / F.sum("n")).alias("avg"), at(0.5).alias("median"), at(high).alias(f"p{round(high * 100)}"), F.coalesce(F.sum("n"), F.lit(0)).alias("count"))


def stream_latency(answered: DataFrame, path: str, checkpoint: str, error: float = 0.005, **trigger):
    """After each batch, write the statistics of all answered requests so far to ``path``/stats, by batch number.

    A batch reads its own rows only: they are counted and summed by value bucket and added to the buckets of the batch before, in
    ``path``/state, some thousands of rows at most. So mean and count are exact, and quantiles off by ``error`` of themselves at most. Both are
    written in place of what is there, so a batch that is tried again counts once. Null latencies don't count.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = _buckets(batch, "latency", error)
        if number:
            own = own.unionByName(spark.read.schema(own.schema).parquet(f"{path}/state/batch={number - 1}"))
        both = own.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        both.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")
        kept = spark.read.schema(both.schema).parquet(f"{path}/state/batch={number}")
        bucket_stats(kept, error).write.mode("overwrite").parquet(f"{path}/stats/batch={number}")

    return answered.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_stream(df: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None, mode: str = "append", fmt: str = "parquet", **trigger) -> bool:
    """Start a stream into files, take what is there (or as ``trigger`` says), stop after ``timeout_s``. True if it ended by itself."""
    query = df.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    ended = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination() or True
    if not ended:
        query.stop()
    return bool(ended)
