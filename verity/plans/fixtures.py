"""The given tables in the roles of requests, answers, collections, vectors, events and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions import text
from verity.operators import latency
from verity.operators.index import Index, build_index, load_index, write_index
from verity.operators.search import search
from verity.plans.verify import KEYS, questions_of
from verity.sources.scratch import scratch

DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the index of a collection is stored, by application and state of the collection's files.
_STORED: dict[tuple, str] = {}


def collection_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents: written at the first search, and again when their files change."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    state = (spark.sparkContext.applicationId, sf_dir, *files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("p", "n", "t").bitwiseAND((1 << 40) - 1))).first())
    if state not in _STORED:
        path = scratch(spark)
        write_index(build_index(docs), path)
        _STORED[state] = path
    return load_index(spark, _STORED[state])


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def requests(conversations: DataFrame) -> DataFrame:
    """User turns, with an id from conversation and turn."""
    return conversations.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("query"))


def answers(conversations: DataFrame) -> DataFrame:
    """Assistant turns, under the id of the turn before."""
    return conversations.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("request_id"), F.col("text").alias("generation"))


def answered(conversations: DataFrame) -> DataFrame:
    """Answers whose turn before is a request."""
    return answers(conversations).join(requests(conversations), "request_id")


def claims(conversations: DataFrame) -> DataFrame:
    return text.extract_claims(answers(conversations))


def questions(conversations: DataFrame) -> DataFrame:
    return questions_of(claims(conversations))


def hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """BM25 hits of all questions."""
    return search(questions(table(spark, sf_dir, "conversations")), collection_index(spark, sf_dir), k, "bag", KEYS, "question")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def sent(events: DataFrame) -> DataFrame:
    return events.where("event_type <> 'error'").select(F.col("event_id").alias("request_id"), seconds(F.col("ts")).alias("sent_time"), run_name(F.col("user_id")).alias("run_file"))


def received(events: DataFrame) -> DataFrame:
    return events.where("event_type <> 'signup'").select(F.col("event_id").alias("request_id"), (seconds(F.col("ts")) + F.col("value")).alias("recv_time"), run_name(F.col("user_id")).alias("run_file"))


def run_name(user: Column) -> Column:
    return F.concat(F.lit("client_out_rate_"), F.pmod(user, F.lit(3)).cast("string"), F.lit("_possion_0.json"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three client logs with an entry a day."""
    events = table(spark, sf_dir, "events")
    ticks = events.select(run_name(F.col("user_id")).alias("run_file"), ((F.floor(seconds(F.col("ts")) / DAY) + 1) * DAY).alias("time")).distinct()
    return latency.latency_snapshots(sent(events), received(events).drop("run_file").join(sent(events).select("request_id", "run_file"), "request_id"), ticks, ["run_file"])
