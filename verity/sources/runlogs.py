"""Client run logs and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = (
    "time DOUBLE, last_request_sent_time DOUBLE, last_response_recv_time DOUBLE, avg_latency DOUBLE, "
    "median_latency DOUBLE, p99_latency DOUBLE, num_requests_sent BIGINT, num_responses_recv BIGINT"
)
SUMMARY = ["rate", "achieved_rate", "avg_latency", "median_latency", "p99_latency", "throughput_avg"]


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run_file, log columns) from JSON lines; the metadata line and others without ``avg_latency`` are left out."""
    lines = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("run_file"), "value")
    rows = lines.where(F.contains("value", F.lit('"avg_latency"')))
    return rows.select("run_file", F.from_json("value", LOG).alias("r")).select("run_file", "r.*").where("time IS NOT NULL")


def run_rate_from_name(name: Column) -> Column:
    """The offered rate: the fourth part of the file name."""
    return F.try_element_at(F.split(name, "_"), F.lit(4)).try_cast("double")


def run_summary(stats: DataFrame) -> DataFrame:
    """The columns of the summary, by run_stats; ``rate`` comes from the name of the run."""
    named = stats.withColumn("rate", run_rate_from_name(F.col("run_file")))
    return named.select("rate", "achieved_rate", F.col("latency_avg").alias("avg_latency"), F.col("latency_median").alias("median_latency"), F.col("latency_p99").alias("p99_latency"), "throughput_avg")


def write_run_summary(stats: DataFrame, path: str) -> None:
    """One CSV file sorted by the offered rate: a row for each run, so it is small."""
    run_summary(stats).orderBy("rate").coalesce(1).write.mode("overwrite").csv(path, header=True)
