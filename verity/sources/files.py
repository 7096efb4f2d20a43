"""Collections, queries, requests and responses in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.operators.numbering import number_rows


def _tsv(spark: SparkSession, path: str, schema: str, header: bool, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.options(sep="\t", header=header, quote="", mode=mode, enforceSchema=True).schema(schema).csv(path)


def read_collection(spark: SparkSession, path: str, fmt: str = "tsv") -> DataFrame:
    """(doc_id, text) from a TSV file with a header whose first two columns count, or from Parquet with those names.

    Further columns are ignored; a row whose id is no number raises.
    """
    if fmt == "parquet":
        return spark.read.parquet(path).select("doc_id", "text")
    rows = spark.read.options(sep="\t", header=True, quote="").csv(path)
    number, text = (F.col(f"`{c}`") for c in rows.columns[:2])
    bad = F.raise_error(F.concat(F.lit("not a document id: "), F.coalesce(number, F.lit("")))).cast("bigint")
    return rows.select(F.coalesce(number.try_cast("bigint"), bad).alias("doc_id"), text.alias("text"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) from a TSV file with a header and exactly three columns; other rows raise."""
    return _tsv(spark, path, "doc_id BIGINT, text STRING, _unused STRING", True, "FAILFAST").select("doc_id", "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) from a TSV file without a header."""
    return _tsv(spark, path, "query_id STRING, text STRING", False)


def assign_request_ids(df: DataFrame, order: Column | str | None = None) -> DataFrame:
    """Ids 0, 1, .. in file order, or in the order of a column, as ``request_id``; see ``number_rows``."""
    return number_rows(df, order, "request_id")


def write_responses(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One nested response for each request."""
    df.write.mode("append").format(fmt).save(path)


def stream_requests(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    """An unbounded source of requests in small batches; options such as maxFilesPerTrigger bound a batch."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)
