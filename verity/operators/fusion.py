"""Evidence of several queries fused, looked up and appraised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verity.functions.text import build_prompt, parse_verdict
from verity.operators.search import top_k


def fuse_reciprocal_rank(hits: DataFrame, by: list[str], k: int | None = 3) -> DataFrame:
    """Documents by the sum of 1 / rank over the hits of a group; ties by doc_id."""
    return top_k(hits.groupBy(*by, "doc_id").agg(F.sum(1 / F.col("rank")).alias("score")), by, k)


def lookup_text(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """Hits with the text of their document; done last, so no text goes through the ranking."""
    return hits.join(collection.select("doc_id", "text"), "doc_id")


def combine_docs(hits: DataFrame, by: list[str]) -> DataFrame:
    """The distinct documents of a group."""
    return hits.select(*by, "doc_id").distinct()


def appraise(claims: DataFrame, evidence: DataFrame, generate) -> DataFrame:
    """A verdict for each claim: prompt from its evidence texts in rank order, then the parsed answer.

    ``generate`` maps a prompt column to a text column. A claim without evidence has the blank verdict.
    """
    keys = ["request_id", "claim_id"]
    texts = evidence.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("_texts"))
    rows = claims.join(texts, keys, "left").withColumn("_out", F.when(F.col("_texts").isNotNull(), generate(build_prompt("appraisal", F.col("claim"), F.col("_texts")))))
    return rows.select(*keys, "claim", parse_verdict(F.coalesce("_out", F.lit(""))).alias("v")).select(*keys, "claim", "v.*")
