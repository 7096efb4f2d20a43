"""From raw documents to token ids: each stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import boosting, decontamination, neardup, secrets, sentencepieces
from verity.llm.common import cut, discard, small_batches
from verity.llm.queries import piece_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the boosted trees reject."""
    small_batches(spark)
    model = boosting.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return boosting.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each class of equal or similar documents."""
    small_batches(spark)
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    small_batches(spark)
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take secrets out of the texts; every document stays."""
    small_batches(spark)
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, with begin and end ids, and decode again."""
    small_batches(spark)
    coded = sentencepieces.encode_decode(docs, piece_model())
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can express neither the trees, the latent search nor the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; what the next stage has read is deleted.

    Null and empty texts, null and repeated ids are documents like others in every stage; columns beyond those of
    ``documents`` pass through all but the last; an empty table gives none.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spent = None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if spent is not None:
            discard(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
