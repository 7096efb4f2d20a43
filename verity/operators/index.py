"""The inverted index: postings, lengths, vocabulary, statistics and impacts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions.text import tokenize
from verity.operators.numbering import number_rows

K1, B = 1.5, 0.75
TABLES = ("doclens", "vocabulary", "stats")
#: Documents of a shard, about, and of what a task makes postings of; postings of a block at most; buckets that shards are dealt to at most.
SHARD, PART, BLOCK, FILES = 16384, 2048, 128, 4096


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf), doclens(doc_id, len), vocabulary(term, df), stats(pid_offset, n, avgdl) in one row.

    Maybe also impacts(term, doc_id, impact), bounds(term, df, most, idf) and blocks(shard, bucket, term, most, docs, shares, tfs): postings of one term
    in one shard of the documents, up to ``BLOCK`` of them in the order of documents, with their greatest share. A share is an impact
    without the term's weight, so blocks are made before documents are counted by term. The vocabulary of a stored index has
    term_id too. ``source`` has the documents and stop words of an index that isn't stored.
    """

    postings: DataFrame
    doclens: DataFrame
    vocabulary: DataFrame
    stats: DataFrame
    impacts: DataFrame | None = None
    k1: float = K1
    b: float = B
    bounds: DataFrame | None = None
    blocks: DataFrame | None = None
    source: tuple[DataFrame, list[str] | None] | None = None


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] | None = None) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), tokenize(F.coalesce(F.col(text_col), F.lit("")), stopwords).alias("tokens"))


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """Occurrences of each term in each document; partial sums go to the shuffle."""
    terms = tokens.select("doc_id", F.explode_outer("tokens").alias("term")).where("term IS NOT NULL")
    return terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    """Tokens of each document; empty documents stay, with length 0."""
    return tokens.select("doc_id", F.size("tokens").alias("len"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """Document frequency of each term, and ids in the order of the terms. Runs when called."""
    return number_rows(document_frequencies(postings), "term", "term_id").select("term", "term_id", "df")


def corpus_stats(doclens: DataFrame) -> DataFrame:
    return doclens.agg(F.min("doc_id").alias("pid_offset"), F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def share(tf: Column, length: Column, avgdl: Column, k1: float, b: float) -> Column:
    """A posting's impact without the weight of its term."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def term_weights(index: Index) -> DataFrame:
    """(term, df, idf); the statistics are one row, broadcast."""
    return index.vocabulary.crossJoin(F.broadcast(index.stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def term_shares(index: Index) -> DataFrame:
    """(term, doc_id, share) of each posting: from the blocks, if there are any, without a shuffle."""
    if index.blocks is not None:
        return index.blocks.where("most IS NOT NULL").select("term", F.inline(F.arrays_zip("docs", "shares"))).toDF("term", "doc_id", "share")
    joined = index.postings.join(index.doclens, "doc_id").crossJoin(F.broadcast(index.stats.select("avgdl")))
    return joined.select("term", "doc_id", share(F.col("tf"), F.col("len"), F.col("avgdl"), index.k1, index.b).alias("share"))


def term_impacts(index: Index) -> DataFrame:
    """The BM25 weight of each posting. Blocks are joined whole with the weights, so no posting is shuffled by itself."""
    if index.blocks is not None:
        lists = index.blocks.where("most IS NOT NULL").select("term", "docs", "shares").join(term_weights(index).select("term", "idf"), "term")
        return lists.select("term", "idf", F.inline(F.arrays_zip("docs", "shares"))).select("term", F.col("docs").alias("doc_id"), (F.col("idf") * F.col("shares")).alias("impact"))
    return term_shares(index).join(term_weights(index), "term").select("term", "doc_id", (F.col("idf") * F.col("share")).alias("impact"))


def term_bounds(index: Index) -> DataFrame:
    """Documents and greatest impact of each term, and its weight: no document gets more from it."""
    if index.blocks is not None:
        most = index.blocks.groupBy("term").agg(F.max("most").alias("most"))
    else:
        most = term_shares(index).groupBy("term").agg(F.max("share").alias("most"))
    return most.join(term_weights(index), "term").select("term", "df", (F.col("idf") * F.col("most")).alias("most"), "idf")


def shard_count(doclens: DataFrame) -> int:
    """Shards of ``SHARD`` documents; of few documents as many as tasks work at once, but of 4,096 documents at least."""
    n = doclens.count()
    return max(1, -(-n // SHARD), min(-(-n // (2 * PART)), -(-doclens.sparkSession.sparkContext.defaultParallelism // 4)))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")


def even_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that Spark's hash deals to ``n`` buckets, one to each; 0 to n - 1 would leave a third of the buckets empty, and give others several."""
    hashed = spark.range(64 * n).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).toArrow().column("at").to_numpy()
    return np.unique(hashed, return_index=True)[1].tolist()


def posting_blocks(shares: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """(shard, term, doc_id, share, tf) to blocks of one term; only the postings of one term in one group of ``by`` are together.

    The first block of each has its number of documents as ``n``. Postings without a share count, and are in no block.
    """
    lists = shares.groupBy(*by, "term").agg(F.sort_array(F.collect_list(F.struct("doc_id", "share", "tf"))).alias("every"))
    lists = lists.select("shard", "term", F.size(F.array_distinct("every.doc_id")).alias("n"), F.filter("every", lambda x: x["share"].isNotNull()).alias("list"))
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.size("list"), F.lit(1)), F.lit(block)))
    part = lists.select("shard", "term", "n", "list", first.alias("first")).select("shard", "term", F.when(F.col("first") == 1, F.col("n")).otherwise(0).alias("n"), F.slice("list", F.col("first"), block).alias("part"))
    return part.select("shard", "term", F.array_max("part.share").alias("most"), F.col("part.doc_id").alias("docs"), F.col("part.share").alias("shares"), F.col("part.tf").alias("tfs"), "n")


def _blocks_of_part(k1: float, b: float, block: int = BLOCK) -> Callable[[pa.Table], pa.Table]:
    """Makes the blocks of one part of a shard of (shard, doc_id, avgdl, tokens), as ``posting_blocks`` does; no document is repeated."""

    def made(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")  # a document without an id comes last
        lists, ids = (table.column(c).combine_chunks() for c in ("tokens", "doc_id"))
        length = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        found, tf = np.unique(place[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), length), return_counts=True)
        term, doc = np.divmod(found, max(len(ids), 1))
        n = np.bincount(term, minlength=len(order))
        held = pc.is_valid(ids).to_numpy(zero_copy_only=False)[doc]
        term, doc, tf = term[held], doc[held], tf[held]
        average = table.column("avgdl")[0].as_py() or 1.0
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / average))
        many = np.bincount(term, minlength=len(order))
        blocks = np.maximum(-(-many // block), 1)
        of = np.repeat(np.arange(len(order)), blocks)
        within = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        edges = np.append(np.repeat(np.cumsum(many) - many, blocks) + within * block, len(term))
        empty = edges[1:] == edges[:-1]
        most = np.maximum.reduceat(np.append(weight, 0.0), edges[:-1]) if len(of) else np.zeros(0)
        in_lists = lambda values: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
        columns = [
            pa.array(np.full(len(of), table.column("shard")[0].as_py()), pa.int32()), coded.dictionary.take(order).take(pa.array(of)), pa.array(most, pa.float64(), mask=empty),
            in_lists(ids.take(pa.array(doc))), in_lists(pa.array(weight)), in_lists(pa.array(tf, pa.int32())), pa.array(np.where(within == 0, n[of], 0), pa.int32()),
        ]
        return pa.Table.from_arrays(columns, names=["shard", "term", "most", "docs", "shares", "tfs", "n"])

    return made


def postings_of(blocks: DataFrame) -> DataFrame:
    """(term, doc_id, tf) of blocks; a repeated document has one posting for a term."""
    return blocks.select("term", F.inline(F.arrays_zip("docs", "tfs"))).toDF("term", "doc_id", "tf").distinct()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stopwords: list[str] | None = None, impacts: bool = True, k1: float = K1, b: float = B) -> Index:
    """All tables of the index, as plans. With ``impacts`` a search looks weights up and adds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = token_table(texts, "doc_id", "text", stopwords)
    postings, lengths = term_frequencies(tokens), doc_lengths(tokens)
    index = Index(postings, lengths, document_frequencies(postings), corpus_stats(lengths), None, k1, b, source=(texts, stopwords))
    return replace(index, impacts=term_impacts(index)) if impacts else index


def _named(path: str) -> str:
    return f"verity_blocks_{hashlib.md5(path.encode()).hexdigest()}"


def write_index(index: Index, path: str) -> Index:
    """Parquet tables. Texts are dealt once, by document, and blocks are made of them where they lie, so no posting is shuffled.

    Blocks are a table of the catalog, bucketed so that each file has one shard (or as many as any other) and sorted by term in each: a search groups them
    by shard where they lie, and reads the row groups of its terms only. Vocabulary and bounds are counted from the blocks. Returns the stored index.
    """
    spark = index.postings.sparkSession

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    lengths = stored(index.doclens, "doclens")
    stats = stored(corpus_stats(lengths), "stats")
    if index.impacts is None:
        postings = stored(index.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), "postings")
        return Index(postings, lengths, stored(vocabulary(postings), "vocabulary"), stats, None, index.k1, index.b)
    shards = shard_count(lengths)
    files, parts = min(shards, FILES), -(-SHARD // PART)
    bucket = F.get(F.lit(even_numbers(spark, files)), F.col("shard") % files).alias("bucket")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)).cast("int")
    # A task makes the postings of a part of a shard; all rows of a document are in one part, and each part is a task's.
    deal = lambda rows: rows.select(shard_of(shards), "*").select((F.col("shard") * parts + part).cast("int").alias("part"), "*").repartitionById(shards * parts, "part")
    once = index.source is not None and lengths.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1").isEmpty()
    average = F.broadcast(stats.select("avgdl"))
    if once:
        texts, stopwords = index.source
        tokens = deal(texts).crossJoin(average).select("part", "shard", "doc_id", "avgdl", tokenize(F.coalesce("text", F.lit("")), stopwords).alias("tokens"))
        kind = texts.schema["doc_id"].dataType.simpleString()
        shape = f"shard int, term string, most double, docs array<{kind}>, shares array<double>, tfs array<int>, n int"
        rows = tokens.groupBy("part").applyInArrow(_blocks_of_part(index.k1, index.b), shape)
    else:  # a repeated document has a posting for each of its lengths
        by = ["shard", "part"]
        counted = deal(index.postings).join(deal(lengths).hint("shuffle_hash"), [*by, "doc_id"], "left")
        rows = posting_blocks(counted.crossJoin(average).select(*by, "term", "doc_id", share(F.col("tf"), F.col("len"), F.col("avgdl"), index.k1, index.b).alias("share"), "tf"), by)
    spark.sql(f"DROP TABLE IF EXISTS {_named(path)}")
    written = rows.select("shard", bucket, *rows.columns[1:]).write.mode("overwrite").format("parquet").bucketBy(files, "bucket").sortBy("term")
    written.option("path", f"{path}/blocks").option("parquet.block.size", 8 << 20).saveAsTable(_named(path))
    stored(spark.range(1).select(F.lit(files).alias("files")), "layout")
    blocks = spark.table(_named(path))
    numbered = number_rows(blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")), "term", "term_id")
    terms = stored(numbered.select("term", "term_id", "df"), "vocabulary")
    weighed = numbered.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", "most", idf(F.col("n"), F.col("df")).alias("idf"))
    bounds = stored(weighed.select("term", "df", (F.col("idf") * F.col("most")).alias("most"), "idf"), "bounds")
    made = Index(postings_of(blocks), lengths, terms, stats, None, index.k1, index.b, blocks=blocks, bounds=bounds)
    return replace(made, impacts=term_impacts(made))


def load_index(spark: SparkSession, path: str, impacts: bool = True, k1: float = K1, b: float = B) -> Index:
    """A stored index; its blocks are made known to the session's catalog if they aren't."""
    lengths, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    if not impacts:
        return Index(spark.read.parquet(f"{path}/postings"), lengths, terms, stats, None, k1, b)
    if not spark.catalog.tableExists(_named(path)):
        files, columns = spark.read.parquet(f"{path}/layout").first()["files"], spark.read.parquet(f"{path}/blocks").schema
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns)
        spark.sql(f"CREATE TABLE {_named(path)} ({shape}) USING parquet CLUSTERED BY (bucket) INTO {files} BUCKETS LOCATION '{path}/blocks'")
    blocks = spark.table(_named(path))
    made = Index(postings_of(blocks), lengths, terms, stats, None, k1, b, blocks=blocks, bounds=spark.read.parquet(f"{path}/bounds"))
    return replace(made, impacts=term_impacts(made))
