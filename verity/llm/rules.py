"""Quality rules: counted statistics, and hashed n-gram log-likelihood ratios (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that split words, as a Java pattern, and characters that count as symbols.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda x: x != "")


def with_statistics(df: DataFrame, text_col: str, words_col: str) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words from a text and its words.

    Every text is handled by itself, without a shuffle, in O(n log n). Windows of three words are compared by 64-bit
    hashes: those are sorted with their places, so equal ones are neighbours.
    """
    text, w = F.coalesce(F.col(text_col), F.lit("")), F.col(words_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    df = df.withColumns({"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"), "_lines": lines, "_windows": windows})
    same = F.size(F.array_distinct("_windows")) == F.size("_windows")
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_placed": F.when(~same, placed)})
    p = F.col("_placed")
    twice = F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]))
    df = df.withColumn("_starts", F.array_sort(F.array_compact(twice)))
    s = F.col("_starts")
    # Each window that occurs twice covers three words, less those that the next one covers.
    covered = F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_lines", "_windows", "_placed", "_starts")


def gram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of the single words and the pairs of neighbours."""
    one = F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.pmod(F.xxhash64(words[i], words[i + 1]), F.lit(buckets)).cast("int"))
    return F.concat(one, F.when(F.size(words) >= 2, two).otherwise(F.array().cast("array<int>")))


def ratio_table(grams: DataFrame, buckets: int, smoothing: float) -> DataFrame:
    """One row, one array: the log ratio of a bucket's smoothed share in the target and in the raw corpus.

    ``grams`` has (_grams, _target), a row for each document. Counts are summed before the shuffle, so a task sends
    a row for each bucket at most, and the array has ``buckets`` numbers whatever the corpus. Without target counts
    all ratios are 0.
    """
    # The outer form, as the other infers a filter on the array, and so makes the array twice, word by word.
    counted = grams.select(F.explode_outer("_grams").alias("b"), "_target").where("b IS NOT NULL").groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("_target").alias("target"))
    every = grams.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counted, "b", "left").fillna(0)
    one = every.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    share = lambda n, total: (n + smoothing) / (total + smoothing * buckets)
    ratio = lambda x: F.when(F.col("targets") > 0, F.log(share(x["target"], F.col("targets")) / share(x["raw"], F.col("raws")))).otherwise(0.0)
    return one.select(F.transform("all", ratio).alias("ratios"))


def judge_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 14,
    smoothing: float = 20.0,
    threshold: float = -0.04,
) -> DataFrame:
    """Keep or drop every document by counted rules and by the mean log-likelihood ratio of its n-grams.

    ``trusted`` has the ids of trusted documents. All of them make up the target multinomial, and all documents the
    raw one: ids and texts meet in a shuffle join, so nothing but the table of buckets is broadcast. A document's
    score is the sum over its hashed words and word pairs of log(p_target / p_raw), over their number;
    it is kept if the score is at least ``threshold`` and no counted rule drops it.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr. Null text
    has no words and fails, as does a text of fewer than 50 words; its llr is 0. Rows with a null id are judged, but never trusted. A
    row is given for each row; an empty table gives none; without trusted documents no text is dropped by its
    score. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ids = trusted.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct().withColumn("_target", F.lit(1))
    words = words_of(F.col("_text"))
    # Rows with a null id match nothing, and would all meet in one task.
    known = rows.where("_id IS NOT NULL").join(ids.hint("merge"), "_id", "left").select(F.coalesce("_target", F.lit(0)).alias("_target"), "_text")
    counted = known.unionByName(rows.where("_id IS NULL").select(F.lit(0).alias("_target"), "_text")).select("_target", words.alias("_words"))
    counted = counted.select("_target", gram_buckets(F.col("_words"), buckets).alias("_grams"))
    ratios = ratio_table(counted, buckets, smoothing).scalar()

    out = rows.withColumn("_words", words)
    out = with_statistics(out, "_text", "_words").withColumn("_grams", gram_buckets(F.col("_words"), buckets))
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(F.col("_ratios"), b))
    out = out.withColumn("_ratios", ratios).withColumn("llr", F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = F.struct(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr"
    )
    # A caller's filter stops at the generator; pushed below, it would repeat all steps inside one another.
    return out.select(F.inline_outer(F.array(judged)))
