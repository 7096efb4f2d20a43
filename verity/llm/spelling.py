"""Grouping of spelling variants by asymmetric q-chunks (operator 13)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut

#: The letters of a run, and upper and lower case as far as it is folded.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters with A-Z folded, of ``least`` code points or more and met ``often`` times or more.

    A run whose checksum with its document's id is divisible by ``every`` loses one letter, which plants misspellings.
    Null texts have no runs, a null id counts as the empty text in the checksum, and repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= often) & (F.length("word") >= least))


def _keys(size: Column, side: int, chunk: Column, rest: Column) -> list[Column]:
    """Chunk and what an edit beside it leaves: ``rest`` holds the edit, so of its two halves one is kept, at its end.

    ``size`` is the length of the word that has the chunk, which gives the lengths of the halves on either side of a join.
    """
    beside = size - F.shiftright(size, 1)
    first = F.shiftright(beside, 1)
    kept = (F.left(rest, first), F.right(rest, beside - first))
    return [F.xxhash64(size, F.lit(f"{side}{end}"), chunk, half) for end, half in enumerate(kept)]


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n) to (a, n_a, b, n_b): pairs that differ by one inserted, deleted or replaced code point, each once.

    Asymmetric q-chunks. Of a pair the word ``a`` that isn't longer gives two disjoint chunks, its first and last q code points with q half of its
    length, and ``b`` all its positional grams of that size. The edit isn't in both chunks, so one of them is a gram of b, in
    its place or one further. A preserved first chunk has only the edit behind it, so it starts b; a preserved last one ends b; grams
    elsewhere can't leave one edit and are dropped where they are made. The edit is beside the chunk, in a rest that is cut
    in two again: half of it is kept as well. Words meet on chunk and kept half, so a frequent beginning or ending
    doesn't bring unlike words together, and distances are checked inside the join, so only near pairs leave it.
    """
    length = F.length("word")
    q = F.shiftright(length, 1)
    chunks = [*_keys(length, 0, F.left("word", q), F.right("word", length - q)), *_keys(length, 1, F.right("word", q), F.left("word", length - q))]
    short = words.select(F.explode(F.array(*chunks)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))

    wide = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where("size > 1").withColumn("q", F.shiftright("size", 1))
    grams = wide.withColumn("place", F.explode(F.sequence(F.lit(0), length - F.col("q"))))
    gram = F.substring("word", F.col("place") + 1, F.col("q"))
    at_start = F.when(F.col("place") == 0, F.array(*_keys(F.col("size"), 0, gram, F.right("word", length - F.col("q")))))
    at_end = F.when(F.col("place") == length - F.col("q"), F.array(*_keys(F.col("size"), 1, gram, F.left("word", length - F.col("q")))))
    none = F.array().cast("array<bigint>")
    grams = grams.select(F.explode(F.concat(F.coalesce(at_start, none), F.coalesce(at_end, none))).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))

    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = short.join(grams, "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def best_forms(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): near words of each word, and the most frequent of them if ``ratio`` times as frequent.

    Ties go to the form that is smaller in code-point order; words without near ones stay.
    """
    side = lambda word, m, other: F.struct(F.col(word).alias("word"), F.col(m).alias("m"), F.col(other).alias("other"))
    both = pairs.select(F.inline(F.array(side("a", "n_b", "b"), side("b", "n_a", "a"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame, ratio: int = 5, often: int = 5) -> DataFrame:
    """(word, root) of the words that have a form: the end of the chain of forms, found by doubling.

    Counts grow ``ratio`` times with each step, so the greatest count bounds a chain's length and the rounds needed.
    """
    links = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / often, 1), ratio) + 1e-9))
    for _ in range(math.ceil(math.log2(steps))):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def group_variants(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``count_words``; an empty table gives none.

    ``root`` follows forms to the last, and is the word itself where it has none. Other columns are not read.
    """
    words = cut(count_words(docs, least, often, every, id_col, text_col))
    forms = cut(best_forms(words, near_pairs(words), ratio))
    return forms.join(roots(forms, ratio, often), "word", "left").withColumn("root", F.coalesce("root", "word"))
