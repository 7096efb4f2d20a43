"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import cut, pieces, utf8, words_of

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "long_words", "short_words", "upper", "digits", "symbols", "bangs", "pipes",
    "commas", "stops", "quotes", "wide", "blanks", "lines_per_word", "dup_lines", "distinct_words", "repeat_pairs", "end_marks", "symbol_words",
)


def _members(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(chars)] = 1
    return table


_CLASSES = {
    "upper": _members(bytes(range(65, 91))),
    "digits": _members(b"0123456789"),
    "symbols": _members(b"#*$%&<>@^~_=+/\\{}[]"),
    "bangs": _members(b"!?"),
    "pipes": _members(b"|"),
    "commas": _members(b",;:"),
    "stops": _members(b"."),
    "quotes": _members(b"\"'`"),
    "wide": _members(bytes(range(128, 256))),
    "blanks": _members(b" \t\n\r\x0b\x0c"),
}


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct keys of each row; ``row`` is sorted."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, in numpy passes over the whole batch. An empty text has zeros."""
    rows = len(offsets) - 1
    sizes = np.diff(offsets).astype(np.float64)
    hashes, begins, ends, at = words_of(data, offsets, lower=False)
    words = np.diff(at).astype(np.float64)
    lengths = (ends - begins).astype(np.float64)
    of = np.repeat(np.arange(rows), np.diff(at))
    per_byte, per_word = np.maximum(sizes, 1), np.maximum(words, 1)
    total = lambda v: np.bincount(of, v, minlength=rows)
    running = lambda v: np.concatenate([[0], np.cumsum(v)])
    mean = total(lengths) / per_word
    out = {
        "log_bytes": np.log1p(sizes),
        "log_words": np.log1p(words),
        "word_bytes": mean,
        "word_spread": np.sqrt(np.maximum(total(lengths**2) / per_word - mean**2, 0)),
        "long_words": total(lengths > 12) / per_word,
        "short_words": total(lengths < 4) / per_word,
    }
    for name, table in _CLASSES.items():
        sums = running(table[data].astype(np.float64))
        out[name] = (sums[offsets[1:]] - sums[offsets[:-1]]) / per_byte
    # Lines are told apart by the sum of their words' hashes.
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets, breaks + 1]))
    line_at = np.searchsorted(begins, bounds)
    word_sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)])
    line_hash = word_sums[line_at[1:]] - word_sums[line_at[:-1]]
    line_row = np.searchsorted(offsets, bounds[:-1], "right") - 1
    full = line_at[1:] > line_at[:-1]
    lines = np.bincount(line_row[full], minlength=rows)
    out["lines_per_word"] = lines / per_word
    out["dup_lines"] = (lines - _distinct(line_row[full], line_hash[full], rows)) / np.maximum(lines, 1)
    out["distinct_words"] = _distinct(of, hashes, rows) / per_word
    pairs = (of[1:] == of[:-1]) if len(of) else np.zeros(0, bool)
    pair_of, pair = of[1:][pairs], (hashes[:-1] * np.uint64(31) + hashes[1:])[pairs]
    out["repeat_pairs"] = 1 - _distinct(pair_of, pair, rows) / np.maximum(words - 1, 1)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out["end_marks"] = total(np.isin(last, list(b".!?,;:"))) / per_word
    out["symbol_words"] = total(_CLASSES["symbols"][last] if len(last) else last) / per_word
    table = np.stack([out[f] for f in FEATURES], axis=1) if rows else np.zeros((0, len(FEATURES)))
    table[sizes == 0] = 0
    return table.astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: inner nodes by level, then leaves."""

    depth: int
    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; a larger value goes right
    leaf: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that the rows reach: all trees at once, a level at a time."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))[:, None]
        if not len(self.feature) or not len(x):
            return total
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return total + self.leaf[trees, node - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def with_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _x): the statistics of each whole text as packed 32-bit floats. Null text counts as empty."""
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                table = statistics(*utf8(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in table], pa.binary())], names=["_id", "_x"])

    return df.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text").mapInArrow(run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(FEATURES))


def fit(sample: DataFrame, trees: int = 24, depth: int = 3, bins: int = 64, rate: float = 0.3, l2: float = 1.0) -> Trees:
    """Fit log loss on ``sample`` (_x, _y: 0 or 1), a bounded table in the shared folder.

    For each level of each tree, every task sums gradients and hessians by (node, feature, bin) over its rows; only
    those histograms, whose size does not depend on the rows, come to the driver. A task works out a row's gradient
    from the trees so far, so it can be run again anywhere.
    """
    spark = sample.sparkSession
    n_features = len(FEATURES)
    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("ones")).first()
    n, ones = counts["n"], counts["ones"] or 0
    base = float(np.log((ones + 1) / (n - ones + 1)))
    empty = Trees(depth, base, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.float32), np.zeros((0, 2**depth)))
    if not n or ones in (0, n):
        return empty

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_x"))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n_features, dtype=np.int32), len(x))), pa.array(x.reshape(-1).astype(np.float64))], names=["f", "v"])

    grid = [k / bins for k in range(1, bins)]
    edges = np.zeros((n_features, bins - 1), np.float32)
    for row in sample.select("_x").mapInArrow(values, "f int, v double").groupBy("f").agg(F.percentile_approx("v", grid, 1000).alias("q")).collect():
        edges[row["f"]] = row["q"]

    model = empty
    for _ in range(trees):
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32)
        for level in range(depth + 1):
            first, nodes = 2**level - 1, 2**level
            sent = spark.sparkContext.broadcast((model, feature, threshold))

            def sums(batches: Iterator[pa.RecordBatch], level=level, first=first, nodes=nodes, sent=sent) -> Iterator[pa.RecordBatch]:
                model, feature, threshold = sent.value
                total = np.zeros((2, nodes * n_features * bins))
                for batch in batches:
                    x, y = _matrix(batch.column("_x")), batch.column("_y").to_numpy(zero_copy_only=False)
                    p = model.score(x)
                    g, h = p - y, p * (1 - p)
                    node = np.zeros(len(x), np.int64)
                    for _ in range(level):
                        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
                    node -= first
                    for f in range(n_features if level < depth else 1):
                        key = (node * n_features + f) * bins + np.searchsorted(edges[f], x[:, f], "left")
                        total[0] += np.bincount(key, g, minlength=total.shape[1])
                        total[1] += np.bincount(key, h, minlength=total.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

            parts = sample.select("_x", "_y").mapInArrow(sums, "s binary").collect()
            g, h = sum(np.frombuffer(p["s"]) for p in parts).reshape(2, nodes, n_features, bins)
            if level == depth:
                leaf = -rate * g.sum(axis=(1, 2)) / (h.sum(axis=(1, 2)) + l2)
                break
            left_g, left_h = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(h, axis=2)[:, :, :-1]
            all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            for k in range(nodes):
                best = int(np.argmax(gain[k]))
                if gain[k].flat[best] > 1e-6:
                    feature[first + k], threshold[first + k] = best // (bins - 1), edges[best // (bins - 1), best % (bins - 1)]
        model = Trees(depth, base, np.vstack([model.feature, feature]), np.vstack([model.threshold, threshold]), np.vstack([model.leaf, leaf]))
    return model


def held_out(id_col: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 60_000, **options) -> Trees:
    """Learn ``label_col`` from at most ``sample_rows`` labelled documents, those of least id hash that aren't held out.

    The bound makes the ids that are broadcast, and the table that the trees are fitted on, of fixed size; no text
    is shuffled. Of several labels of one id the least counts.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = with_statistics(rows.select(F.struct("_id", "_y").alias("_key"), "_text"), "_key", "_text")
    return fit(cut(rows.select("_x", F.col("_id._y").alias("_y"))), **options)


def score_documents(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; a null or empty text is scored as one of zeros."""
    x = with_statistics(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([x.schema["_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(_matrix(part.column("_x"))))], names=["_id", "score"])

    return x.mapInArrow(run, schema).select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score every whole text for quality: 0 to 1, higher where label 1 is likelier.

    Inputs are statistics of the text alone. Returns id_col, held_out, score, predicted, a row for each row. Null
    and empty texts, repeated rows, null ids and empty tables are fine; without both labels every score is the
    share of label 1, smoothed.
    """
    return score_documents(docs, train(docs, labels, id_col, text_col), id_col, text_col, threshold)


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                yield part.filter(pa.array(sent.value.score(statistics(*utf8(part.column(text_col)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
