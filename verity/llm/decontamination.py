"""Benchmark decontamination by latent semantic retrieval (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verity.llm.common import BASE, NOT_ALNUM, cut, fresh, maybe_in, mix, pieces, powers, utf8, words_of


@dataclass(frozen=True)
class Settings:
    """``buckets`` hashed words, ``rank`` latent dimensions, passages of two ``hop``s of words.

    A place whose latent cosine with a passage of an item is at least ``cosine``, or which has ``exact`` words of
    the item in a row, is a candidate. It is a leak if the longest common subsequence holds ``overlap`` of the item's
    words, and its answer is there too: the benchmark's own answer or, where it has none, the ``answer`` share of the
    item's informative words (the rarer half). Items of over ``section`` words are searched in equal sections of that size at
    most: where a section has its share, the whole item is held against the words around, so shares and answers are always those of
    the whole item.
    """

    buckets: int = 1 << 16
    rank: int = 64
    hop: int = 16
    cosine: float = 0.5
    #: Weight of a word that is in all documents.
    least: float = 0.1
    exact: int = 8
    overlap: float = 0.6
    answer: float = 0.5
    section: int = 512
    #: Most passages of items that are broadcast at once, about; and most cosines that a task holds.
    block: int = 1 << 16
    cosines: int = 1 << 22
    seed: int = 11


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes in lower case. Up to U+00FF that is an addition; texts with other letters go through Arrow."""
    data, offsets = utf8(texts)
    if len(data) and data.max() > 0xC3:
        return utf8(pc.utf8_lower(texts))
    big = (data >= 65) & (data <= 90)
    big[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + np.uint8(32) * big, offsets


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, in lower case) and the rows' offsets into them."""
    hashes, _, _, at = words_of(*_lowered(texts), lower=False, apart=NOT_ALNUM)
    return hashes, at


def _bucket(words: np.ndarray, settings: Settings) -> np.ndarray:
    return (words % np.uint64(settings.buckets)).astype(np.int64)


def _hops(at: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows into hops, and the hop of each word. A row without words has none."""
    counts = np.diff(at)
    hops = np.concatenate([[0], np.cumsum(-(-counts // settings.hop))])
    within = np.arange(at[-1]) - np.repeat(at[:-1], counts)
    return hops, np.repeat(hops[:-1], counts) + within // settings.hop


def _passages(vectors: np.ndarray, buckets: np.ndarray, at: np.ndarray, hops: np.ndarray, settings: Settings) -> np.ndarray:
    """Sums of the words' vectors by hop and the next hop of the row, a place in the hop at a time.

    The last of the ``vectors`` is zero, and stands for places without a word.
    """
    counts = np.diff(hops)
    row = np.repeat(np.arange(len(counts)), counts)
    start = at[row] + (np.arange(hops[-1]) - hops[row]) * settings.hop
    size = np.minimum(at[row + 1] - start, settings.hop)
    sums = np.zeros((hops[-1], vectors.shape[1]), np.float32)
    padded = np.append(buckets, np.full(settings.hop, settings.buckets))
    room = np.empty((2048, vectors.shape[1]), np.float32)
    for low in range(0, len(sums), len(room)):  # runs that fit the cache
        part = sums[low : low + len(room)]
        for k in range(settings.hop):
            place = np.where(size[low : low + len(room)] > k, padded[start[low : low + len(room)] + k], settings.buckets)
            np.take(vectors, place, axis=0, out=room[: len(part)], mode="clip")
            part += room[: len(part)]
    both = sums.copy()
    inner = np.ones(len(sums), bool)
    inner[hops[1:][counts > 0] - 1] = False
    if len(sums):
        both[:-1][inner[:-1]] += sums[1:][inner[:-1]]
    return both


def _marks(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """256 bits for each row, set by its words."""
    bits = np.zeros((rows, 256), bool)
    bits[row, (words >> np.uint64(24)) & np.uint64(255)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _union(marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Marks of all rows from ``low`` to before ``high``: the union of two runs whose length is a power of two."""
    power = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    out = np.zeros((len(low), marks.shape[1]), np.uint64)
    level = marks
    for k in range(int(power.max(initial=0)) + 1):
        some = power == k
        out[some] = level[low[some]] | level[high[some] - (1 << k)]
        longer = level.copy()
        longer[: -(1 << k) or None] |= level[1 << k :] if len(level) > 1 << k else 0
        level = longer
    return out


def _runs(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the runs of ``width`` words within a row."""
    row_end = np.repeat(at[1:], np.diff(at))
    starts = np.flatnonzero(np.arange(len(words)) + width <= row_end)
    total = np.zeros(len(starts), np.uint64)
    for k, factor in enumerate(powers(BASE, width + 1)[1:]):
        total += words[starts + k] * factor
    return mix(total), starts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def word_weights(docs: DataFrame, items: DataFrame, settings: Settings) -> np.ndarray:
    """Inverse document frequency of the buckets that items use, over all documents; 0 for others.

    Every word of an item has a positive weight, however many documents have it: the frequency counts the leaks too,
    so a cut would hide an item that many documents hold. Tasks send a count for each such bucket at most; the result has ``buckets`` numbers.
    """

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(_words(part.column("_text"))[0], settings)))], names=["b"])

    known = np.zeros(settings.buckets, bool)
    known[[r["b"] for r in items.select("_text").mapInArrow(used, "b long").distinct().collect()]] = True
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(settings.buckets, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "_text"):
                words, at = _words(part.column("_text"))
                b, row = _bucket(words, settings), np.repeat(np.arange(part.num_rows), np.diff(at))
                keep = sent.value[b]
                total += np.bincount(np.unique(row[keep] * settings.buckets + b[keep]) % settings.buckets, minlength=settings.buckets)
                rows += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], rows))], names=["b", "n"])

    weights = np.zeros(settings.buckets)
    frequency = {r["b"]: r["n"] for r in docs.select("_text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()}
    total = frequency.pop(-1, 0)
    weights[known] = np.log(1.0 + total) + settings.least
    for b, n in frequency.items():
        weights[b] = np.log((1.0 + total) / (1.0 + n)) + settings.least
    return weights.astype(np.float32)


def latent_basis(items: DataFrame, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """(buckets, rank): leading right singular vectors of the items' TF-IDF passages, by randomised SVD.

    With A the passages and W a random matrix drawn from bucket numbers, tasks make rows of Y = A W and sum Y'Y; a
    Cholesky factor of that makes Q = Y R^-1 orthonormal, and tasks sum B = Q'A. The driver handles matrices of
    rank x rank and rank x buckets only, whatever the number of items.
    """
    l = settings.rank + 8
    spark = items.sparkSession
    sent = spark.sparkContext.broadcast(weights)

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Row, bucket and value of the entries of A, with unit rows."""
        words, at = _words(batch.column("_text"))
        hops, hop_of = _hops(at, settings)
        b = _bucket(words, settings)
        row, value = hop_of, sent.value[b]
        if len(hops) > 1 and hops[-1]:  # a passage has its own hop and the next of its row
            last = np.zeros(hops[-1], bool)
            last[hops[1:][np.diff(hops) > 0] - 1] = True
            start = np.zeros(hops[-1], bool)
            start[hops[:-1][np.diff(hops) > 0]] = True
            again = ~start[hop_of]
            row, b, value = np.concatenate([row, hop_of[again] - 1]), np.concatenate([b, b[again]]), np.concatenate([value, value[again]])
        norm = np.sqrt(np.maximum(np.bincount(row, value.astype(np.float64) ** 2, minlength=hops[-1]), 1e-12))
        return row, b, value / norm[row], int(hops[-1])

    def project(batch: pa.RecordBatch) -> tuple:
        """The entries of A, and Y; a row of W is made where it is used, from the bucket's number."""
        row, b, value, n = rows(batch)
        used, place = np.unique(b, return_inverse=True)
        random = mix((used[:, None] * l + np.arange(l)).astype(np.uint64) + np.uint64(settings.seed) * np.uint64(1 << 40))
        y = np.zeros((n, l))
        np.add.at(y, row, (random.astype(np.float64) / 2.0**64 - 0.5)[place] * value[:, None])
        return row, b, value, y

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((l, l))
        for batch in batches:
            for part in pieces(batch, "_text", 1 << 20):
                y = project(part)[-1]
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(l * l)), pa.array(total.reshape(-1))], names=["k", "v"])

    def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((settings.buckets, l))
        for batch in batches:
            for part in pieces(batch, "_text", 1 << 20):
                row, b, value, y = project(part)
                np.add.at(total, b, (y @ inverse)[row] * value[:, None])
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[k].tobytes() for k in some], pa.binary())], names=["b", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, m in zip(batch.column("b").to_pylist(), batch.column("m").to_pylist(), strict=True):
                total[b] = total.get(b, 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["b", "m"])

    g = np.zeros(l * l)
    for r in items.select("_text").mapInArrow(gram, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        g[r["k"]] = r["v"]
    value, vector = np.linalg.eigh(g.reshape(l, l))
    inverse = vector / np.sqrt(np.maximum(value, 1e-9)) * (value > 1e-9)
    b_t = np.zeros((settings.buckets, l))
    summed = items.select("_text").mapInArrow(image, "b long, m binary").repartition("b").mapInArrow(add, "b long, m binary")
    for r in summed.collect():
        b_t[r["b"]] = np.frombuffer(r["m"])
    value, vector = np.linalg.eigh(b_t.T @ b_t)
    keep = np.argsort(value)[::-1][: settings.rank]
    keep = keep[value[keep] > 1e-9]
    return (b_t @ vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: ``masks`` has the places of the item's words."""
    row = full = (1 << size) - 1
    for w in words:
        if (m := masks.get(w)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - bin(row).count("1")


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    settings: Settings | None = None,
    answer_col: str | None = None,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, as a copy or a paraphrase.

    Every passage of every whole text is compared, in the latent space, with every passage of every item, items in
    blocks of a fixed number of passages; a task reads its texts once for each block, and nothing is shuffled but the pairs
    found. Copies of items whose words are too common to stand out there are candidates by their runs of words. All
    candidates go through the common subsequence and the answer check. Returns id_col, item_id, cosine, overlap (share of
    the item's words in the common subsequence), one row for each pair, both at their best.

    Null and empty texts or items match nothing. Repeated rows and equal ids give a pair once, at its best. Null
    item ids are items like others. With ``answer_col`` an item's answer must be there in one piece; null and empty
    answers count as none. Other columns are not read. Empty tables give no rows.
    """
    best = _leaks(df, benchmark, id_col, text_col, item_id, item_text, settings or Settings(), answer_col)
    best = best.groupBy("_id", "_item").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"))
    return best.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id), "cosine", "overlap")


def _sections(items: DataFrame, settings: Settings) -> DataFrame:
    """(_item, _whole, _place, _passages, _words, _answer): sections of the items, as hashes of their words; _whole tells items apart."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = _words(batch.column("_text"))
            answers, answers_at = _words(batch.column("_answer"))
            sizes = np.diff(at)
            cuts = [(k, int(at[k]) + np.arange(n + 1) * int(sizes[k]) // n) for k, n in enumerate((-(-sizes // settings.section)).tolist()) if n]
            rows = [(k, int(a), int(z)) for k, edges in cuts for a, z in zip(edges, edges[1:], strict=False)]
            own = pa.array([k for k, _, _ in rows], pa.int64())
            answer = [answers[answers_at[k] : answers_at[k + 1]].tobytes() for k in range(batch.num_rows)]
            whole = [hashlib.md5(words[at[k] : at[k + 1]].tobytes() + b"/" + answer[k]).digest() for k in range(batch.num_rows)]
            columns = [
                batch.column("_item").take(own), pa.array([whole[k] for k, _, _ in rows], pa.binary()), pa.array([a - int(at[k]) for k, a, _ in rows], pa.int64()), pa.array([-(-(z - a) // settings.hop) for _, a, z in rows], pa.int64()),
                pa.array([words[a:z].tobytes() for _, a, z in rows], pa.binary()), pa.array([answer[k] for k, _, _ in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_item", "_whole", "_place", "_passages", "_words", "_answer"])

    kinds = (("_whole", T.BinaryType()), ("_place", T.LongType()), ("_passages", T.LongType()), ("_words", T.BinaryType()), ("_answer", T.BinaryType()))
    return items.mapInArrow(cut_up, T.StructType([items.schema["_item"], *(T.StructField(n, t) for n, t in kinds)]))


def _leaks(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, settings: Settings, answer_col: str | None = None) -> DataFrame:
    """The pairs found, with the text's MD5: _id, _item, cosine, overlap, _key."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = cut(benchmark.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_text"), answer.alias("_answer")))
    weights = word_weights(docs, items, settings)
    basis = latent_basis(items, weights, settings) * weights[:, None]
    basis = np.ascontiguousarray(np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)]))
    model = spark.sparkContext.broadcast((basis, weights))
    schema = T.StructType([docs.schema["_id"], items.schema["_item"], T.StructField("cosine", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("_key", T.BinaryType())])
    out = spark.createDataFrame([], schema)
    sections = cut(_sections(items, settings))
    blocks = -(-(sections.agg(F.sum("_passages")).first()[0] or 0) // settings.block)
    for k in range(blocks):
        block = sections.where(F.pmod(F.xxhash64("_whole"), F.lit(blocks)) == k).collect()  # all sections of an item
        out = out.unionByName(_search(docs, block, model, settings, schema)) if block else out
    return out


class Block:
    """The passages, runs and words of some sections of items."""

    def __init__(self, rows: list, basis: np.ndarray, weights: np.ndarray, settings: Settings):
        self.names = [r["_item"] for r in rows]
        self.words = [np.frombuffer(r["_words"], np.uint64) for r in rows]
        self.answers = [np.frombuffer(r["_answer"], np.uint64) for r in rows]
        self.sizes = np.array([len(w) for w in self.words])
        # Items of more than one section are known as a whole too, under a number behind those of the sections.
        parts: dict[bytes, dict[int, int]] = {}
        for k, r in enumerate(rows):
            parts.setdefault(bytes(r["_whole"]), {})[r["_place"]] = k
        self.whole = list(range(len(rows)))
        longer = {name: len(rows) + j for j, name in enumerate(n for n, x in parts.items() if len(x) > 1)}
        for k, r in enumerate(rows):
            self.whole[k] = longer.get(bytes(r["_whole"]), k)
        words, at = np.concatenate(self.words), np.concatenate([[0], np.cumsum(self.sizes)])
        hops, _ = _hops(at, settings)
        self.latent = _unit(_passages(basis, _bucket(words, settings), at, hops, settings))
        self.hops, self.owner = hops, np.searchsorted(hops, np.arange(hops[-1]), "right") - 1
        self.runs = {}
        for width in sorted({min(settings.exact, int(n)) for n in self.sizes}):
            of = np.flatnonzero(np.minimum(settings.exact, self.sizes) == width)
            part = np.concatenate([self.words[k] for k in of])
            ends = np.concatenate([[0], np.cumsum(self.sizes[of])])
            hashes, starts = _runs(part, ends, width)
            order = np.argsort(hashes, kind="stable")
            self.runs[width] = hashes[order], of[np.searchsorted(ends, starts[order], "right") - 1]
        self.weights, self.settings, self.known = weights, settings, {}
        # What a place must have: marks of the section's words, and of its informative ones where it has no answer.
        self.marks = _marks(words, np.repeat(np.arange(len(rows)), self.sizes), len(rows))
        for name in longer:
            own = [k for _, k in sorted(parts[name].items())]
            self.words.append(np.concatenate([self.words[k] for k in own]))
            self.answers.append(self.answers[own[0]])
        told = [np.fromiter(self.section(k)[2], np.uint64) for k in range(len(rows))]
        self.known = {}
        self.told = _marks(np.concatenate(told), np.repeat(np.arange(len(rows)), [len(x) for x in told]), len(rows))
        bits, told_bits = (np.bitwise_count(m).sum(axis=1).astype(np.int64) for m in (self.marks, self.told))
        n = np.array([len(x) for x in told])
        self.least = bits - np.floor((1 - settings.overlap) * self.sizes + 1e-9)
        alone = [len(self.answers[k]) == 0 and self.whole[k] == k for k in range(len(rows))]
        self.least_told = np.where(alone, np.ceil(settings.answer * n - 1e-9) - (n - told_bits), 0)

    def section(self, k: int) -> tuple[int, dict[int, int], set[int]]:
        """Size, places of each word as bits, and the informative words of a section."""
        if k not in self.known:
            mine, masks = self.words[k].tolist(), {}
            for p, w in enumerate(mine):
                masks[w] = masks.get(w, 0) | 1 << p
            rank = sorted(masks, key=lambda w: (-self.weights[w % self.settings.buckets], w))
            self.known[k] = len(mine), masks, set(rank[: max(1, len(rank) // 2)])
        return self.known[k]

    def answered(self, k: int, region: list[int]) -> bool:
        """Whether the item's answer is in the region, in one piece; without an answer, enough informative words."""
        if len(answer := self.answers[k].tolist()):
            return any(region[p : p + len(answer)] == answer for p in range(len(region) - len(answer) + 1))
        informative = self.section(k)[2]
        return len(informative.intersection(region)) >= self.settings.answer * len(informative)


def _candidates(block: Block, vectors: np.ndarray, words: np.ndarray, at: np.ndarray, hop_of: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hop, section, cosine) of the places that are near a passage of a section, or share a run of words with it."""
    found = []
    step = max(1, settings.cosines // len(block.latent))
    for low in range(0, len(vectors), step):
        likeness = vectors[low : low + step] @ block.latent.T
        near, of = np.nonzero(likeness >= settings.cosine)
        found.append((near + low, block.owner[of], likeness[near, of]))
    for width, (hashes, sections) in block.runs.items():
        mine, starts = _runs(words, at, width)
        low, high = np.searchsorted(hashes, mine), np.searchsorted(hashes, mine, "right")
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        which = np.repeat(low[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append((hop_of[np.repeat(starts[hit], many)], sections[which], np.full(len(which), -1.0, np.float32)))
    hop, section, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-cosine, section, hop))
    hop, section, cosine = hop[order], section[order], cosine[order]
    first = np.append(True, (hop[1:] != hop[:-1]) | (section[1:] != section[:-1])) if len(hop) else np.zeros(0, bool)
    return hop[first], section[first], cosine[first]


def _search(docs: DataFrame, rows: list, model, settings: Settings, schema: T.StructType) -> DataFrame:
    """The pairs of all documents with a block of sections."""
    sent = docs.sparkSession.sparkContext.broadcast(Block(rows, *model.value, settings))
    kind = to_arrow_type(schema["_item"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, block = model.value[0], sent.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                words, at = _words(part.column("_text"))
                hops, hop_of = _hops(at, settings)
                vectors = _unit(_passages(basis, _bucket(words, settings), at, hops, settings))
                hop, section, cosine = _candidates(block, vectors, words, at, hop_of, settings)
                if not len(hop):
                    continue
                doc = np.searchsorted(hops, hop, "right") - 1
                # Each mark that is missing around the place is a word at least that can't be in the common subsequence.
                around = -(-block.sizes[section] // settings.hop)
                low, high = np.maximum(hop - around, hops[doc]), np.minimum(hop + 2 + around, hops[doc + 1])
                used = block.weights[_bucket(words, settings)] > 0
                marks = _marks(words[used], hop_of[used], int(hops[-1]))
                keep = np.zeros(len(hop), bool)
                for k in range(0, len(hop), 1 << 16):
                    s = slice(k, k + (1 << 16))
                    there, c = _union(marks, low[s], high[s]), section[s]
                    has = lambda m, c=c, there=there: np.bitwise_count(there & m[c]).sum(axis=1)
                    keep[s] = (has(block.marks) >= block.least[c]) & (has(block.told) >= block.least_told[c])
                found: dict[tuple[int, int], list[float]] = {}
                for k in np.flatnonzero(keep).tolist():
                    d, c, place = int(doc[k]), int(section[k]), int(hop[k])
                    hit = found.get((d, c))
                    if hit is None or hit[1] < 1:
                        size, masks, _ = block.section(c)
                        middle = int(at[d]) + (place - int(hops[d])) * settings.hop
                        region = words[max(int(at[d]), middle - size) : min(int(at[d + 1]), middle + 2 * settings.hop + size)].tolist()
                        item = block.whole[c]
                        if item == c and not block.answered(c, region) or (share := lcs(masks, size, region) / size) < settings.overlap - 1e-9:
                            continue
                        if item != c:  # a section of a longer item: some section has the share that the item has, or more
                            size, masks, _ = block.section(item)
                            region = words[max(int(at[d]), middle - size) : min(int(at[d + 1]), middle + 2 * settings.hop + size)].tolist()
                            if not block.answered(item, region) or (share := lcs(masks, size, region) / size) < settings.overlap - 1e-9:
                                continue
                        hit = found.setdefault((d, c), [-1.0, 0.0])
                        hit[1] = max(hit[1], share)
                    if cosine[k] < 0:
                        cosine[k] = (block.latent[block.hops[c] : block.hops[c + 1]] @ vectors[place]).max()
                    hit[0] = max(hit[0], float(cosine[k]))
                if found:
                    docs_at, sections_at = zip(*found, strict=True)
                    texts = part.column("_text").cast(pa.large_string()).cast(pa.large_binary()).take(pa.array(docs_at))
                    keys = pa.array([hashlib.md5(t).digest() for t in texts.to_pylist()], pa.binary())
                    columns = [part.column("_id").take(pa.array(docs_at)), pa.array([block.names[k] for k in sections_at], kind), pa.array([v[0] for v in found.values()]), pa.array([v[1] for v in found.values()]), keys]
                    yield pa.RecordBatch.from_arrays(columns, names=["_id", "_item", "cosine", "overlap", "_key"])

    return docs.mapInArrow(run, schema)


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``df``, all columns, without those that hold a benchmark item, told apart by id and text.

    So of rows with null or equal ids only those whose own text leaks go; a repeated row goes each time. Null and empty
    texts stay; an empty table or benchmark drops nothing. Rows that don't leak are not shuffled, but for few.
    """
    leaks = _leaks(df, benchmark, id_col, text_col, item_id, item_text, settings or Settings())
    of, its_key, own = fresh(df, "_of", "_its_key", "_own")
    leaks = cut(leaks.select(F.col("_id").alias(of), F.col("_key").alias(its_key)).distinct())
    key = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    looked = maybe_in(leaks.select(F.xxhash64(of, its_key).alias("h")))(F.xxhash64(F.col(id_col), key))
    kept = df.where(looked).withColumn(own, key).join(leaks, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(its_key)), "left_anti")
    return df.where(~looked).unionByName(kept.drop(own))
