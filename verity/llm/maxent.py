"""Hashed maximum-entropy language model with a class-factored softmax (operator 4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import cut, mix, pieces, utf8, words_of

#: Stand-ins for the end of a text and for the places before its start.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class Settings:
    """A tree of ``fan`` classes of ``fan`` subclasses of ``fan`` frequent words, and one class for all other words.

    A context has four features: the last of the ``anchors`` most frequent words, the last word, the word before it,
    and the two as a pair. At each level of the tree they are hashed, with the node, to ``rows`` rows of weights.
    ``frequent`` words have their counts broadcast; the counts of others are joined. Each of the ``rounds`` is one
    gradient over all training texts; those after the first change the weights of the classes only. A task takes
    about ``task_tokens`` tokens at least, as it sends sums of a fixed size.
    """

    fan: int = 32
    anchors: int = 64
    rows: int = 1 << 14
    frequent: int = 1 << 18
    rounds: int = 2
    rate: float = 0.5
    damping: float = 20.0
    largest: float = 15.0
    batch: int = 2048
    task_tokens: int = 2_000_000

    def __post_init__(self) -> None:
        if self.fan & (self.fan - 1) or self.rows % self.fan:
            raise ValueError("fan must be a power of two, and rows a multiple of it")

    @property
    def vocabulary(self) -> int:
        return self.fan**3


FEATURES = 4


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, an end after each text, and the texts' offsets into them."""
    words, _, _, at = words_of(data, offsets)
    n = len(offsets) - 1
    bounds = at + np.arange(n + 1)
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))] = words
    return out, bounds


class Lexicon:
    """Frequent words in the order of their hashes, with counts and ranks; ``place`` is set once the tree is made."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total, self.types = hashes[order], counts[order], int(total), int(types)
        #: Where the hashes of each of 2**20 equal ranges start: a range has a few words at most.
        self.start = np.searchsorted(self.hashes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
        self.rank = np.empty(len(order), np.int64)
        self.rank[np.lexsort((self.hashes, -self.counts))] = np.arange(len(order))

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Index of each token, -1 if it isn't frequent."""
        out = np.full(len(tokens), -1)
        bucket = (tokens >> np.uint64(44)).astype(np.int64)
        at, left = self.start[bucket], self.start[bucket + 1]
        todo = np.flatnonzero(at < left)
        at, left, wanted = at[todo], left[todo], tokens[todo]
        while len(todo):
            hit = self.hashes[at] == wanted
            out[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < left)
            todo, at, left, wanted = todo[more], at[more] + 1, left[more], wanted[more]
        return out


def last_anchors(rank: np.ndarray, bounds: np.ndarray, settings: Settings) -> np.ndarray:
    """The rank of the last anchor before each token in its text; ``anchors`` - 1 where there is none."""
    none = settings.anchors - 1
    places = np.where((rank >= 0) & (rank < none), np.arange(len(rank)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(places)[:-1]]) if len(rank) else places
    return np.where(last >= np.repeat(bounds[:-1], np.diff(bounds)), rank[np.maximum(last, 0)], none)


def class_tree(near: np.ndarray, counts: np.ndarray, settings: Settings) -> np.ndarray:
    """Place of each word in the tree, from how often it follows each anchor (words by anchors).

    Words are halved along the principal direction of their shares of anchors, again and again, so words in like
    company, such as those of one language, end up in one class; small sets are halved by frequency.
    """
    if not len(counts):
        return np.zeros(0, np.int64)
    share = (near.sum(axis=0) + 1e-9) / (near.sum() + 1e-9 * settings.anchors)
    x = np.sqrt((near + 0.5 * share) / (near.sum(axis=1, keepdims=True) + 0.5))
    x -= np.average(x, axis=0, weights=counts)
    x = x @ np.linalg.eigh((x * counts[:, None]).T @ x)[1][:, -8:]
    place = np.empty(len(counts), np.int64)
    todo = [(np.arange(len(counts)), 0, settings.vocabulary)]
    while todo:
        of, base, room = todo.pop()
        if room == 1 or len(of) == 1:
            place[of] = base
            continue
        along = -counts[of]
        if len(of) > 16:
            y = x[of] - np.average(x[of], axis=0, weights=counts[of])
            v = np.linalg.eigh((y * counts[of][:, None]).T @ y)[1][:, -1]
            along = y @ (v * np.sign(v[np.argmax(np.abs(v))]))
        order = of[np.argsort(along, kind="stable")]
        half = -(-len(of) // 2)
        todo += [(order[:half], base, room // 2), (order[half:], base + room // 2, room // 2)] if half < len(of) else [(order, base, room // 2)]
    return place


class Tree:
    """The words of the tree by lexicon index, and the log probabilities of its nodes without a context."""

    def __init__(self, lexicon: Lexicon, place: np.ndarray, settings: Settings):
        """``place`` is -1 for words outside the tree."""
        fan, inside = settings.fan, place >= 0
        self.place = place
        own = np.full(settings.vocabulary, 1e-9)  # places without a word
        own[place[inside]] = lexicon.counts[inside]
        #: All words outside share this mass: their counts plus one each, and one for the unseen.
        self.outside = float(lexicon.total - lexicon.counts[inside].sum() + lexicon.types - inside.sum() + 1)
        classes, subs = own.reshape(fan, -1).sum(axis=1), own.reshape(fan, fan, fan).sum(axis=2)
        first = np.append(classes, self.outside)
        self.base = [first / first.sum(), subs / subs.sum(axis=1, keepdims=True), (own.reshape(fan * fan, fan) / subs.reshape(-1, 1))]
        self.logs = [np.log(p).astype(np.float32) for p in self.base]

    def levels(self, place: np.ndarray, settings: Settings) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: the tokens that get there, their node, and the child that they take."""
        fan, every, inside = settings.fan, np.arange(len(place)), np.flatnonzero(place >= 0)
        p = place[inside]
        return [(every, np.zeros(len(place), np.int64), np.where(place >= 0, place // fan**2, fan)), (inside, p // fan**2, p // fan % fan), (inside, p // fan, p % fan)]


def contexts(tokens: np.ndarray, bounds: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(FEATURES, tokens) hashes of the features; places before the start of a text count as START."""
    place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
    back = []
    for k in (1, 2):
        x = np.full(len(tokens), START)
        x[k:] = np.where(place[k:] >= k, tokens[:-k], START) if len(tokens) > k else x[k:]
        back.append(x)
    odd = np.uint64(0x9E3779B97F4A7C15)
    parts = [anchors.astype(np.uint64), back[0], back[1], mix(back[0] * odd) ^ back[1]]
    return np.stack([mix(p * odd + np.uint64(k)) for k, p in enumerate(parts)])


def weight_rows(features: np.ndarray, node: np.ndarray, level: int, settings: Settings) -> np.ndarray:
    """(FEATURES, tokens) rows of weights: the feature hashed with the node; at the last level a row has one subclass."""
    if not level:
        return (features % np.uint64(settings.rows)).astype(np.int64)
    fan = np.uint64(settings.fan)
    odd = np.uint64(0xC4CEB9FE1A85EC53)
    if level == 1:
        return (mix(features + (node.astype(np.uint64) + np.uint64(1)) * odd) % np.uint64(settings.rows)).astype(np.int64)
    own, sub = node.astype(np.uint64) // fan, node.astype(np.uint64) % fan
    return ((mix(features + (own + np.uint64(999)) * odd) % (np.uint64(settings.rows) // fan)) * fan + sub).astype(np.int64)


def probabilities(weights: np.ndarray, logs: np.ndarray, rows: np.ndarray, node: np.ndarray, settings: Settings) -> Iterator[tuple[slice, np.ndarray]]:
    """The children's probabilities for each token, in cache-sized runs of tokens. A run's array is used again for the next.

    Weights are at most ``largest`` in size, so no exponent is too large for what holds it.
    """
    logs = logs.reshape(-1, logs.shape[-1])
    ones = np.ones(logs.shape[1], np.float32)
    room, more = np.empty((settings.batch, logs.shape[1]), np.float32), np.empty((settings.batch, logs.shape[1]), np.float32)
    for low in range(0, len(node), settings.batch):
        part = slice(low, low + settings.batch)
        z, w = room[: len(node[part])], more[: len(node[part])]
        np.take(logs, node[part], axis=0, out=z, mode="clip")
        for k in range(FEATURES):
            np.take(weights, rows[k, part], axis=0, out=w, mode="clip")
            z += w
        np.exp(z, out=z)
        z *= (1 / (z @ ones))[:, None]
        yield part, z


def token_scores(tree: Tree, weights: list[np.ndarray], lexicon: Lexicon, tokens: np.ndarray, bounds: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log of the model's probability of each token less that of its outside word; counts (-1 if not frequent); outside flags."""
    found = lexicon.find(tokens)
    frequent = found >= 0
    features = contexts(tokens, bounds, last_anchors(np.where(frequent, lexicon.rank[found], -1) if len(lexicon.rank) else found, bounds, settings))
    place = np.where(frequent, tree.place[found], -1) if len(lexicon.rank) else found
    out = np.zeros(len(tokens))
    for level, (of, node, child) in enumerate(tree.levels(place, settings)):
        rows = weight_rows(features[:, of], node, level, settings)
        for part, p in probabilities(weights[level], tree.logs[level], rows, node, settings):
            out[of[part]] += np.log(np.maximum(p[np.arange(len(p)), child[part]], 1e-30).astype(np.float64))
    return out, np.where(frequent, lexicon.counts[found], -1) if len(lexicon.rank) else found, place < 0


def held_out(id_col: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text, modulo 7, is 2. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def count_tokens(texts: DataFrame) -> DataFrame:
    """(h, n) of all training tokens, summed within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for part in pieces(batch, "_text"):
                held.append(tokens_of(*utf8(part.column("_text")))[0])
                size += len(held[-1])
                if size > 8_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def summed(texts: DataFrame, tokens: int, sizes: list[int], kind: str, fill: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], None], settings: Settings) -> list[np.ndarray]:
    """Sums over all texts of arrays of fixed ``sizes``: ``fill`` adds those of some tokens to a task's own arrays.

    A task sends its arrays once, in blocks; they are summed by block and salt and then by block, each time in a stream
    that holds one block. The number of tasks follows from the number of tokens, so what is sent stays a fixed part of
    the input however finely it is dealt. The driver gets the sums only.
    """
    blocks = -(-sum(sizes) // (1 << 15))
    wide = "<f8" if kind == "<f4" else "<i8"

    def rows(b: list[int], salt: int, m: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([salt] * len(b), pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], names=["b", "salt", "m"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, seen = [np.zeros(n, wide) for n in sizes], 0
        for batch in batches:
            for part in pieces(batch, "_text", 2 << 20):
                words, bounds = tokens_of(*utf8(part.column("_text")))
                fill(words, bounds, arrays)
                seen += 1
        if seen:
            yield rows(list(range(blocks)), seen % 61, np.array_split(np.concatenate(arrays).astype(kind), blocks))

    def total(batches: Iterator[pa.RecordBatch], sent_as: str = wide) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(m, sent_as).astype(wide)
        if sums:
            yield rows(list(sums), 0, list(sums.values()))

    schema = "b int, salt int, m binary"
    sent = texts.coalesce(max(1, tokens // settings.task_tokens)).mapInArrow(gather, schema)
    once = sent.repartition("b", "salt").mapInArrow(lambda batches: total(batches, kind), schema)
    out: list[np.ndarray] = [np.zeros(0)] * blocks
    for row in once.repartition("b").mapInArrow(total, schema).collect():
        out[row["b"]] = np.frombuffer(row["m"], wide)
    whole = np.concatenate(out) if all(len(x) for x in out) else np.zeros(sum(sizes))
    return np.split(whole, np.cumsum(sizes)[:-1])


def train(texts: DataFrame, lexicon: Lexicon, settings: Settings) -> tuple[Tree, list[np.ndarray]]:
    """The class tree and its weights, from gradients that are summed over all texts.

    The gradient of a weight is how often its feature and child are seen together, less how often the model expects
    them to be. A step is the damped log of seen over expected, as in iterative scaling, which needs no further scale.
    Before the first step the model knows no context, so what it expects follows from how often the rows meet the nodes:
    counting is enough. Later rounds sum the expectations of the trained model. All sums are over the whole corpus,
    so neither the order of the texts nor the number of tasks changes the model.
    """
    spark, fan = texts.sparkSession, settings.fan
    n, width = settings.rows, settings.fan + 1
    sent = spark.sparkContext.broadcast(lexicon)
    known = np.flatnonzero(lexicon.rank < settings.vocabulary)

    def company(words: np.ndarray, bounds: np.ndarray, arrays: list[np.ndarray]) -> None:
        found = sent.value.find(words)
        rank = np.where(found >= 0, sent.value.rank[found], -1)
        inside = (rank >= 0) & (rank < settings.vocabulary)
        arrays[0] += np.bincount(rank[inside] * settings.anchors + last_anchors(rank, bounds, settings)[inside], minlength=len(arrays[0]))

    near = summed(texts, lexicon.total, [settings.vocabulary * settings.anchors], "<i4", company, settings)[0].reshape(-1, settings.anchors)
    place = np.full(len(lexicon.rank), -1)
    place[known] = class_tree(near[lexicon.rank[known]].astype(float), lexicon.counts[known].astype(float), settings)
    tree = Tree(lexicon, place, settings)
    tree_sent = spark.sparkContext.broadcast(tree)

    def seen(words: np.ndarray, bounds: np.ndarray, arrays: list[np.ndarray]) -> None:
        lexicon, tree = sent.value, tree_sent.value
        found = lexicon.find(words)
        features = contexts(words, bounds, last_anchors(np.where(found >= 0, lexicon.rank[found], -1), bounds, settings))
        for level, (of, node, child) in enumerate(tree.levels(np.where(found >= 0, tree.place[found], -1), settings)):
            rows = weight_rows(features[:, of], node, level, settings)
            arrays[level] += np.bincount((rows * (fan if level else width) + child).reshape(-1), minlength=len(arrays[level]))
            if level:
                arrays[level + 2] += np.bincount((rows * fan + node // (fan if level == 2 else 1)).reshape(-1), minlength=n * fan)

    first, second, third, by_class, by_class_3 = summed(texts, lexicon.total, [n * width, *[n * fan] * 4], "<i4", seen, settings)
    observed = [first.reshape(n, width), second.reshape(n, fan), third.reshape(n, fan)]
    last = np.einsum("rsc,csk->rsk", by_class_3.reshape(n // fan, fan, fan), tree.base[2].reshape(fan, fan, fan), optimize=True)
    expected = [observed[0].sum(axis=1, keepdims=True) * tree.base[0], by_class.reshape(n, fan) @ tree.base[1], last.reshape(n, fan)]
    damping = [settings.damping * e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9) + 1e-6 for e in expected]

    def step(o: np.ndarray, e: np.ndarray, d: np.ndarray) -> np.ndarray:
        return settings.rate * np.log((o + d) / (e + d))

    def bounded(w: np.ndarray) -> np.ndarray:
        return np.clip(w, -settings.largest, settings.largest).astype(np.float32)

    weights = [bounded(step(*x)) for x in zip(observed, expected, damping, strict=True)]
    for _ in range(settings.rounds - 1):
        now = spark.sparkContext.broadcast(weights[0])

        def expect(words: np.ndarray, bounds: np.ndarray, arrays: list[np.ndarray], now=now) -> None:
            lexicon, tree = sent.value, tree_sent.value
            found = lexicon.find(words)
            features = contexts(words, bounds, last_anchors(np.where(found >= 0, lexicon.rank[found], -1), bounds, settings))
            rows, out = weight_rows(features, found, 0, settings), arrays[0].reshape(width, n)
            held = np.empty((width, 1 << 16), np.float32)  # so many tokens at a time; children by tokens sum faster
            for low in range(0, len(words), held.shape[1]):
                some = rows[:, low : low + held.shape[1]]
                for part, p in probabilities(now.value, tree.logs[0], some, np.zeros(some.shape[1], np.int64), settings):
                    held[:, part.start : part.start + len(p)] = p.T
                for k in range(FEATURES):
                    for c in range(width):
                        out[c] += np.bincount(some[k], held[c, : some.shape[1]], minlength=n)

        model = summed(texts, lexicon.total, [n * width], "<f4", expect, settings)[0].reshape(width, n).T
        weights[0] = bounded(weights[0] + step(observed[0], model, damping[0]))
    return tree, weights


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Log10 probability of every whole text by the model and by the add-one unigram base.

    Tokens are the words, A-Z in lower case, and an end. Training uses all rows that aren't held out. Words are
    known by a 64-bit hash. Words outside the tree have the probability of their common class times their
    add-one share in it, which leaves one place for all unseen words; so both models give every text a finite score.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row. Null counts as
    empty: its one token is the end. Repeated rows count each time; null ids are trained on as the hash of the empty
    text tells; an empty table gives none.
    """
    settings = settings or Settings()
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = docs.where(~held_out(F.col("_id")))
    counts = cut(count_tokens(texts))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("types")).first()
    top = counts.orderBy(F.desc("n"), "h").limit(settings.frequent).toArrow()
    lexicon = Lexicon(top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), size["total"], size["types"])
    tree, weights = train(texts, lexicon, settings)
    sent = spark.sparkContext.broadcast((tree, weights, lexicon))
    schema = T.StructType(
        [docs.schema["_id"], *(T.StructField(n, T.LongType()) for n in ("n_tokens", "known", "outside")), T.StructField("logs", T.DoubleType()), T.StructField("model", T.DoubleType())]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("rare", "times")]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, lexicon = sent.value
        for batch in batches:
            for part in pieces(batch, "_text"):
                tokens, bounds = tokens_of(*utf8(part.column("_text")))
                n = part.num_rows
                of = np.repeat(np.arange(n), np.diff(bounds))
                model, found, outside = token_scores(tree, weights, lexicon, tokens, bounds, settings)
                logs = np.log10(np.maximum(found, 0) + 1.0)
                total = lambda v, of=of, n=n: np.bincount(of, v, minlength=n)
                rare = np.flatnonzero(found < 0)
                order = np.lexsort((tokens[rare], of[rare]))
                r, h = of[rare][order], tokens[rare][order]
                first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(r)))
                ends = pa.array(np.searchsorted(r[first], np.arange(n + 1)).astype(np.int32))
                columns = [
                    part.column(0), pa.array(np.diff(bounds)), pa.array(total(found >= 0).astype(np.int64)), pa.array(total(outside).astype(np.int64)),
                    pa.array(total(logs)), pa.array(total(model / LOG10 + np.where(outside & (found >= 0), logs, 0))),
                    pa.ListArray.from_arrays(ends, pa.array(h[first].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    scored = cut(docs.mapInArrow(score, schema).withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode_outer(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("h"), F.col("x.times").alias("times")).where("h IS NOT NULL")
    # A word without a count adds log10(1) = 0 and is not known, so an inner join is enough.
    more = rare.join(counts, "h").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_logs"), F.sum("times").alias("_known"))
    out = scored.drop("rare", "times").join(more, "_row", "left").fillna(0, ["_logs", "_known"])
    base = F.col("logs") + F.col("_logs") - F.col("n_tokens") * F.log10(F.lit(float(lexicon.total + lexicon.types + 1)))
    model = F.col("model") + F.col("_logs") - F.col("outside") * F.log10(F.lit(tree.outside))
    return out.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "n_tokens", (F.col("known") + F.col("_known")).alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"), base.alias("base_score"), model.alias("score")
    )
