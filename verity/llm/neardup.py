"""N-gram Jaccard join with Bayesian candidate pruning (operator 7)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import BASE, cut, discard, flag_words, fresh, maybe_in, mix, pieces, powers, utf8, words_of
from verity.llm.components import components


@dataclass(frozen=True)
class Settings:
    """``bands`` of ``rows`` MinHash values find candidates; ``step`` values at a time are compared to prune them.

    With the defaults, 32 bands of 5 find a pair of similarity 0.8 but for 3 in a million, and pruning loses a pair
    of that similarity with a probability below ``tolerance`` at each of its ten looks. Bands are made of whole values;
    the low eight bits of each are kept for the comparisons.
    """

    width: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    step: int = 16
    tolerance: float = 1e-9
    #: Most texts and shingles (on average) in a block; blocks of a large group are compared two by two.
    block_texts: int = 512
    block_shingles: int = 500_000
    #: Most texts of a bucket whose pairs are compared; those of a larger one all get an edge to its first.
    bucket: int = 4096
    #: Bits of the flags that tell which bands occur twice.
    flags: int = 24
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 1 << 32, self.hashes, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, self.hashes, np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the windows of ``width`` words of each text, with repeats, and the texts' offsets into them.

    A text of fewer words has one window of them all; one without words has none. Letters A-Z count as a-z.
    """
    words, _, _, at = words_of(data, offsets)
    counts = np.diff(at)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    starts = np.arange(bounds[-1]) - np.repeat(bounds[:-1], made) + np.repeat(at[:-1], made)
    held = np.repeat(np.minimum(counts, width), made)
    total = held.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k, factor in enumerate(powers(BASE, width + 1)[1:]):
        total += np.where(k < held, padded[starts + k] * factor, np.uint64(0))
    return mix(total), bounds


def signatures(values: np.ndarray, bounds: np.ndarray, settings: Settings) -> np.ndarray:
    """MinHash values (texts, hashes); a text without shingles has the largest values. Works in cache-sized runs."""
    a, b = settings.parameters()
    out = np.full((len(bounds) - 1, settings.hashes), 0xFFFFFFFF, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    k = 0
    while k < len(full):
        stop = max(k + 1, int(np.searchsorted(bounds[full + 1], bounds[full[k]] + (1 << 16), "right")))
        rows = full[k:stop]
        low, high = bounds[rows[0]], bounds[rows[-1] + 1]
        part, starts = x[low:high], bounds[rows] - low
        room = np.empty_like(part)
        for h in range(settings.hashes):
            np.multiply(part, a[h], out=room)
            np.add(room, b[h], out=room)
            out[rows, h] = np.minimum.reduceat(room, starts)
        k = stop
    return out


def band_keys(table: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band's number is part of it."""
    parts = table.reshape(len(table), settings.bands, settings.rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(settings.rows):
        keys = mix(keys * np.uint64(BASE) + parts[:, :, k])
    return keys.view(np.int64)


@functools.cache
def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped) after each step.

    With a uniform prior, m matches of n leave a Beta(m + 1, n - m + 1) posterior, whose mass at or above t is the
    probability that a Binomial(n + 1, t) is at most m. Values that differ agree in their low eight bits once in 256,
    so t is the probability of a match at the threshold.
    """
    out, t = [], settings.threshold + (1 - settings.threshold) / 256
    for n in range(settings.step, settings.hashes + 1, settings.step):
        mass, m = 0.0, -1
        while m < n and (mass := mass + math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)) < settings.tolerance:
            m += 1
        out.append((n, m + 1))
    return out


def similar_pairs(left: list[int], right: list[int], same: bool, sig: np.ndarray, sets: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``) whose sets have a Jaccard similarity of the threshold or more."""
    n = np.array([len(s) for s in sets], np.int64)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    small, big = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    alive = (small >= settings.threshold * big - 1e-9) & (big > 0)
    if same:
        alive &= left[:, None] < right[None, :]
    looks = least_matches(settings)
    matches = np.zeros(alive.shape, np.int16)
    for h in range(settings.step):  # the first look is at all pairs
        matches += sig[left, h][:, None] == sig[right, h][None, :]
    alive &= matches >= looks[0][1]
    i, j = np.nonzero(alive)
    count, i, j = matches[i, j].astype(np.int64), left[i], right[j]
    for upto, least in looks[1:]:
        kept = []
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            count[part] += (sig[i[part], upto - settings.step : upto] == sig[j[part], upto - settings.step : upto]).sum(axis=1)
            kept.append(count[part] >= least)
        if kept:
            keep = np.concatenate(kept)
            i, j, count = i[keep], j[keep], count[keep]
    if not len(i):
        return i, j
    bounds = np.concatenate([[0], np.cumsum(n)])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(names.max()) + 1, np.int32)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    common = np.zeros(len(i), np.int64)
    for k, stop in zip(*(lambda u: (u, np.append(u[1:], len(i))))(np.unique(i, return_index=True)[1]), strict=True):
        mine = names[bounds[i[k]] : bounds[i[k] + 1]]
        mark[mine] = 1
        for low in range(k, stop, 64):
            others = j[low : min(stop, low + 64)]
            theirs = np.concatenate([names[bounds[o] : bounds[o + 1]] for o in others])
            common[low : low + len(others)] = np.add.reduceat(mark[theirs], np.concatenate([[0], np.cumsum(n[others])[:-1]]))
        mark[mine] = 0
    ok = common >= settings.threshold * (n[i] + n[j] - common) - 1e-9
    return i[ok], j[ok]


def _roots(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over the pairs."""
    root = np.arange(count)
    while len(i):
        least = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _nodes(docs: DataFrame, settings: Settings) -> DataFrame:
    """A row for each distinct text: _key, _rep (least id), _copies, _n, _sig, _bands and the number _node."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                values, bounds = shingles(*utf8(part.column("_text")), settings.width)
                table = signatures(values, bounds, settings)
                bands = band_keys(table, settings)
                columns = [part.column("_id"), part.column("_key"), pa.array(np.diff(bounds)), _rows(table.astype(np.uint8)), _rows(bands)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "_n", "_sig", "_bands"])

    schema = T.StructType([docs.schema["_id"], docs.schema["_key"], T.StructField("_n", T.LongType()), T.StructField("_sig", T.BinaryType()), T.StructField("_bands", T.BinaryType())])
    signed = docs.mapInArrow(sign, schema)
    nodes = signed.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), *(F.first(c).alias(c) for c in ("_n", "_sig", "_bands")))
    return cut(nodes.withColumn("_node", F.monotonically_increasing_id()))


def _rows(table: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    width = table.shape[1] * table.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(table), [None, pa.py_buffer(np.ascontiguousarray(table))]).cast(pa.binary())


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def surviving(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, settings: Settings) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) the posterior leaves, ``step`` values at a time."""
    alive, count = np.arange(len(i)), np.zeros(len(i), np.int64)
    for upto, least in least_matches(settings):
        if not len(alive):
            break
        part = slice(upto - settings.step, upto)
        count += (a[i[alive], part] == b[j[alive], part]).sum(axis=1)
        keep = count >= least
        alive, count = alive[keep], count[keep]
    return alive


def linked(sig: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span what the posterior leaves of all pairs of a bucket.

    From each text reached, only texts not yet reached are compared, so a bucket of copies takes one pass and a bucket
    of unlike texts ends at the first look.
    """
    left, queue, ups, downs = np.arange(1, len(sig)), [0], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        x = queue.pop()
        alive = left[surviving(sig[x : x + 1], sig, np.zeros(len(left), np.int64), left, settings)]
        if len(alive):
            ups.append(np.full(len(alive), x))
            downs.append(alive)
            queue.extend(alive.tolist())
            left = left[~np.isin(left, alive, assume_unique=True)]
    none = np.zeros(0, np.int64)
    return (np.concatenate(ups), np.concatenate(downs)) if ups else (none, none)


def _candidates(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Edges (u, v) that connect all pairs which share a band and whose posterior doesn't drop them.

    Bands are counted first; only rows of bands that occur twice carry their signatures to the buckets. A bucket's
    pairs are compared in its task and only edges that span what is left go out. In a bucket of more than
    ``bucket`` texts each has an edge to the first instead, which connects all pairs and drops none; buckets with over
    a thousandth of all band rows (1,000 at most) get those edges before any shuffle.
    """
    some = nodes.where("_n > 0").select("_node", "_sig", "_bands")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys = _matrix(part.column("_bands"), np.int64, settings.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column("_node").to_numpy(), settings.bands))], names=["_band", "_node"])

    bands = some.select("_node", "_bands").mapInArrow(emit, "_band long, _node long")
    shared = cut(bands.groupBy("_band").agg(F.min("_node").alias("_lead"), F.count(F.lit(1)).alias("_c")).where("_c > 1"))
    total = shared.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    hot = shared.where(F.col("_c") > max(settings.bucket, total // 1000)).select("_band", "_lead").toArrow()
    hot_bands, leads = hot.column(0).to_numpy(), hot.column(1).to_numpy()
    order = np.argsort(hot_bands)
    hot_bands, leads = hot_bands[order], leads[order]
    words = flag_words(shared.select("_band"), settings.flags).toArrow()
    flags = np.zeros(1 << (settings.flags - 6), np.uint64)
    flags[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    discard(shared)
    sent = nodes.sparkSession.sparkContext.broadcast((flags, hot_bands, leads))

    def shared_rows(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        flags, hot_bands, _ = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                keys = _matrix(part.column("_bands"), np.int64, settings.bands).reshape(-1)
                place = keys.view(np.uint64) & np.uint64((1 << settings.flags) - 1)
                set_ = (flags[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                at = np.flatnonzero((set_ == 1) & (np.isin(keys, hot_bands) == hot))
                yield part, keys[at], at // settings.bands

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, at in shared_rows(batches, False):
            chosen = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("_node").take(chosen), part.column("_sig").take(chosen)], names=["_band", "_node", "_sig"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot_bands, leads = sent.value
        for part, keys, at in shared_rows(batches, True):
            yield pa.RecordBatch.from_arrays([part.column("_node").take(pa.array(at)), pa.array(leads[np.searchsorted(hot_bands, keys)])], names=["u", "v"])

    def edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def finished(keys: np.ndarray, node: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The edges of whole buckets; those of two texts, which are most, are compared all at once."""
        if not len(keys):
            return
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        first = starts[sizes == 2]
        kept = first[surviving(sig, sig, first, first + 1, settings)]
        yield edges(node[kept + 1], node[kept])
        for a, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if n > settings.bucket:
                yield edges(node[a : a + n], np.full(n, node[a]))
            else:
                i, j = linked(sig[a : a + n], settings)
                yield edges(node[a + j], node[a + i])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, node, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, settings.hashes), np.uint8)
        large = None  # (band, first text) of a bucket that is too large to be held
        for batch in batches:
            keys, node = np.append(keys, batch.column(0).to_numpy()), np.append(node, batch.column(1).to_numpy())
            sig = np.concatenate([sig, _matrix(batch.column(2), np.uint8, settings.hashes)])
            if large and (n := int(np.searchsorted(keys, large[0], "right"))):
                yield edges(node[:n], np.full(n, large[1]))
                keys, node, sig = keys[n:], node[n:], sig[n:]
            if not len(keys):
                continue
            large, last = None, int(np.searchsorted(keys, keys[-1]))
            yield from finished(keys[:last], node[:last], sig[:last])
            keys, node, sig = keys[last:], node[last:], sig[last:]
            if len(keys) > settings.bucket:
                large = (keys[0], node[0])
                yield edges(node, np.full(len(node), node[0]))
                keys, node, sig = keys[:0], node[:0], sig[:0]
        yield from finished(keys, node, sig)

    found = some.mapInArrow(deal, "_band long, _node long, _sig binary").repartition("_band").sortWithinPartitions("_band", "_node").mapInArrow(compare, "u long, v long")
    if len(hot_bands):
        found = found.unionByName(some.mapInArrow(star, "u long, v long"))
    return found.where("u <> v")


def _links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """(_node, _links, _root) from each pair of blocks in which the node has a link.

    ``groups`` has (node, root) of the candidate graph. A group of more than a block is dealt into blocks by hash;
    each two blocks meet in one task, which counts links and never lists the pairs.
    """
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = members.join(nodes.select(F.col("_node").alias("node"), "_key", "_rep", "_copies", "_n", "_sig"), "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / settings.block_texts), F.ceil(F.sum("_n") / settings.block_shingles)).cast("int").alias("_blocks"))
    members = cut(members.join(sizes, "root"))
    # Only the rows that stand for a member, and few others, are shuffled with their texts.
    wanted = maybe_in(members.select(F.xxhash64("_rep", "_key").alias("h")))
    text = docs.where(wanted(F.xxhash64("_id", "_key"))).select(F.col("_id").alias("_of"), F.col("_key").alias("_k"), "_text")
    texts = text.join(members, (F.col("_k") == F.col("_key")) & F.col("_of").eqNullSafe(F.col("_rep")))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                values, bounds = shingles(*utf8(part.column("_text")), settings.width)
                sets = [np.unique(values[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                names = ["root", "node", "_copies", "_blocks", "_sig"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], names=[*names, "_set"])

    fields = "root long, node long, _copies long, _blocks int, _sig binary, _set binary"
    sets = texts.select("root", "node", "_copies", "_blocks", "_sig", "_text").mapInArrow(cut_up, fields)
    sets = sets.withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    dealt = sets.select("*", F.explode_outer(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")).select("root", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "node", "_copies", "_sig", "_set")
    place = ["root", "_i", "_j"]

    def verify(rows: list[dict]) -> pa.RecordBatch | None:
        rows = [r for k, r in enumerate(rows) if not k or r["node"] != rows[k - 1]["node"]]  # repeated rows
        same = rows[0]["_i"] == rows[0]["_j"]
        left = [k for k, r in enumerate(rows) if r["_b"] == r["_i"]]
        right = left if same else [k for k, r in enumerate(rows) if r["_b"] == r["_j"]]
        sig = np.frombuffer(b"".join(r["_sig"] for r in rows), np.uint8).reshape(-1, settings.hashes)
        i, j = similar_pairs(left, right, same, sig, [np.frombuffer(r["_set"], np.uint64) for r in rows], settings)
        if not len(i):
            return None
        copies, node = np.array([r["_copies"] for r in rows]), np.array([r["node"] for r in rows])
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[_roots(len(rows), i, j)][hit])], names=["_node", "_links", "_root"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    if (now := (row["root"], row["_i"], row["_j"])) != key:
                        if len(rows) > 1 and (out := verify(rows)) is not None:
                            yield out
                        key, rows = now, []
                    rows.append(row)
        if len(rows) > 1 and (out := verify(rows)) is not None:
            yield out

    return dealt.repartition(*place).sortWithinPartitions(*place, "node").mapInArrow(meet, "_node long, _links long, _root long")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def join_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """Class and number of links of every row, by the Jaccard similarity of its word windows.

    Two rows are linked if their texts are equal or at least ``threshold`` similar. Returns id_col, class_id (least
    id that the row reaches over links), n_links (other rows that it is linked to), one row for each row.

    Equal texts are joined first and stand as one with their number, so they never make pairs. Null counts as empty;
    texts without words are linked to equal ones only. A text of fewer than five words is one window. Rows with
    equal ids are separate rows; null ids are least only where a class has no other. An empty table gives none.
    """
    docs, known = _classed(df, id_col, text_col, settings or Settings())
    least = known.groupBy("_class").agg(F.min("_rep").alias("class_id"))
    known = known.join(least, "_class").select("_key", "class_id", "n_links")
    return docs.select("_id", "_key").join(known, "_key").select(F.col("_id").alias(id_col), "class_id", "n_links")


def _classed(df: DataFrame, id_col: str, text_col: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, _key, _text), and a row for each distinct text: _key, _rep (least id), n_links, _class."""
    docs = df.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    nodes = _nodes(docs, settings)
    groups = components(_candidates(nodes, settings))
    found = cut(_links(docs, nodes, groups, settings))
    classes = components(found.select(F.col("_node").alias("u"), F.col("_root").alias("v")))
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    known = nodes.select("_key", "_rep", "_copies", "_node").join(links, "_node", "left").join(classes.withColumnRenamed("node", "_node"), "_node", "left")
    known = cut(known.select("_key", "_rep", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("root", "_node").alias("_class")))
    discard(nodes)
    discard(found)
    return docs, known


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """The rows of ``df``, all columns, with one of each class: the one of least id, once if it is repeated.

    Rows are told apart by id and text, so those with null or equal ids and different texts stand for themselves. Null
    ids come last, and equal ids in a class are told apart by their texts. Null text counts as empty, so rows of null
    and empty text are one class. Columns may have any names; an empty table gives none.

    A row that no other is like is not shuffled with its columns: hashes of the rows to look at are tested first.
    """
    docs, known = _classed(df, id_col, text_col, settings or Settings())
    best = known.groupBy("_class").agg(F.min(F.struct(F.col("_rep").isNull().alias("none"), F.col("_rep").alias("id"), F.col("_key").alias("key"))).alias("_best"))
    seen = docs.select("_id", "_key").join(known.join(best, "_class").select("_key", "_best"), "_key")
    stays = F.col("_id").eqNullSafe(F.col("_best.id")) & (F.col("_key") == F.col("_best.key"))
    rows = cut(seen.groupBy("_id", "_key").agg(F.min(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")).where("NOT _stays OR _n > 1"))
    discard(known)
    own, of, key, keep = fresh(df, "_own", "_of", "_its_key", "_keep")
    looked = maybe_in(rows.select(F.xxhash64("_id", "_key").alias("h")))(F.xxhash64(F.col(id_col), text_key(F.col(text_col))))
    marked = df.where(looked).withColumn(own, text_key(F.col(text_col)))
    marked = marked.join(rows.select(F.col("_id").alias(of), F.col("_key").alias(key), F.col("_stays").alias(keep)), F.col(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(key)), "left")
    once = marked.where(F.col(keep)).dropDuplicates([id_col, own])
    return df.where(~looked).unionByName(marked.where(F.col(keep).isNull()).unionByName(once).drop(own, of, key, keep))
