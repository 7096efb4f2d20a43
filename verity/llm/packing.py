"""Best-fit packing by bin completion (operator 11)."""

from __future__ import annotations

import json
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verity.llm.common import cut, pieces
from verity.llm.sharding import number_within

CAPACITY = 1024
#: Fixed value: the pre-token pattern of the tokenizers library's byte-level files.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
class _Encoder:
    """Encodes texts as a byte-level BPE file of the tokenizers library does.

    Plain texts go through tiktoken with the same pieces and merges, which takes a fifth of the time; texts that spell
    out a special token go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level tokenizers without a prefix space")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("ids don't follow the order of merges")
        self.whole = Tokenizer.from_file(path)
        self.plain = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(x in text for x in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text and an end id, cut into pieces of ``capacity`` tokens where longer; the first may be shorter.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, without special tokens added; those
    that a text spells out count as such. Returns id_col, piece (from 0), start (the document's ids before it), length, ids (binary,
    little-endian unsigned 32-bit). Null and empty texts are the end id alone; repeated rows and null ids are
    documents of their own; other columns are not read; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 22):
                at, piece, start, ids = [], [], [], []
                for row, text in enumerate(part.column("text").fill_null("")):
                    whole = array("I", [*encode(text.as_py()), end_id])
                    edges = [0, *range(len(whole) % capacity or capacity, len(whole) + 1, capacity)]
                    at += [row] * (len(edges) - 1)
                    piece += range(len(edges) - 1)
                    start += edges[:-1]
                    ids += [whole[a:z].tobytes() for a, z in zip(edges, edges[1:], strict=False)]
                columns = [part.column("id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


#: Sizes of one filling with how often each is in it, largest first.
Filling = tuple[tuple[int, int], ...]


def fill_of(filling: Filling) -> int:
    return sum(s * n for s, n in filling)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A bound from below: for each threshold, sizes too large to share a bin, and what the middle ones need beside them."""
    n, total = [0] * (capacity + 2), [0] * (capacity + 2)
    for s, k in counts.items():
        n[s], total[s] = k, s * k
    n, total = list(accumulate(n)), list(accumulate(total))
    half = capacity // 2
    best = -(-total[-1] // capacity)
    for low in [0, *(s for s in counts if s <= half)]:
        high = capacity - low
        large, room = n[high] - n[half], capacity * (n[high] - n[half]) - (total[high] - total[half])
        small = total[half] - total[max(low - 1, 0)]
        best = max(best, n[-1] - n[high] + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best fit of decreasing sizes, for all equal items and bins at once: fillings and how many bins have each."""
    open_bins: dict[int, list[list]] = {}
    done: list[tuple[Filling, int]] = []

    def keep(room: int, filling: Filling, n: int) -> None:
        (open_bins.setdefault(room, []).append([filling, n]) if room else done.append((filling, n)))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            fits, bins, rest = room // size, open_bins.pop(room), []
            for filling, n in bins:
                full, over = min(n, left // fits), 0
                if full:
                    keep(room - fits * size, (*filling, (size, fits)), full)
                    left -= full * fits
                if full < n and (over := min(left, fits - 1 if fits > 1 else 0)):
                    keep(room - over * size, (*filling, (size, over)), 1)
                    left -= over
                if (n := n - full - bool(over)) > 0:
                    rest.append([filling, n])
            if rest:
                open_bins[room] = rest + open_bins.get(room, [])
            if not left:
                break
        fits = capacity // size
        if left >= fits:
            keep(capacity - fits * size, ((size, fits),), left // fits)
        if left % fits:
            keep(capacity - left % fits * size, ((size, left % fits),), 1)
    return done + [(f, n) for bins in open_bins.values() for f, n in bins]


def _fits_in(items: list[int], rooms: list[int]) -> bool:
    """Can ``items`` (largest first) be put into ``rooms``?"""
    if not items:
        return True
    for k in {r: k for k, r in enumerate(rooms)}.values():
        if rooms[k] >= items[0] and _fits_in(items[1:], [*rooms[:k], rooms[k] - items[0], *rooms[k + 1 :]]):
            return True
    return False


def _flat(filling: Filling) -> list[int]:
    return [s for s, n in filling for _ in range(n)]


def completions(counts: dict[int, int], capacity: int, waste: int, width: int) -> list[Filling]:
    """Undominated fillings around the largest size that leave at most ``waste``, the fullest first, ``width`` at most.

    A filling is dominated if another one's items have room for all of its items: what the other leaves is never
    harder to pack. Only fillings to which nothing more can be added count.
    """
    largest = max(counts)
    rest = {**counts, largest: counts[largest] - 1}
    sizes = [s for s in sorted(rest, reverse=True) if rest[s] and s <= capacity - largest]
    after = [0] * (len(sizes) + 1)
    for k in reversed(range(len(sizes))):
        after[k] = after[k + 1] + sizes[k] * rest[sizes[k]]
    found: list[tuple[int, Filling]] = []
    steps, full = [40 * width], [0]

    def extend(k: int, room: int, chosen: Filling) -> None:
        steps[0] -= 1
        if steps[0] < 0 or full[0] >= width or room - after[k] > waste:
            return
        while k < len(sizes) and sizes[k] > room:
            k += 1
        if room == 0 or k == len(sizes):
            if room <= waste:
                found.append((room, chosen))
                full[0] += not room
            return
        for n in range(min(rest[sizes[k]], room // sizes[k]), -1, -1):
            extend(k + 1, room - n * sizes[k], (*chosen, (sizes[k], n)) if n else chosen)

    extend(0, capacity - largest, ())
    kept: list[Filling] = []
    flat: list[list[int]] = []
    for room, filling in sorted(set(found), key=lambda f: (f[0], sum(n for _, n in f[1]), [-s for s, _ in f[1]])):
        used, items = dict(filling), _flat(filling)
        if any(used.get(s, 0) < rest[s] for s in takewhile(lambda s: s <= room, reversed(sizes))):  # noqa: B023
            continue
        if len(items) > 8 or not any(len(k) <= 8 and _fits_in(items, k) for k in flat):
            kept.append(filling)
            flat.append(items)
            if len(kept) == width:
                break
    merged = []
    for filling in kept:
        whole = Counter({largest: 1})
        whole.update(dict(filling))
        merged.append(tuple(sorted(whole.items(), reverse=True)))
    return merged


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = 3000, width: int = 24) -> list[tuple[Filling, int]]:
    """Fillings, and how many bins have each, for as few bins as can be found for so many items of each size.

    Branch and bound: the best-fit packing is the first incumbent. A node takes the largest size left and branches over
    its undominated fillings, the fullest of the fewest items first, each used as often as the counts allow, then half
    as often and once. A branch ends when its waste leaves no room for fewer bins than the incumbent has, or when its
    bins and the least that its rest needs aren't fewer; a rest met before with no more bins isn't searched again. What
    is left at a node is packed by best fit from time to time, for better incumbents. The search ends when the incumbent
    meets the bound from below, or after ``nodes``. It works on counts by size, so its cost doesn't depend on the
    number of items.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes are from 1 to the capacity")
    best, goal = best_fit(counts, capacity), least_bins(counts, capacity)
    fewest, total = sum(n for _, n in best), sum(s * n for s, n in counts.items())
    seen: dict[tuple, int] = {}

    def branches(counts: dict[int, int], bins: int, total: int) -> Iterator[tuple[Filling, int]]:
        spare = (fewest - 1 - bins) * capacity - total
        for filling in completions(counts, capacity, spare, width):
            most = min(counts[s] // n for s, n in filling)
            for times in sorted({most, -(-most // 2), 1}, reverse=True):
                if (capacity - fill_of(filling)) * times <= (fewest - 1 - bins) * capacity - total:
                    yield filling, times

    chosen: list[tuple[Filling, int]] = []
    stack = [(counts, 0, total, branches(counts, 0, total))]
    while stack and fewest > goal and nodes > 0:
        counts, bins, total, more = stack[-1]
        if (step := next(more, None)) is None:
            stack.pop()
            chosen = chosen[:-1]
            continue
        nodes -= 1
        filling, times = step
        rest = dict(counts)
        for s, n in filling:
            if rest[s] > n * times:
                rest[s] -= n * times
            else:
                del rest[s]
        bins, total = bins + times, total - fill_of(filling) * times
        if len(rest) < 24 or nodes % 16 == 0:
            quick = best_fit(rest, capacity)
            if (n := bins + sum(n for _, n in quick)) < fewest:
                best, fewest = [*chosen, step, *quick], n
        state = hash(frozenset(rest.items())) if len(rest) > 64 else tuple(sorted(rest.items()))
        if not rest or bins + least_bins(rest, capacity) >= fewest or seen.get(state, bins + 1) <= bins:
            continue
        seen[state] = bins
        chosen = [*chosen, step]
        stack.append((rest, bins, total, branches(rest, bins, total)))
    return best


@dataclass(frozen=True)
class Plan:
    """Ranges of (size, rank) with the first sequence, the items of a sequence and the place of each range."""

    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray


#: Ranks of a size are below 2**SHIFT.
SHIFT = 44


def lay_out(packing: list[tuple[Filling, int]]) -> Plan:
    """Deal the ranks of each size to the sequences of a packing."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for filling, n in packing:
        offset = 0
        for size, each in filling:
            rows.append(((size << SHIFT) + used[size], sequence, each, offset))
            used[size] += each * n
            offset += size * each
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*columns)


def pack(items: DataFrame, length_col: str = "length", capacity: int = CAPACITY, nodes: int = 3000) -> DataFrame:
    """Add sequence_id and offset (from 0 without gaps in a sequence) to rows of 1 to ``capacity`` tokens, in few sequences.

    Pieces are counted by length, so what the search sees has ``capacity`` rows at most, whatever the corpus; they are
    numbered within their length without any task holding one length, and each takes the place that its length and number have in the
    packing. All columns and rows stay; columns of the two names are replaced. An empty table gives none; a length that is
    null, below 1 or over the capacity raises.
    """
    items = items.drop("sequence_id", "offset")
    bad = F.raise_error(F.lit("lengths must be from 1 to the capacity")).cast("int")
    size = F.when(F.col(length_col).between(1, capacity), F.col(length_col).cast("int")).otherwise(bad)
    sized = cut(items.select(F.struct("*").alias("row"), size.alias("size")))
    counts = sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # ``capacity`` rows at most
    plan = lay_out(complete_bins({r["size"]: r["n"] for r in counts}, capacity, nodes))
    rows = number_within(sized, "size", "rank")
    schema = T.StructType([rows.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "rank"))
            key = (size << SHIFT) + rank
            at = np.searchsorted(plan.key, key, "right") - 1
            inside = key - plan.key[at]
            sequence, offset = plan.first[at] + inside // plan.each[at], plan.offset[at] + inside % plan.each[at] * size
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], names=schema.names)

    return rows.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")
