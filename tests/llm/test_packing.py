"""Packing: tokens as the library gives them, whole and gapless sequences, and searches against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verity.llm import packing, queries

DATA = "/root/testdata/sf0.001"


def fewest(items, capacity):
    """The least number of bins, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def held(packing_, capacity):
    used = Counter()
    for filling, n in packing_:
        assert n > 0 and packing.fill_of(filling) <= capacity
        for s, k in filling:
            used[s] += k * n
    return dict(used)


def test_search_finds_the_fewest_bins():
    rng = random.Random(4)
    for trial in range(250):
        capacity = rng.choice([10, 20, 30, 100])
        items = [rng.randint(1 if trial % 2 else capacity // 6, capacity if trial % 3 else capacity // 2) for _ in range(rng.randint(0, 9))]
        counts = dict(Counter(items))
        found = packing.complete_bins(counts, capacity)
        best = fewest(items, capacity)
        assert held(found, capacity) == counts and sum(n for _, n in found) == best
        assert not counts or packing.least_bins(counts, capacity) <= best <= sum(n for _, n in packing.best_fit(counts, capacity))


def test_search_beats_best_fit_where_triples_are_exact():
    rng = random.Random(1)
    counts = Counter()
    for _ in range(20):
        a = rng.randint(380, 470)
        b = rng.randint(260, (1000 - a) // 2)
        counts.update((a, b, 1000 - a - b))
    found = packing.complete_bins(dict(counts), 1000)
    assert held(found, 1000) == counts
    assert sum(n for _, n in found) == 20 < sum(n for _, n in packing.best_fit(dict(counts), 1000))


def test_search_cost_does_not_follow_the_number_of_items():
    counts = {700: 10**10, 324: 10**10 - 3, 1: 7, 1024: 10**9}
    found = packing.complete_bins(counts, 1024)
    assert held(found, 1024) == counts
    assert sum(n for _, n in found) == 10**10 + 10**9 and len(found) < 12


def test_dominated_fillings_are_left_out():
    # beside 60 of 100: 40 alone holds all that 30 + 10 or 20 + 20 hold
    fillings = packing.completions({60: 1, 40: 1, 30: 1, 10: 1, 20: 2}, 100, 100, 24)
    assert fillings == [((60, 1), (40, 1))]
    # 39 leaves one unit, so 30 + 10 isn't dominated by it
    assert set(packing.completions({60: 1, 39: 1, 30: 1, 10: 1}, 100, 100, 24)) == {((60, 1), (39, 1)), ((60, 1), (30, 1), (10, 1))}


TEXTS = ["", None, " ", "a", "\n\n a\tb  c \r\n", "don't we'll I'M", "x" * 9000, " 12  345 6,7!? ", "À漢字 \U0001f600  z", "end<|endoftext|> of", "\x1c \x85a", "word " * 3000, "tail  "]


@pytest.mark.parametrize("seed", [0, 1])
def test_pieces_equal_the_library(spark, seed):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.byte_model())
    rng = random.Random(seed)
    texts = TEXTS + ["".join(rng.choice(" \n\taZé'<|1,.漢　") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([(k % 150, t, "x", 1, "y") for k, t in enumerate(texts)] + [(None, "a", "x", 1, "y")], "doc_id long, text string, ids string, length int, id string").repartition(3)
    got = defaultdict(list)
    for r in packing.token_pieces(docs, queries.byte_model()).orderBy("doc_id", "start").collect():
        got[r["doc_id"]].append(r)
    want = Counter()
    for k, t in [*((k % 150, t) for k, t in enumerate(texts)), (None, "a")]:
        want[k, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    one = {k for k, n in Counter(k for k, _ in want.elements()).items() if n == 1}
    for (k, ids), _ in want.items():
        if k in one:
            rows = got[k]
            assert [r["piece"] for r in rows] == list(range(len(rows)))
            assert tuple(np.frombuffer(b"".join(r["ids"] for r in rows), "<u4")) == ids
            assert all(r["length"] == 1024 for r in rows[1:]) and 1 <= rows[0]["length"] <= 1024
            assert [r["start"] for r in rows] == [0, *np.cumsum([r["length"] for r in rows])[:-1]]
    assert sum(len(r["ids"]) // 4 for rows in got.values() for r in rows) == sum(len(i) * n for (_, i), n in want.items())


def assert_packed(rows, capacity=1024):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_query_packs_everything(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.byte_model())
    rows = queries.op11_bin_completion(spark, DATA).collect()
    n = assert_packed(rows)
    found = defaultdict(dict)
    for r in rows:
        found[r["doc_id"]][r["piece"]] = r
    sizes = []
    for d in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = np.array([*whole.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        got = found.pop(d["doc_id"])
        assert len(got) == -(-len(ids) // 1024)
        for r in got.values():
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            sizes.append(r["length"])
    assert not found and sum(sizes) == sum(r["length"] for r in rows)
    counts = dict(Counter(sizes))
    assert packing.least_bins(counts, 1024) <= n <= sum(k for _, k in packing.best_fit(counts, 1024))


def test_one_length_in_most_rows_and_odd_tables(spark):
    rows = [(k, 1 if k % 3 else 1023, "o", 7) for k in range(3000)] + [(None, 5, "o", 7), (None, 5, "o", 7)]
    items = spark.createDataFrame(rows, "doc_id long, length int, offset string, _rank int").repartition(7)
    packed = packing.pack(items)
    assert packed.columns == ["doc_id", "length", "_rank", "sequence_id", "offset"]
    out = packed.collect()
    assert len(out) == 3002 and assert_packed(out) == 1001
    assert packing.pack(items.where("false")).count() == 0
    for bad in (0, 1025, None):
        with pytest.raises(PySparkException):
            packing.pack(items.limit(1).withColumn("length", F.lit(bad).cast("int"))).collect()
