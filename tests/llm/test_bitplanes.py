"""Clustering by bit planes against plain integers."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException

from verity.llm import bitplanes, queries


def plain(rows, k=8, rounds=10, scale=1024):
    """Python's integers, one vector at a time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(np.float64(x) * scale)) for x in v]))
    planes = lambda v: bitplanes.pack_planes(np.array([v]))[0].tobytes()
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), planes(r[1])))[:k]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    of = assign()
    total = sum(d for _, d in of)
    return sorted((i if i is not None else -1, c, d, sum(e for b, e in of if b == c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (c, d) in zip(kept, of, strict=True))


def got(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, df.collect()))


def test_planes_and_dots():
    rng = np.random.default_rng(0)
    for low, high in ((-1, 1), (0, 1), (-5, 900), (-(2**27), 2**27), (-3, -2), (0, 2)):
        v, c = rng.integers(low, high, (50, 64)), rng.integers(low, high, (3, 64))
        x = bitplanes.pack_planes(v)
        for j in range(3):
            y = bitplanes.pack_planes(c[j : j + 1])[0]
            assert (bitplanes.dots(x, y) == v @ c[j]).all()
        assert (bitplanes.norms(x) == (v**2).sum(axis=1)).all()
        assert (bitplanes.norms(bitplanes.widen(x, x.shape[1] + 3)) == (v**2).sum(axis=1)).all()
        of = rng.integers(0, 4, 50)
        n, s = bitplanes.component_sums(x, of, 4)
        assert (s == [v[of == j].sum(axis=0) for j in range(4)]).all() and (n == np.bincount(of, minlength=4)).all()


@pytest.mark.parametrize("name", ["float", "double"])
def test_clusters_equal_plain_integers(spark, name):
    rng = random.Random(2)
    middles = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(5)]
    vectors = [[m + rng.gauss(0, 0.3) for m in rng.choice(middles)] for _ in range(300)]
    rows = list(enumerate(vectors))
    rows += [(k, vectors[k]) for k in range(20)] + [(k, vectors[50]) for k in range(400, 460)]  # repeated rows, one hot vector
    rows += [(7, vectors[9]), (None, vectors[3]), (None, vectors[4]), (900, None), (901, []), (902, vectors[0][:63]), (903, [*vectors[0], 1.0])]
    rows += [(904, [None, *vectors[0][1:]]), (905, [float("nan"), *vectors[0][1:]]), (906, [float("-inf"), *vectors[0][1:]]), (907, [30_000.0, *vectors[0][1:]]), (908, [0.0] * 64), (909, [-0.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "p") for i, v in rows], f"vec_id long, embedding array<{name}>, id int, planes string").repartition(5)
    kept = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got(bitplanes.cluster(df)) == plain(kept)


def test_few_none_and_too_large(spark):
    df = spark.createDataFrame([(k, [float(k % 2)] * 64) for k in range(5)], "vec_id long, embedding array<float>")
    assert got(bitplanes.cluster(df)) == plain([(r["vec_id"], r["embedding"]) for r in df.collect()])
    assert bitplanes.cluster(df.where("false")).collect() == []
    large = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(PySparkException, match="28 bits"):
        bitplanes.cluster(large).collect()


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op12_bitplane_clusters"])
    names = [x[0] for x in cur.description]
    df = queries.op12_bitplane_clusters(spark, data)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cur.fetchall())
