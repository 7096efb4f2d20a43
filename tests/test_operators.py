import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verity.functions import inference
from verity.operators import dense, fusion, latency, nesting, runs
from verity.operators import search as searching
from verity.operators.index import build_index, load_index, write_index
from verity.operators.search import search
from verity.plans.flow import Flow
from verity.plans.verify import verify
from verity.sources import files, generator, runlogs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "red fox"), (5, "red red hen"), (9, "blue sky"), (12, ""), (20, "blue sky")], "doc_id long, text string").cache()


def test_bm25_by_hand(spark, docs):
    index = build_index(docs)
    queries = spark.createDataFrame([("a", "red red"), ("b", "sky"), ("c", "unknown")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"]) for r in search(queries, index, 10).collect()}
    idf = math.log((5 - 2 + 0.5) / (2 + 0.5) + 1)
    weight = lambda tf, n: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / (9 / 5)))
    assert got["a", 5] == (1, round(weight(2, 3), 4)) and got["a", 1] == (2, round(weight(1, 2), 4))
    assert got["b", 9][0] == 1 and got["b", 20][0] == 2  # a tie goes to the smaller id
    assert not any(q == "c" for q, _ in got)
    bag = {r["doc_id"]: r["score"] for r in search(queries.where("query_id = 'a'"), index, 10, "bag").collect()}
    assert bag[1] == round(2 * weight(1, 2), 4)
    assert search(queries, index, 10, max_df=1).count() == 0


def test_fewer_hits_are_a_prefix(spark, docs):
    queries = spark.createDataFrame([("a", "red blue sky")], "query_id string, text string")
    rows = lambda k: [tuple(r) for r in search(queries, build_index(docs), k).orderBy("rank").collect()]
    assert rows(2) == rows(4)[:2]


def test_index_round_trip(spark, docs, tmp_path):
    index = build_index(docs)
    write_index(index, str(tmp_path / "ix"))
    again = load_index(spark, str(tmp_path / "ix"))
    queries = spark.createDataFrame([("a", "red")], "query_id string, text string")
    assert search(queries, again).collect() == search(queries, index).collect()
    stats = again.stats.first()
    assert (stats["pid_offset"], stats["n"], stats["avgdl"]) == (1, 5, 9 / 5)
    assert [r["term_id"] for r in again.vocabulary.orderBy("term").collect()] == list(range(5))


def test_rerank_and_fallback(spark):
    q = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 0, [1.0, 0.0])], "query_id string, tok_pos int, vec array<float>")
    d = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])], "doc_id long, vec array<float>")
    cands = spark.createDataFrame([("a", 1)], "query_id string, doc_id long")
    rows = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"]) for r in dense.rerank(cands, q, d, ["query_id"], fallback=True).collect()}
    assert rows == {("a", 1): (1, 3.0), ("b", 2): (1, 3.0), ("b", 1): (2, 1.0)}
    assert {r["query_id"] for r in dense.rerank(cands, q, d, ["query_id"]).collect()} == {"a"}


def test_fusion_and_default_verdict(spark):
    hits = spark.createDataFrame([(1, 0, 0, 1, 7), (1, 0, 0, 2, 8), (1, 0, 1, 1, 8)], "request_id long, claim_id int, question_id int, rank int, doc_id long")
    best = fusion.fuse_reciprocal_rank(hits, ["request_id", "claim_id"])
    assert [(r["doc_id"], r["score"]) for r in best.orderBy("rank").collect()] == [(8, 1.5), (7, 1.0)]
    claims = spark.createDataFrame([(1, 0, "c", False), (1, 1, "d", True)], "request_id long, claim_id int, claim string, last_claim boolean")
    texts = fusion.lookup_text(best, spark.createDataFrame([(7, "t7"), (8, "t8")], "doc_id long, text string"))
    out = fusion.appraise(claims, texts, lambda p: F.concat(F.lit("{'reasoning': 'x', 'factuality': True} "), p)).orderBy("claim_id").collect()
    assert [r["factuality"] for r in out] == [True, False]


def test_flow_checks_levels(spark):
    a = Flow(spark.createDataFrame([(1, "x.y\nz")], "k long, t string"), ("k",))
    lines = a.split_text("t", "line", "i")
    words = lines.split_text("t", "sentence", "j")
    nested = a.join(words).df.first()
    assert [[w["t"] for w in line] for line in nested["b"]] == [["x", "y"], ["z"]]
    assert [r["t"] for r in words.flatten("n").ordered().collect()] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        lines.join(a)
    with pytest.raises(ValueError):
        lines.pmap(lambda f: a)
    with pytest.raises(ValueError):
        a.apply_rows(lambda df: df.select("t"))


def test_verify_plan(spark, docs):
    requests = spark.createDataFrame([(0, "red fox. blue sky"), (1, " ")], "request_id long, query string")
    rows = {r["request_id"]: r for r in verify(requests, build_index(docs)).collect()}
    claim = rows[0]["claims"][0]
    assert [q["question"] for q in claim["questions"]] == ["red fox", "blue sky"]
    assert claim["questions"][0]["doc"][0]["doc_id"] == 1
    assert [q["question"] for q in rows[1]["claims"][0]["questions"]] == [""]


def test_incomplete_requests(spark):
    req = spark.createDataFrame([(1, "q"), (2, "q")], "request_id long, query string")
    ans = spark.createDataFrame([(1, "a"), (2, "a")], "request_id long, generation string")
    claims = spark.createDataFrame([(1, 0, "c", True), (2, 0, "c", True)], "request_id long, claim_id int, claim string, last_claim boolean")
    qs = spark.createDataFrame([(1, 0, 0, "x", True), (2, 0, 0, "x", False), (2, 0, 1, "y", True)], "request_id long, claim_id int, question_id int, question string, last_question boolean")
    hits = spark.createDataFrame([(1, 0, 0, 1, 5), (2, 0, 1, 1, 5)], "request_id long, claim_id int, question_id int, rank int, doc_id long")
    done, rest = nesting.complete_requests(req, ans, claims, qs, hits)
    assert [r["request_id"] for r in done.collect()] == [1] and [r["request_id"] for r in rest.collect()] == [2]


def test_latency_edges(spark):
    sent = spark.createDataFrame([(1, 1.0), (2, 2.0)], "request_id long, sent_time double")
    recv = spark.createDataFrame([(1, 3.0), (9, 9.0)], "request_id long, recv_time double")
    with pytest.raises(ValueError):
        latency.request_latency(sent, recv, strict=True)
    assert [tuple(r) for r in latency.unfinished(sent, recv, 5.0).collect()] == [(2, 2.0, 3.0)]
    empty = latency.summary_stats(sent.where("false"), "sent_time").first()
    assert tuple(empty) == (None, None, None, 0)
    assert latency.summary_stats(sent, "sent_time", approx=True).first()["count"] == 2
    dealt = latency.bucket_load(latency.key_bucket(spark.range(8, numPartitions=1), 4)).collect()
    assert [r["items"] for r in dealt] == [2, 2, 2, 2]
    assert latency.key_bucket(sent, 3, ["request_id"]).where("bucket between 0 and 2").count() == 2


def test_run_logs(spark, tmp_path):
    rows = [{"time": float(t), "last_request_sent_time": None, "last_response_recv_time": None, "avg_latency": 0.5, "median_latency": 0.4, "p99_latency": 0.9, "num_requests_sent": min(3 * t, 12), "num_responses_recv": 2 * t} for t in range(6)]
    for rate in ("2.0", "0.5"):
        lines = [json.dumps({"name": "client"}), *map(json.dumps, rows)]
        (tmp_path / f"client_out_rate_{rate}_possion_1.json").write_text("\n".join(lines))
    log = runlogs.read_run_logs(spark, str(tmp_path))
    assert log.count() == 12
    stats = runs.run_stats(log)
    row = stats.first()
    assert (row["start_time"], row["end_time"], row["achieved_rate"], row["throughput_avg"]) == (1.0, 4.0, 3.0, 2.0)
    assert runs.run_stats(log, test_length=2, end_increase=False).first()["end_time"] == 3.0
    with pytest.raises(ValueError):
        runs.run_stats(log, test_length=2)
    out = tmp_path / "summary"
    runlogs.write_run_summary(stats, str(out))
    lines = next(out.glob("part-*.csv")).read_text().split("\n")
    assert lines[0] == ",".join(runlogs.SUMMARY) and [x.split(",")[0] for x in lines[1:3]] == ["0.5", "2.0"]
    first = runs.entry_at_or_after(log, 2.5).first()
    assert first["time"] == 3.0 and runs.entry_at_or_before(log, 2.5).first()["time"] == 2.0


def test_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('pid\ttext\tmore\n3\ta "b\tx\n4\tc\ty\n')
    assert [tuple(r) for r in files.read_collection(spark, str(tmp_path / "c.tsv")).collect()] == [(3, 'a "b'), (4, "c")]
    assert files.read_evidence(spark, str(tmp_path / "c.tsv")).count() == 2
    (tmp_path / "q.tsv").write_text("q1\tone\nq2\ttwo\n")
    queries = files.read_queries(spark, str(tmp_path / "q.tsv"))
    assert [r["request_id"] for r in files.assign_request_ids(queries).orderBy("query_id").collect()] == [0, 1]
    numbered = files.assign_request_ids(spark.range(100).select((99 - F.col("id")).alias("x")), "x")
    assert all(r["x"] == r["request_id"] for r in numbered.collect())
    files.write_responses(queries, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_generator_and_stages(spark):
    generator.register_generator(spark, "twos", lambda k: [(k, 2 * j) for j in range(3)], "k int, v int", 2)
    rows = spark.read.format("twos").load()
    assert rows.count() == 6 and rows.agg(F.sum("v")).first()[0] == 12
    with pytest.raises(Exception, match="gave 0 rows"):
        inference.map_stage(rows, lambda batch: [], "k int", batched=True).collect()
    out = inference.generate(spark.createDataFrame([("p",)], "t string"), "t", "g", lambda ps, model, temperature, max_tokens: [f"{model}{p}{max_tokens}" for p in ps], load=lambda: "m")
    assert out.first()["g"] == "mp512"


def test_search_gives_the_same_by_shards_and_by_pruned_joins(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    share = [1 / (k + 1) for k in range(200)]
    text = lambda n: " ".join(rng.choices(words, share, k=n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(600)]
    docs += [(1000 + k, docs[k][1]) for k in range(50)] + [(2000, ""), (2001, None)]
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = [(k, text(rng.randint(1, 8))) for k in range(60)]
    queries += [(100, queries[0][1]), (101, "unknown"), (102, None), (103, "w0 w1 w0")]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    every = searching.search(asked, index, None, "bag").where("rank <= 7")
    want = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in every.collect()}
    assert len(want) == 7 * 62
    for limit in (16, 0):  # no block is allowed: terms and postings are joined
        monkeypatch.setattr(searching, "BLOCKS", limit)
        for block in (1 << 18, 40):
            monkeypatch.setattr(searching, "BLOCK", block)
            got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in searching.search(asked, index, 7, "bag").collect()}
            assert got == want


def test_read_collection_raises_on_bad_ids(spark, tmp_path):
    import pytest
    from pyspark.errors import PySparkException

    (tmp_path / "c.tsv").write_text("1\ttext\tmore\n7\ta\tx\n8\tb\n")
    assert [tuple(r) for r in files.read_collection(spark, str(tmp_path / "c.tsv")).collect()] == [(7, "a"), (8, "b")]
    (tmp_path / "d.tsv").write_text("id\ttext\n7\ta\nseven\tb\n")
    with pytest.raises(PySparkException):
        files.read_collection(spark, str(tmp_path / "d.tsv")).collect()


def test_numbering_keeps_every_row_and_column(spark, tmp_path):
    n = 400_000
    rows = spark.range(n, numPartitions=8).select((F.xxhash64("id") % 50_000).alias("query_id"), F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("at"), F.lit("x").alias("row"))
    rows = rows.withColumn("query_id", F.when(F.col("at") % 3 != 0, F.col("query_id")))  # a third has no id, which is one value
    rows.write.parquet(str(tmp_path / "in"))
    given = spark.read.parquet(str(tmp_path / "in"))
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            numbered = files.assign_request_ids(given, "query_id")
            numbered.write.parquet(str(tmp_path / f"ids-{adaptive}"))
            got = spark.read.parquet(str(tmp_path / f"ids-{adaptive}"))
            assert got.columns == ["query_id", "text", "at", "row", "request_id"]
            facts = got.agg(F.count("*"), F.countDistinct("request_id"), F.min("request_id"), F.max("request_id"), F.countDistinct("text")).first()
            assert tuple(facts) == (n, n, 0, n - 1, n)
            # in order: the greatest number of an id comes before the least of the next
            edges = got.groupBy("query_id").agg(F.min("request_id").alias("a"), F.max("request_id").alias("z"), F.count("*").alias("n"))
            assert edges.where("z - a + 1 <> n").count() == 0
            by_id = [r["a"] for r in edges.orderBy(F.asc_nulls_first("query_id")).collect()]
            assert by_id == sorted(by_id) and by_id[0] == 0
            searching.search_batches(given, 7).write.parquet(str(tmp_path / f"batches-{adaptive}"))
            batches = spark.read.parquet(str(tmp_path / f"batches-{adaptive}"))
            sizes = {r["batch"]: (r["n"], r["k"]) for r in batches.groupBy("batch").agg(F.count("*").alias("n"), F.countDistinct("text").alias("k")).collect()}
            assert sizes == {b: (n // 7 + (b < n % 7),) * 2 for b in range(7)}
            most = batches.groupBy("batch").agg(F.min("query_id").alias("a"), F.max("query_id").alias("z")).where("a IS NOT NULL").orderBy("batch").collect()
            assert all(x["z"] <= y["a"] for x, y in zip(most, most[1:], strict=False))
            in_order = files.assign_request_ids(given)
            assert in_order.agg(F.countDistinct("request_id"), F.max("request_id")).first()[:] == (n, n - 1)
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
    assert files.assign_request_ids(given.where("false"), "query_id").count() == 0
    assert searching.search_batches(given.limit(2), 5).groupBy("batch").count().count() == 2


def test_a_search_of_a_stored_index_reads_its_terms_and_shuffles_no_postings(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(300))) for j in range(30))).alias("text"))
    write_index(build_index(docs), str(tmp_path / "ix"))
    for t in spark.catalog.listTables():
        if t.name.startswith("verity_blocks_"):
            spark.sql(f"DROP TABLE {t.name}")  # as in a later session
    index = load_index(spark, str(tmp_path / "ix"))
    queries = spark.createDataFrame([("a", "w7 w12")], "query_id string, text string")
    found = search(queries, index, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    scan = below[: below.index("SelectedBucketsCount")]
    assert "In(term, [w12,w7])" in scan or "In(term, [w7,w12])" in scan
    assert "Exchange" not in scan
    want = search(queries, build_index(docs), 5, joined=True)
    assert found.orderBy("rank").collect() == want.orderBy("rank").collect() and found.count() == 5


def test_block_skipping_finds_the_same(spark, tmp_path, monkeypatch):
    """Frequent words, ties and weights: by blocks of a stored index, by joins, and by all matches."""
    import random

    from verity.operators import index as indexing

    monkeypatch.setattr(indexing, "SHARD", 500)
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(120)]
    share = [1 / (k + 1) for k in range(120)]
    docs = [(k, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 40)))) for k in range(2500)]
    docs += [(5000 + k, docs[k % 7][1]) for k in range(300)]  # many equal texts: ties at the k-th place
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    write_index(build_index(rows), str(tmp_path / "ix"))
    index = load_index(spark, str(tmp_path / "ix"))
    assert index.blocks.count() > 120 * 5
    asked = spark.createDataFrame([(k, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 6)))) for k in range(80)], "query_id long, text string")
    key = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}
    every = key(search(asked, index, None, "bag").where("rank <= 5"))
    assert key(search(asked, index, 5, "bag")) == every == key(search(asked, index, 5, "bag", joined=True))
    monkeypatch.setattr(searching, "FEW", 0)  # bounds for all
    assert key(search(asked, index, 5, "bag")) == every
    assert [tuple(r) for r in index.impacts.orderBy("term", "doc_id").collect()] == [tuple(r) for r in build_index(rows).impacts.orderBy("term", "doc_id").collect()]


def test_maxsim_in_tiles(spark, monkeypatch):
    """One document with most vectors, repeated, null and empty vectors, and the scan of all documents, against numpy."""
    import numpy as np

    monkeypatch.setattr(dense, "TILE", 8)
    monkeypatch.setattr(dense, "SENT", 40)
    rng = np.random.default_rng(1)
    q = [(f"q{k}", j, (rng.integers(-8, 9, 6) / 8).tolist()) for k in range(5) for j in range([1, 3, 12, 30, 2][k])]
    d = [(k % 40 if k % 2 else 7, (rng.integers(-8, 9, 6) / 8).tolist()) for k in range(400)] + [(7, [1.0] * 6)] * 100
    odd = [(50, None), (51, []), (52, [None, *[1.0] * 5]), (7, None)]
    q_rows = spark.createDataFrame([*q, ("q9", 0, None), ("q0", 99, [])], "query_id string, tok_pos int, vec array<float>").repartition(3)
    d_rows = spark.createDataFrame([*d, *odd], "doc_id long, vec array<float>").repartition(4)

    def plain(query, doc):
        a = np.array([v for i, _, v in q if i == query])
        b = np.array([v for i, v in d if i == doc])
        return float((a @ b.T).max(axis=1).sum())

    ids = sorted({i for i, _ in d})
    pairs = spark.createDataFrame([(f"q{k}", i) for k in (0, 1, 2, 3, 4, 9) for i in (*ids[:9], 50, 51, 52, 999)], "query_id string, doc_id long")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in dense.maxsim(pairs, q_rows, d_rows, ["query_id"]).collect()}
    assert got == pytest.approx({(f"q{k}", i): plain(f"q{k}", i) for k in range(5) for i in ids[:9]})
    none = pairs.where("false")
    best = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in dense.rerank(none, q_rows, d_rows, ["query_id"], 4, fallback=True).collect()}
    want = {}
    for k in range(5):
        order = sorted(((-math.copysign(math.floor(abs(plain(f"q{k}", i)) * 10_000 + 0.5) / 10_000, plain(f"q{k}", i)), i) for i in ids))[:4]  # halves away from 0
        want |= {(f"q{k}", r + 1): (i, -s) for r, (s, i) in enumerate(order)}
    assert best == want
    plan = dense.rerank(none, q_rows, d_rows, ["query_id"], 4, fallback=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_a_large_label_is_split(spark):
    """100,000 vectors of one label: no row holds more than some hundreds of them."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.array(*((F.pmod(F.xxhash64("id", F.lit(j)), F.lit(1000)) / 1000).cast("float") for j in range(8))).alias("vec"))
    tiles = dense._document_tiles(rows).select(F.size("d").alias("n"))
    most, total = tiles.agg(F.max("n"), F.sum("n")).first()
    assert most < 2 * dense.TILE and total == 100_000


def test_verify_may_fall_back_to_all_documents(spark, docs):
    requests = spark.createDataFrame([(0, "unknown words")], "request_id long, query string")
    vectors = lambda rows, col, keys: inference.encode(rows.select(*keys, F.col(col).alias("t")), "t").select(*keys, F.posexplode("vectors").alias("tok_pos", "vec"))
    keys = ["request_id", "claim_id", "question_id"]
    run = lambda fallback: verify(requests, build_index(docs), q_tokens=lambda q: vectors(q, "question", keys), d_tokens=vectors(docs, "text", ["doc_id"]), k_rerank=2, fallback=fallback).first()
    assert len(run(True)["claims"][0]["questions"][0]["doc"]) == 2 and not run(False)["claims"][0]["questions"][0]["doc"]


def test_a_stored_index_shuffles_texts_once_and_no_postings(spark, tmp_path, monkeypatch):
    """Blocks are made where the texts were dealt, and shards don't follow the shuffle partitions; odd ids give what an index that isn't stored gives."""
    from verity.operators import index as indexing

    monkeypatch.setattr(indexing, "SHARD", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    docs = spark.range(450).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(40))) for j in range(12))).alias("text"))
    odd = docs.unionByName(spark.createDataFrame([(7, "w1 w1 other"), (7, "w1 w2 w3"), (None, "w1 w2 lone")], "doc_id long, text string"))
    queries = spark.createDataFrame([(k, f"w{k % 40} w{3 * k % 40} w1 w2") for k in range(60)], "query_id long, text string")
    for name, rows in (("plain", docs), ("odd", odd)):
        made = write_index(build_index(rows), str(tmp_path / name))
        assert {r["shard"] for r in made.blocks.select("shard").distinct().collect()} == set(range(5))
        order = lambda df: [tuple(r) for r in df.orderBy(*df.columns).collect()]
        assert order(made.vocabulary.select("term", "df")) == order(build_index(rows).vocabulary.select("term", "df"))
        assert order(made.impacts) == order(build_index(rows).impacts)
        every = order(searching.search(queries, made, None, "bag").where("rank <= 4"))
        monkeypatch.setattr(searching, "BLOCK", 30)  # many blocks, some at a time
        assert order(searching.search(queries, made, 4, "bag")) == every
        monkeypatch.undo()
        monkeypatch.setattr(indexing, "SHARD", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tiles_go_to_python_in_small_batches(spark, monkeypatch):
    """Steps of a product give the same, and batches of tiles are bounded by bytes."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    vectors = [(k, [float((7 * k + j) % 11) for j in range(4)]) for k in range(40)]
    q = spark.createDataFrame([(k % 2, k, v) for k, v in vectors], "query_id long, tok_pos long, vec array<double>")
    d = spark.createDataFrame([(k % 3, v) for k, v in vectors], "doc_id long, vec array<double>")
    pairs = q.select("query_id", F.lit(0).cast("long").alias("doc_id")).where("query_id = 1")
    rows = lambda: sorted(tuple(r) for r in dense.rerank(pairs, q, d, ["query_id"], 3, fallback=True).collect())
    whole = rows()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == dense.BYTES
    monkeypatch.setattr(dense, "STEP", 3)
    assert len(whole) == 4 and rows() == whole


def test_a_search_in_blocks_writes_the_k_best_only(spark, tmp_path, monkeypatch):
    """What is written of all blocks is k rows of a query, whatever the number of shards; ties and texts without known words included."""
    import random

    from verity.operators import index as indexing

    monkeypatch.setattr(indexing, "SHARD", 250)
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(150)]
    share = [1 / (k + 1) for k in range(150)]
    docs = [(k, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 40)))) for k in range(900)]
    docs += [(5000 + k, docs[k % 7][1]) for k in range(100)]
    index = write_index(build_index(spark.createDataFrame(docs, "doc_id long, text string")), str(tmp_path / "ix"))
    queries = [(k, " ".join(rng.choices(vocabulary, share, k=rng.randint(1, 9)))) for k in range(90)] + [(100, "none"), (101, None)]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    monkeypatch.setattr(searching, "BLOCK", 150)
    written, store = [], searching.stored
    monkeypatch.setattr(searching, "stored", lambda df: written.append(store(df)) or written[-1])
    got = [tuple(r) for r in search(asked, index, 3, "bag").orderBy("query_id", "rank").collect()]
    assert 0 < sum(df.count() for df in written if "score" in df.columns) <= 3 * 90
    assert got == [tuple(r) for r in search(asked, index, None, "bag").where("rank <= 3").orderBy("query_id", "rank").collect()]


def test_each_shard_has_a_bucket_of_its_own(spark, tmp_path, monkeypatch):
    """So no task searches several shards while others have none; only blocks with words of the queries go to Python."""
    from verity.operators import index as indexing

    monkeypatch.setattr(indexing, "SHARD", 100)
    monkeypatch.setattr(indexing, "PART", 40)
    docs = spark.range(450).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(5 + 9 * j))) for j in range(12))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "w1 w2 lone"), (1000, ""), (1001, None)], "doc_id long, text string"))
    made = write_index(build_index(docs), str(tmp_path / "ix"))
    placed = made.blocks.select("shard", F.regexp_extract(F.input_file_name(), r"_(\d+)\.c\d+", 1).alias("at")).distinct().collect()
    assert len(placed) == len({r["at"] for r in placed}) == len({r["shard"] for r in placed}) == 5
    order = lambda df: [tuple(r) for r in df.orderBy(*df.columns).collect()]
    plain = build_index(docs)
    assert order(made.vocabulary.select("term", "df")) == order(plain.vocabulary.select("term", "df"))
    assert order(made.impacts) == order(plain.impacts) and order(made.postings) == order(plain.postings.where("doc_id IS NOT NULL"))
    assert [tuple(r)[:2] for r in order(made.bounds)] == [tuple(r) for r in order(plain.vocabulary)]
    queries = spark.createDataFrame([(k, f"w{k % 40} w{3 * k % 90} w1 w2") for k in range(60)], "query_id long, text string")
    every = order(search(queries, plain, None, "bag").where("rank <= 1"))
    monkeypatch.setattr(searching, "PUSHED", 0)
    found = search(queries, made, 1, "bag")
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInArrow") :]
    assert "LeftSemi" in below[: below.index("SelectedBucketsCount")]
    assert order(found) == every
    empty = write_index(build_index(docs.where("text = '' OR text IS NULL")), str(tmp_path / "empty"))
    assert empty.blocks.count() == empty.vocabulary.count() == 0 and search(queries, empty, 3).count() == 0


def test_a_shard_gives_its_hits_back_in_parts(spark, monkeypatch):
    """Not all hits of a block of queries at once, whatever k is."""
    import pyarrow as pa

    monkeypatch.setattr(searching, "HELD", 100)
    docs = [(k, f"w{k % 3} v{k % 7} x") for k in range(90)]
    queries = [(k, f"w{k % 3} v{k % 5} x") for k in range(40)]
    given = []

    def best_of_shard(*args):
        best = real(*args)

        def sized(batches):
            for out in best(batches):
                given.append(out.num_rows)
                yield out

        return sized

    real = searching._best_of_shard
    words = pa.array(["v0", "x"])
    sent = type("Sent", (), {"value": (words, pa.array([f"q{k}" for k in range(40)]), np.repeat(np.arange(40), 2), np.tile([0, 1], 40), np.ones(80))})
    table = pa.table({"term": ["v0", "x"], "most": [1.0, 0.5], "docs": [[0, 7, 14], list(range(20))], "shares": [[1.0, 0.9, 0.8], [0.5] * 20]})
    parts = list(best_of_shard(sent, 10, 2e-4, ["_q", "doc_id", "score"])(iter(table.to_batches())))
    assert len(given) == len(parts) > 3 and max(given) <= 120
    assert all(part.schema.names == ["_q", "doc_id", "score"] for part in parts)
    asked, index = spark.createDataFrame(queries, "query_id long, text string"), build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(search(asked, index, 8)) == rows(search(asked, index, None).where("rank <= 8"))


def test_impacts_of_a_stored_index_join_whole_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"w{k % 3} v{k % 7} common") for k in range(300)], "doc_id long, text string")
    made = write_index(build_index(docs), str(tmp_path / "ix"))
    plan = made.impacts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join Inner")
    order = lambda df: [tuple(r) for r in df.orderBy(*df.columns).collect()]
    assert order(made.impacts) == order(build_index(docs).impacts)


def test_a_shard_is_read_once_for_several_blocks_of_queries(monkeypatch):
    """And what is found by bounds in whole steps is what adding up finds: repeated words and documents, frequent and rare terms, long queries, ties."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    terms = [f"t{k}" for k in range(60)]
    table, held = [], np.zeros((60, 900))
    for k in range(60):
        docs = np.sort(rng.choice(900, max(1, 800 // (k + 1)), replace=False))
        shares = rng.choice([0.25, 0.5, 1.0, rng.random() + 0.1], len(docs))
        held[k, docs] = shares
        for a in range(0, len(docs), 128):
            table.append({"term": f"t{k}", "docs": (docs[a : a + 128] * 3).tolist(), "shares": shares[a : a + 128].tolist()})
    table.append({"term": "t3", "docs": [3 * 899], "shares": [0.125]})  # a repeated document
    held[3, 899] += 0.125
    table = pa.Table.from_pylist([table[k] for k in rng.permutation(len(table))])
    idf = np.log(60.0 / np.arange(1, 61)) + 0.1
    sents, want = [], []
    for b in range(3):
        at = [np.sort(rng.choice(60, 45 if q == 7 else rng.integers(1, 9), replace=False)) for q in range(70)]
        query, term = np.repeat(np.arange(70), [len(x) for x in at]), np.concatenate(at)
        weight = idf[term] * rng.choice([1, 2, 3, 5], len(term), p=[0.7, 0.1, 0.1, 0.1])
        sents.append(type("Sent", (), {"value": (pa.array([*terms, "none"]), pa.array([f"{b}-{q}" for q in range(70)]), query, term, weight)}))
        every = np.zeros((70, 900))
        np.add.at(every, query, weight[:, None] * held[term])
        want.append(every)
    for few, k in ((searching.FEW, 1), (searching.FEW, 5), (searching.FEW, 150), (0, 5), (1 << 15, 5)):
        monkeypatch.setattr(searching, "FEW", few)
        read = []
        parts = searching._best_of_shard(sents, k, 2e-4, ["_q", "doc_id", "score"])(read.append(1) or x for x in table.to_batches(50))
        found = {}
        for row in pa.Table.from_batches(list(parts)).to_pylist():
            found.setdefault(row["_q"], {})[row["doc_id"] // 3] = row["score"]
        assert len(read) == len(table.to_batches(50))
        near = 0
        for b, q in ((b, q) for b in range(3) for q in range(70)):
            scores, got = want[b][q], found[f"{b}-{q}"]
            kth = max(np.sort(scores)[-k], 1e-6)
            assert {int(d) for d in np.flatnonzero(scores >= kth - 1e-9)} <= set(got)
            assert all(abs(scores[d] - s) < 1e-9 for d, s in got.items())
            near += (scores >= kth - 0.1).sum()
        assert sum(map(len, found.values())) <= 1.1 * near  # few more than asked for


def test_several_blocks_share_a_read_of_the_index(spark, tmp_path, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(j)), F.lit(40))) for j in range(12))).alias("text"))
    made = write_index(build_index(docs), str(tmp_path / "ix"))
    queries = spark.createDataFrame([(k, f"w{k % 40} w{3 * k % 40} w1") for k in range(60)], "query_id long, text string")
    monkeypatch.setattr(searching, "BLOCK", 9)
    calls, real = [], searching._best_of_shard
    monkeypatch.setattr(searching, "_best_of_shard", lambda sents, *args: calls.append(len(sents)) or real(sents, *args))
    got = [tuple(r) for r in search(queries, made, 4, "bag").orderBy("query_id", "rank").collect()]
    assert sum(calls) > 12 and max(calls) <= searching.TOGETHER and len(calls) < sum(calls)
    assert got == [tuple(r) for r in search(queries, made, None, "bag").where("rank <= 4").orderBy("query_id", "rank").collect()]


def test_a_shard_gives_few_more_than_its_part_of_many_hits(spark, tmp_path, monkeypatch):
    """Queries whose best documents are in few shards are searched again; all find what adding up finds."""
    import random

    from verity.operators import index as indexing

    monkeypatch.setattr(indexing, "SHARD", 60)
    rng = random.Random(6)
    share = [1 / (k + 1) for k in range(90)]
    text = lambda n: " ".join(rng.choices([f"v{k}" for k in range(90)], share, k=n))
    rows = spark.createDataFrame([(k, text(rng.randint(1, 30))) for k in range(900)], "doc_id long, text string")
    places = rows.select("doc_id", "text", indexing.shard_of(indexing.shard_count(rows)))
    # A word that one shard has alone, and often: its part of the hits is all of them.
    rows = places.select("doc_id", F.concat_ws(" ", "text", F.when(F.col("shard") == 3, F.lit("alone alone"))).alias("text"))
    index = write_index(build_index(rows), str(tmp_path / "ix"))
    asked = spark.createDataFrame([(k, text(rng.randint(1, 6))) for k in range(40)] + [(50, "alone"), (51, "v1 alone v3")], "query_id long, text string")
    monkeypatch.setattr(searching, "BLOCK", 60)
    calls, real = [], searching._best_of_shard
    monkeypatch.setattr(searching, "_best_of_shard", lambda sents, k, *args: calls.append(k) or real(sents, k, *args))
    order = lambda df: [tuple(r) for r in df.orderBy("query_id", "rank").collect()]
    got = order(search(asked, index, 40, "bag"))
    assert min(calls) < 20 and max(calls) == 40  # at first a part, then all for some
    assert got == order(search(asked, index, None, "bag").where("rank <= 40"))
