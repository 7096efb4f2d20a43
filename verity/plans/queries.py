"""Registered queries: each operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.functions import inference, text, vectors
from verity.operators import dense, fusion, index, latency, nesting, runs, search
from verity.plans import fixtures as fx
from verity.plans.flow import Flow
from verity.plans.verify import KEYS, sentences, verify
from verity.sources import files, runlogs
from verity.streaming import stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _docs(spark, d):
    return index.token_table(fx.table(spark, d, "documents"))


def _conv(spark, d):
    return fx.table(spark, d, "conversations")


@query
def tokenize_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("len"))


@query
def term_frequencies(spark, d):
    return index.term_frequencies(_docs(spark, d))


@query
def vocabulary_df(spark, d):
    return index.vocabulary(index.term_frequencies(_docs(spark, d)))


@query
def doc_lengths(spark, d):
    return index.doc_lengths(_docs(spark, d))


@query
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_lengths(_docs(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@query
def idf_table(spark, d):
    ix = index.build_index(fx.table(spark, d, "documents"), impacts=False)
    return ix.vocabulary.crossJoin(F.broadcast(ix.stats)).select("term", F.round(index.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query
def impacts(spark, d):
    return fx.collection_index(spark, d).impacts.withColumn("impact", F.round("impact", 6))


@query
def bm25_topk(spark, d):
    return search.search(fx.search_queries(spark, d), fx.collection_index(spark, d), 10)


@query
def bm25_bag_topk(spark, d):
    return search.search(fx.search_queries(spark, d), fx.collection_index(spark, d), 10, "bag")


@query
def bm25_pruned_topk(spark, d):
    """The way that query sets too large for the driver take."""
    return search.search(fx.search_queries(spark, d), fx.collection_index(spark, d), 10, joined=True)


@query
def bm25_oov_terms(spark, d):
    terms = search.query_terms(fx.search_queries(spark, d), ["query_id"], "text")
    return search.out_of_vocabulary(terms, fx.collection_index(spark, d)).select("query_id", "term")


@query
def bm25_known_terms(spark, d):
    terms = search.query_terms(fx.search_queries(spark, d), ["query_id"], "text")
    return search.in_vocabulary(terms, fx.collection_index(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))


@query
def search_batches(spark, d):
    return search.search_batches(fx.search_queries(spark, d), 9).select("query_id", "text", "batch")


@query
def numbered_documents(spark, d):
    return files.assign_request_ids(fx.table(spark, d, "documents"), "doc_id").select("request_id", "doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query
def claims(spark, d):
    return fx.claims(_conv(spark, d))


@query
def questions(spark, d):
    return fx.questions(_conv(spark, d))


@query
def tokens(spark, d):
    return text.extract_tokens(fx.questions(_conv(spark, d)))


@query
def split_levels(spark, d):
    rows = fx.answers(_conv(spark, d))
    parts = [text.split_text(rows, "generation", level, ["request_id"], "pos").withColumn("level", F.lit(level)) for level in ("full", "line", "word", "sentence")]
    return nesting.merge_branches(*parts).groupBy("request_id", "level").agg(F.count(F.lit(1)).alias("n"), F.max("generation").alias("greatest"))


@query
def clean_generations(spark, d):
    marked = F.concat(F.lit("  "), F.col("generation"), F.lit("<|im_end|> \n"))
    return fx.answers(_conv(spark, d)).select("request_id", *(text.clean_generation(marked, m).alias(m) for m in ("answer", "claims", "queries")))


@query
def child_counts(spark, d):
    conv = _conv(spark, d)
    a = nesting.child_counts(fx.claims(conv), ["request_id"], "claim_id", "last_claim").select("request_id", F.lit(-1).alias("claim_id"), "expected", "got")
    b = nesting.child_counts(fx.questions(conv), ["request_id", "claim_id"], "question_id", "last_question")
    return a.unionByName(b)


@query
def incomplete_requests(spark, d):
    conv = _conv(spark, d)
    return nesting.complete_requests(fx.requests(conv), fx.answers(conv), fx.claims(conv), fx.questions(conv), fx.hits(spark, d))[1].select("request_id")


@query
def complete_requests(spark, d):
    conv = _conv(spark, d)
    return nesting.complete_requests(fx.requests(conv), fx.answers(conv), fx.claims(conv), fx.questions(conv), fx.hits(spark, d))[0].select("request_id")


@query
def prompts(spark, d):
    return fx.claims(_conv(spark, d)).select("request_id", "claim_id", text.build_prompt("claims", F.col("claim")).alias("text_prompt"), text.build_prompt("questions", F.col("claim")).alias("claim_prompt"))


@query
def chat_messages_json(spark, d):
    return fx.requests(_conv(spark, d)).select("request_id", F.to_json(text.chat_messages(F.lit("Answer briefly."), F.col("query"))).alias("messages"))


def _verdict_text(claim):
    return F.concat(F.lit("{ 'reasoning': 'about "), F.regexp_replace(claim, "['\",\n]", ""), F.lit("', 'error': 'None', 'correction': 'c', 'factuality': "), F.when(F.length(claim) % 2 == 0, "True").otherwise("False"), F.lit(" }"))


@query
def parsed_verdicts(spark, d):
    made = F.when(F.col("claim_id") % 3 == 2, F.col("claim")).otherwise(_verdict_text(F.col("claim")))
    return fx.claims(_conv(spark, d)).select("request_id", "claim_id", text.parse_verdict(made).alias("v")).select("request_id", "claim_id", "v.*")


def _vectors(spark, d, m=20):
    e = fx.table(spark, d, "embeddings")
    q = e.select((F.col("vec_id") % m).alias("query_id"), F.col("vec_id").alias("tok_pos"), F.col("embedding").alias("vec"))
    return q, e.select(F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("vec"))


@query
def maxsim_topk(spark, d):
    q, docs = _vectors(spark, d)
    # A stated set of queries, each against all documents.
    return dense.rerank(q.select("query_id", F.lit(None).cast("long").alias("doc_id")).where("false"), q, docs, ["query_id"], 5, fallback=True)


def _candidates(q):
    return q.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select("query_id", F.pmod(F.col("query_id") + F.col("k"), F.lit(10)).alias("doc_id"))


@query
def rerank_candidates(spark, d):
    q, docs = _vectors(spark, d)
    return dense.rerank(_candidates(q), q, docs, ["query_id"], 5)


@query
def rerank_fallback(spark, d):
    q, docs = _vectors(spark, d)
    return dense.rerank(_candidates(q).where("query_id % 4 <> 0"), q, docs, ["query_id"], 5, fallback=True)


@query
def matrix_pack_roundtrip(spark, d):
    e = fx.table(spark, d, "embeddings")
    m = e.select("vec_id", "embedding", vectors.unpack_matrix(F.col("embedding"), F.lit(8), 8).alias("m"))
    return m.select("vec_id", F.size("m").alias("n_rows"), (vectors.pack_matrix(F.col("m")) == F.col("embedding")).alias("same"), F.round(vectors.dot(F.col("m")[0], F.col("m")[1]), 4).alias("dot"))


@query
def evidence_fusion(spark, d):
    return fusion.fuse_reciprocal_rank(fx.hits(spark, d), ["request_id", "claim_id"])


@query
def evidence_text(spark, d):
    return fusion.lookup_text(fusion.fuse_reciprocal_rank(fx.hits(spark, d), ["request_id", "claim_id"]), fx.table(spark, d, "documents")).select("request_id", "claim_id", "rank", "doc_id", "text")


@query
def combined_docs(spark, d):
    return fusion.combine_docs(fx.hits(spark, d), ["request_id", "claim_id"])


@query
def appraisals(spark, d):
    best = fusion.fuse_reciprocal_rank(fx.hits(spark, d), ["request_id", "claim_id"])
    evidence = fusion.lookup_text(best, fx.table(spark, d, "documents"))
    return fusion.appraise(fx.claims(_conv(spark, d)), evidence, lambda p: _verdict_text(p))


@query
def flow_join_same(spark, d):
    conv = _conv(spark, d)
    flow = Flow(fx.requests(conv), ("request_id",)).join(Flow(fx.answers(conv), ("request_id",)))
    return flow.df.select("request_id", "a.query", "b.generation")


def _question_flow(spark, d):
    return Flow(fx.questions(_conv(spark, d)).select(*KEYS, "question"), tuple(KEYS))


@query
def flow_join_ancestor(spark, d):
    flow = Flow(fx.answers(_conv(spark, d)), ("request_id",)).join(_question_flow(spark, d))
    joined = F.array_join(F.transform("b", lambda c: F.array_join(F.transform(c, lambda q: q["question"]), "|")), "\n")
    return flow.df.select("request_id", "a.generation", joined.alias("questions"))


@query
def flow_flatten(spark, d):
    return _question_flow(spark, d).flatten("n").df


@query
def flow_select(spark, d):
    conv = _conv(spark, d)
    return Flow(fx.requests(conv), ("request_id",)).join(Flow(fx.answers(conv), ("request_id",))).select_side(1).df


@query
def flow_pmap(spark, d):
    flow = Flow(fx.answers(_conv(spark, d)), ("request_id",)).pmap(lambda f: f.split_text("generation", "line", "line_id").split_text("generation", "word", "word_id"))
    return flow.df


@query
def flow_joined_stage(spark, d):
    conv = _conv(spark, d)
    flow = Flow(fx.requests(conv), ("request_id",)).join(Flow(fx.answers(conv), ("request_id",)))
    return flow.apply_rows(lambda df: df.select("request_id", (F.length("a.query") + F.length("b.generation")).cast("long").alias("chars"))).ordered()


@query
def blank_claims(spark, d):
    blank, other = nesting.split_blank(fx.claims(_conv(spark, d)))
    marked = nesting.merge_branches(blank.withColumn("blank", F.lit(True)), other.withColumn("blank", F.lit(False)))
    return marked.groupBy("blank").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("claim")).alias("chars"))


@query
def nested_response(spark, d):
    conv = _conv(spark, d)
    nested = nesting.nest_response(fx.answers(conv), fx.claims(conv), fx.questions(conv), fx.hits(spark, d))
    slim = F.transform("claims", lambda c: F.struct(c["claim"].alias("claim"), F.transform(c["questions"], lambda q: F.struct(q["question"].alias("question"), F.transform(q["doc"], lambda x: x["doc_id"]).alias("doc"))).alias("questions")))
    return nested.select("request_id", "generation", F.to_json(slim).alias("claims"))


@query
def verified_responses(spark, d):
    nested = verify(fx.requests(_conv(spark, d)), fx.collection_index(spark, d))
    return nested.select("request_id", "generation", F.size("claims").alias("n_claims"), F.aggregate("claims", F.lit(0), lambda n, c: n + F.size(c["questions"])).alias("n_questions"))


def _first_words(rows, col, keys, n):
    """Vectors of a text's words in the encoder's window of ``n``: keys, tok_pos, vec."""
    made = inference.encode(rows.select(*keys, F.coalesce(F.col(col), F.lit("")).alias("t")), "t")
    return made.select(*keys, F.posexplode(F.slice("vectors", 1, n)).alias("tok_pos", "vec"))


def _two_lines(claim):
    """Stand-in for a model that writes queries: the claim, and its first half."""
    clean = F.replace(claim, F.lit("\n"), F.lit(" "))
    return F.concat_ws("\n", clean, F.substring(clean, F.lit(1), (F.length(clean) / 2).cast("int")))


@query
def verified_plan(spark, d):
    """All steps: generated answers, claims, asked queries, BM25, encoding, re-ranking, nesting."""
    docs = _first_words(fx.table(spark, d, "documents"), "text", ["doc_id"], 32)
    nested = verify(
        fx.requests(_conv(spark, d)), fx.collection_index(spark, d), inference.echo, lambda q: _first_words(q, "question", KEYS, 32), docs, k=20, k_rerank=3, ask=_two_lines
    )
    slim = F.transform("claims", lambda c: F.struct(c["claim"].alias("claim"), F.transform(c["questions"], lambda q: F.struct(q["question"].alias("question"), F.transform(q["doc"], lambda x: x["doc_id"]).alias("doc"))).alias("questions")))
    return nested.select("request_id", "generation", F.to_json(slim).alias("claims"))


@query
def report_text(spark, d):
    conv = _conv(spark, d)
    hits = fusion.lookup_text(fx.hits(spark, d, 1), fx.table(spark, d, "documents"))
    passages = hits.groupBy(*KEYS).agg(F.collect_list(F.struct("doc_id", "text")).alias("passages"))
    asked = fx.questions(conv).join(passages, KEYS, "left").groupBy("request_id", "claim_id").agg(F.sort_array(F.collect_list(F.struct("question_id", "question", F.coalesce("passages", F.array().cast("array<struct<doc_id:bigint,text:string>>")).alias("passages")))).alias("questions"))
    made = fx.claims(conv).join(asked, ["request_id", "claim_id"]).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "claim", "questions"))).alias("claims"))
    rows = fx.answered(conv).join(made, "request_id")
    return rows.select("request_id", text.render_report(F.col("request_id"), F.col("query"), F.col("generation"), F.col("claims")).alias("report"))


def _traffic(spark, d):
    events = fx.table(spark, d, "events")
    return fx.sent(events).drop("run_file"), fx.received(events).drop("run_file")


@query
def request_latency(spark, d):
    return latency.request_latency(*_traffic(spark, d)).withColumn("latency", F.round("latency", 4))


@query
def unfinished(spark, d):
    return latency.unfinished(*_traffic(spark, d), now=1_706_745_600.0).withColumn("waited", F.round("waited", 4))


@query
def orphans(spark, d):
    return latency.orphans(*_traffic(spark, d))


@query
def all_received(spark, d):
    return latency.all_received(*_traffic(spark, d))


@query
def sent_minus_received(spark, d):
    return latency.sent_minus_received(*_traffic(spark, d))


def _rounded(df, *cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query
def latency_stats(spark, d):
    return _rounded(latency.summary_stats(latency.request_latency(*_traffic(spark, d)), "latency"), "avg", "median", "p99")


@query
def latency_benchmark(spark, d):
    rows = latency.request_latency(*_traffic(spark, d)).withColumn("batch", F.col("request_id") % 7)
    return _rounded(latency.latency_benchmark(rows, by=["batch"]), "avg", "median", "p95")


@query
def latency_snapshots(spark, d):
    return _rounded(fx.run_log(spark, d), "avg_latency", "median_latency", "p99_latency", "last_response_recv_time")


@query
def stage_fanout(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("stage"), "user_id", fx.seconds(F.col("ts")).alias("out_time"))
    first = e.groupBy("user_id").agg(F.min("out_time").alias("in_time"))
    ins = e.select("stage", "user_id").distinct().join(first, "user_id")
    return _rounded(latency.stage_fanout(ins, e, ["stage", "user_id"]), "min_latency", "max_latency")


@query
def stage_stats(spark, d):
    return _rounded(latency.summary_stats(stage_fanout(spark, d), "max_latency", ["stage"]), "avg", "median", "p99", digits=3)


@query
def edge_latency(spark, d):
    e = fx.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("edge"), fx.seconds(F.col("ts")).alias("sent_time"), (fx.seconds(F.col("ts")) + F.col("value")).alias("recv_time"))
    return _rounded(latency.edge_latency(rows, ["edge"]), "avg", "median", "p99")


def _entry(df):
    return _rounded(df.select("run_file", "time", "num_requests_sent", "num_responses_recv", "avg_latency"), "avg_latency")


@query
def last_increase(spark, d):
    return _entry(runs.last_increase(fx.run_log(spark, d)))


@query
def first_active(spark, d):
    return _entry(runs.first_active(fx.run_log(spark, d)))


@query
def asof_entry(spark, d):
    log, t = fx.run_log(spark, d), 1_705_000_000.0
    return _entry(runs.entry_at_or_after(log, t)).withColumn("side", F.lit("after")).unionByName(_entry(runs.entry_at_or_before(log, t)).withColumn("side", F.lit("before")))


@query
def asof_many(spark, d):
    """The log entry before each request, all in one order."""
    times = fx.sent(fx.table(spark, d, "events")).select("run_file", F.col("sent_time").alias("at"), "request_id")
    return runs.entries_at(fx.run_log(spark, d), times).select("request_id", F.col("time").alias("entry_time"), "num_requests_sent")


@query
def asof_many_after(spark, d):
    times = fx.sent(fx.table(spark, d, "events")).select("run_file", F.col("sent_time").alias("at"), "request_id")
    return runs.entries_at(fx.run_log(spark, d), times, after=True).select("request_id", F.col("time").alias("entry_time"), "num_responses_recv")


RUN_COLS = ["time_length", "latency_avg", "latency_median", "latency_p99", "achieved_rate", "throughput_avg"]


@query
def run_stats(spark, d):
    return _rounded(runs.run_stats(fx.run_log(spark, d), fx.DAY, -2 * fx.DAY), *RUN_COLS, digits=6)


@query
def run_summary(spark, d):
    out = runlogs.run_summary(runs.run_stats(fx.run_log(spark, d), fx.DAY, -2 * fx.DAY)).orderBy("rate")
    return _rounded(out, *[c for c in out.columns if c != "rate"], digits=6)


@query
def rates(spark, d):
    out = runs.run_stats(fx.run_log(spark, d), start_nonzero=False, end_increase=False)
    return _rounded(out.select("run_file", "achieved_rate", "throughput_avg"), "achieved_rate", "throughput_avg", digits=6).orderBy("achieved_rate")


def _arrivals(spark, d):
    return fx.table(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


@query
def trailing_throughput(spark, d):
    rows = _arrivals(spark, d).withColumn("n", F.col("event_id"))
    out = latency.trailing_throughput(rows, "t", "n", 86_400_000_000, ["event_type"])
    return out.select("event_id", F.round(F.col("throughput") * 1e6, 6).alias("throughput"))


@query
def arrival_gaps(spark, d):
    return _rounded(latency.arrival_gaps(_arrivals(spark, d).withColumn("t", F.col("t") / 1e6), "t", ["event_type"]), "mean_gap", "rate", "cv", digits=5)


@query
def bucket_load_hash(spark, d):
    return _rounded(latency.bucket_load(latency.key_bucket(fx.table(spark, d, "events"), 8, ["user_id"], hashed=False)), "skew")


@query
def bucket_of_key(spark, d):
    """Hashed routing: all rows of a key are in one bucket of the right range."""
    dealt = latency.key_bucket(fx.table(spark, d, "events"), 8, ["user_id"])
    return dealt.groupBy("user_id").agg(F.countDistinct("bucket").alias("buckets"), F.min(F.col("bucket").between(0, 7)).alias("in_range"), F.count(F.lit(1)).alias("items"))


@query
def bucket_load_rr(spark, d):
    numbered = files.assign_request_ids(fx.table(spark, d, "events").select("event_id"), "event_id")
    return _rounded(latency.bucket_load(latency.key_bucket(numbered, 8, ["request_id"], hashed=False)), "skew")


def _drained(spark, df):
    """What a stream writes when it has taken all that is there."""
    path = fx.scratch(spark)
    stages.run_stream(df, f"{path}/out", f"{path}/state")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _conv_stream(spark, d):
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    return files.stream_requests(spark, f"{d}/conversations.parque[t]", schema)  # as a pattern, it may be a file or a folder


#: Bits of ids within a block of a stream's state. A conversation has a thousand request ids and uses a few, so a block is about four conversations.
BITS = {"request_id": 12, "claim_id": 4, "question_id": 4}


@query
def stream_claims(spark, d):
    stages.use_state_store(spark)
    rows = fx.answers(_conv_stream(spark, d)).withColumn("generation", text.clean_generation(F.col("generation"), "claims"))
    return _drained(spark, stages.stream_split(_growing(rows, ["request_id"]), bits={"request_id": BITS["request_id"]}))


@query
def stream_bm25(spark, d):
    stages.use_state_store(spark)
    path = fx.scratch(spark)
    words = text.extract_tokens(fx.questions(_conv_stream(spark, d)))
    stages.stream_bm25(words, fx.collection_index(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").where("rank <= 10").select(*KEYS, "rank", "doc_id", "score")


def _growing(rows, keys):
    """Each text as a half and as a whole."""
    half = F.substring("generation", F.lit(1), (F.length("generation") / 2).cast("int"))
    both = F.array(F.struct(half.alias("text"), F.lit(False).alias("done")), F.struct(F.col("generation").alias("text"), F.lit(True).alias("done")))
    return rows.select(*keys, F.inline(both))


@query
def stream_questions(spark, d):
    stages.use_state_store(spark)
    keys = ["request_id", "claim_id"]
    asked = fx.claims(_conv_stream(spark, d)).select(*keys, text.clean_generation(sentences(F.col("claim")), "queries").alias("generation"))
    return _drained(spark, stages.stream_split(_growing(asked, keys), keys, "question_id", "question", "last_question", bits={k: BITS[k] for k in keys}))


@query
def stream_tokens(spark, d):
    stages.use_state_store(spark)
    asked = fx.questions(_conv_stream(spark, d)).select(*KEYS, F.col("question").alias("generation"))
    return _drained(spark, stages.stream_split(_growing(asked, KEYS), KEYS, "pos", "word", "last_token", " \n", BITS))


@query
def stream_rendezvous(spark, d):
    stages.use_state_store(spark)
    left, right = fx.claims(_conv_stream(spark, d)), fx.questions(_conv_stream(spark, d))
    return _drained(spark, stages.stream_rendezvous(left, right, ["request_id", "claim_id"])).select(*KEYS, "claim", "question")


def _hit_stream(spark, d):
    """The hits of each question as a stream, written once by the batch search."""
    path = fx.scratch(spark)
    docs = fx.hits(spark, d).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("doc"))
    every = fx.questions(_conv(spark, d)).select(*KEYS).join(docs, KEYS, "left").withColumn("doc", F.coalesce("doc", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")))
    every.write.parquet(path)
    return spark.readStream.schema(every.schema).parquet(path)


@query
def stream_response(spark, d):
    stages.use_state_store(spark)
    conv = _conv_stream(spark, d)
    out = stages.stream_response(fx.answers(conv), fx.claims(conv), fx.questions(conv), _hit_stream(spark, d), None)
    shape = "generation string, claims array<struct<claim:string,questions:array<struct<question:string,doc:array<struct<doc_id:bigint>>>>>>"
    r = F.from_json("payload", shape)
    rows = _drained(spark, out).where("status = 'complete'").select(F.col("key").cast("long").alias("request_id"), r.alias("r"))
    slim = F.transform("r.claims", lambda c: F.struct(c["claim"].alias("claim"), F.transform(c["questions"], lambda q: F.struct(q["question"].alias("question"), F.transform(q["doc"], lambda x: x["doc_id"]).alias("doc"))).alias("questions")))
    return rows.select("request_id", "r.generation", F.to_json(slim).alias("claims"))


@query
def stream_appraise(spark, d):
    stages.use_state_store(spark)
    conv = _conv_stream(spark, d)
    out = _drained(spark, stages.stream_appraise(fx.claims(conv), fx.questions(conv), _hit_stream(spark, d), None)).where("status = 'complete'")
    ids, r = F.split("key", "/"), F.from_json("payload", "claim string, evidence array<bigint>")
    return out.select(ids[0].cast("long").alias("request_id"), ids[1].cast("int").alias("claim_id"), r["claim"].alias("claim"), F.array_join(r["evidence"].cast("array<string>"), ",").alias("evidence"))


@query
def stream_latency(spark, d):
    """Running statistics over three batches; quantiles are held against the exact ones."""
    rows = latency.request_latency(*_traffic(spark, d))
    path = fx.scratch(spark)
    rows.withColumn("part", F.pmod("request_id", F.lit(3))).repartition(3, "part").drop("part").write.parquet(f"{path}/in")
    stream = files.stream_requests(spark, f"{path}/in", rows.schema, maxFilesPerTrigger=1)
    stages.stream_latency(stream, f"{path}/out", f"{path}/state").awaitTermination()
    last = spark.read.parquet(f"{path}/out/stats").orderBy(F.desc("batch")).limit(1)
    exact = latency.summary_stats(rows, "latency").select(F.col("median").alias("m"), F.col("p99").alias("h"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.02 * F.abs(b)
    return last.crossJoin(exact).select(F.round("avg", 4).alias("avg"), "count", near("median", "m").alias("median_near"), near("p99", "h").alias("p99_near"))


@query
def udf_generate(spark, d):
    return inference.generate(fx.requests(_conv(spark, d)), "query", "generation")


@query
def udf_batched(spark, d):
    rows = fx.requests(_conv(spark, d))
    return inference.map_stage(rows, lambda batch: [{"request_id": r["request_id"], "n": len(r["query"].split(" "))} for r in batch], "request_id long, n long", batched=True)


@query
def udf_many(spark, d):
    rows = fx.answers(_conv(spark, d))
    return inference.map_stage(rows, lambda r: [{"request_id": r["request_id"], "line": x} for x in r["generation"].split("\n") if x], "request_id long, line string", many=True)


@query
def udtf_split(spark, d):
    spark.udtf.register("split_pieces", inference.SplitPieces)
    fx.answers(_conv(spark, d)).createOrReplaceTempView("verity_answers")
    return spark.sql("SELECT request_id, pos, piece FROM verity_answers, LATERAL split_pieces(generation, '\n')")


@query
def udf_encode(spark, d):
    made = inference.encode(fx.requests(_conv(spark, d)), "query")
    cells = F.transform(F.flatten("vectors"), lambda x: (x * 8).cast("int").cast("string"))
    return made.select("request_id", F.size("vectors").alias("n_rows"), F.array_join(cells, ",").alias("cells"))
