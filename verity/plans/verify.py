"""The whole plan: requests to nested, ranked evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.functions import text
from verity.functions.inference import generate
from verity.operators.dense import rerank
from verity.operators.index import Index
from verity.operators.nesting import merge_branches, nest_response, split_blank
from verity.operators.search import search

KEYS = ["request_id", "claim_id", "question_id"]


def sentences(claim: Column) -> Column:
    """Stand-in for query generation: a claim's trimmed sentences, one a line."""
    return F.array_join(text.non_empty(F.transform(F.split(claim, r"\.", -1), lambda x: F.trim(x))), "\n")


def questions_of(claims: DataFrame, ask: Callable[[Column], Column] = sentences) -> DataFrame:
    """Questions of each claim; blank claims aren't generated from, and get a blank question."""
    blank, other = split_blank(claims)
    asked = other.select("request_id", "claim_id", ask(F.col("claim")).alias("generation"))
    return text.extract_questions(merge_branches(asked, blank.select("request_id", "claim_id", F.lit("").alias("generation"))))


def verify(requests: DataFrame, index: Index, fn: Callable | None = None, q_tokens: Callable[[DataFrame], DataFrame] | None = None, d_tokens: DataFrame | None = None, k: int = 200, k_rerank: int = 5, ask: Callable[[Column], Column] = sentences, fallback: bool = False) -> DataFrame:
    """requests(request_id, query) to (request_id, generation, claims), each claim with its questions and their documents.

    ``fn`` generates text from prompts (by default it gives them back), and ``ask`` a claim's queries, one a line. With ``q_tokens`` (questions to
    (keys, tok_pos, vec)) and ``d_tokens`` the k BM25 hits are ranked again, and with
    ``fallback`` questions without hits are ranked against all documents.
    """
    answers = generate(requests, "query", "generation", fn) if fn else requests.withColumn("generation", F.col("query"))
    answers = answers.select("request_id", text.clean_generation(F.col("generation"), "answer").alias("generation"))
    claims = text.extract_claims(answers)
    questions = questions_of(claims, ask)
    hits = search(questions, index, k if q_tokens else k_rerank, "bag", KEYS, "question")
    if q_tokens:
        hits = rerank(hits, q_tokens(questions), d_tokens, KEYS, k_rerank, fallback)
    return nest_response(answers, claims, questions, hits)
