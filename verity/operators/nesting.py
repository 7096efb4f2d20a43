"""Parents with their children: completeness and nesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def child_counts(children: DataFrame, parent_keys: list[str], id_col: str, last_col: str) -> DataFrame:
    """Announced (from the last flag) and arrived children of each parent."""
    expected = F.max(F.when(F.col(last_col), F.col(id_col) + 1))
    return children.groupBy(*parent_keys).agg(expected.cast("long").alias("expected"), F.countDistinct(id_col).alias("got"))


def complete_requests(requests: DataFrame, answers: DataFrame, claims: DataFrame, questions: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, incomplete) requests: complete with an answer, all announced claims and questions, and the hits of each question."""
    all_claims = child_counts(claims, ["request_id"], "claim_id", "last_claim").where("got = expected").select("request_id", "expected")
    asked = questions.join(hits.select("request_id", "claim_id", "question_id").distinct(), ["request_id", "claim_id", "question_id"], "left_semi")
    full = child_counts(asked, ["request_id", "claim_id"], "question_id", "last_question").where("got = expected")
    full = full.groupBy("request_id").agg(F.count(F.lit(1)).alias("_full"))
    done = all_claims.join(full, "request_id").where("_full = expected").join(answers.select("request_id").distinct(), "request_id", "left_semi").select("request_id")
    return requests.join(done, "request_id", "left_semi"), requests.join(done, "request_id", "left_anti")


def nest_response(answers: DataFrame, claims: DataFrame, questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(request_id, generation, claims): questions with their documents under claims, in the order of ids.

    Each grouping is by a prefix of the keys of the one before.
    """
    keys = ["request_id", "claim_id", "question_id"]
    docs = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("doc"))
    asked = questions.join(docs, keys, "left").select(*keys, F.struct("question_id", "question", F.coalesce("doc", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")).alias("doc")).alias("q"))
    asked = asked.groupBy("request_id", "claim_id").agg(F.sort_array(F.collect_list("q")).alias("q"))
    strip = F.transform("q", lambda x: F.struct(x["question"].alias("question"), x["doc"].alias("doc")))
    made = claims.join(asked, ["request_id", "claim_id"], "left").select("request_id", F.struct("claim_id", "claim", strip.alias("questions")).alias("c"))
    made = made.groupBy("request_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    out = answers.join(made, "request_id", "left")
    return out.select("request_id", "generation", F.transform("c", lambda x: F.struct(x["claim"].alias("claim"), x["questions"].alias("questions"))).alias("claims"))


def split_blank(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blank, other) claims: blank ones need no generation."""
    blank = F.trim("claim") == ""
    return claims.where(blank), claims.where(~blank)


def merge_branches(*branches: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)
