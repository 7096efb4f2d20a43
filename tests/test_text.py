import re

import pytest
from pyspark.sql import functions as F

from verity.functions import text


def claims(spark, value):
    df = spark.createDataFrame([(1, value)], "request_id long, generation string")
    return [(r["claim_id"], r["claim"], r["last_claim"]) for r in text.extract_claims(df).orderBy("claim_id").collect()]


@pytest.mark.parametrize(
    "value, want",
    [
        ("", [(0, "", True)]),
        ("<|im_end|>", [(0, "", True)]),
        ("a\nb\n", [(0, "a", False), (1, "b", True)]),
        ("a\n\n\nb", [(0, "a", False), (1, "b", True)]),
        ("   a\n b", [(0, "a", False), (1, " b", True)]),
        ("a\nb\nc\nd", [(0, "a", False), (1, "b", False), (2, "c", False), (3, "d", True)]),
    ],
)
def test_claims(spark, value, want):
    assert claims(spark, value) == want


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_punctuation_goes_before_stop_words(spark):
    assert one(spark, text.tokenize(F.col("t")), "Don't stop, the END") == ["dont", "stop", "end"]


def test_tokens_take_no_lookup_a_character(spark):
    """Every ASCII mark goes, whatever stands beside it, and others stay; Spark's translate isn't used, which took half as long again."""
    value = "".join(f"{chr(i)}A{chr(i)}{chr(i + 1)} " for i in range(1, 0x180)) + "\\E [x] a&&b \u00a0\u2028 ‘q’ 😀! the"
    bare = value.translate(str.maketrans("", "", text.PUNCTUATION))
    for drop in (None, [], ["a"]):
        known = set(text.STOPWORDS if drop is None else drop)
        want = [w for w in re.split("[ \t\n\x0b\f\r]+", bare) if w and w.lower() not in known]
        assert [w.lower() for w in want if "İ" not in w] == [w for w in one(spark, text.tokenize(F.col("t"), drop), value) if "i̇" not in w]
    plan = spark.createDataFrame([(value,)], "t string").select(text.tokenize(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan


def test_verdicts(spark):
    full = one(spark, text.parse_verdict(F.col("t")), "{ 'reasoning': 'r', 'error': 'None', 'correction': 'c', 'factuality': True }")
    assert full.asDict() == {"reasoning": "r", "error": "None", "correction": "c", "factuality": True}
    assert one(spark, text.parse_verdict(F.col("t")), "hello").asDict() == {"reasoning": "", "error": "", "correction": "", "factuality": False}


def test_report(spark):
    row = spark.sql("SELECT 7L AS id, 'q' AS q, 'a' AS a, array(named_struct('claim', 'c', 'questions', array(named_struct('question', 'w', 'passages', array(named_struct('doc_id', 3L, 'text', 'p')))))) AS c")
    out = row.select(text.render_report(F.col("id"), F.col("q"), F.col("a"), F.col("c")).alias("r")).first()["r"]
    assert out.split("\n") == ["[ID: 7]", "Q: q", "A: a", "Claims:", '|====> Claim "c" verified with the following queries:', '|========> SearchQuery "w" supported by the following passages:', "|============> Passage 3: p"]


def test_appraisal_prompt(spark):
    prompt = text.build_prompt("appraisal", F.col("t"), F.array(F.lit("e1"), F.lit("e2")))
    assert one(spark, prompt, "c").split("\n")[1:] == ["c", "The following is the provided evidences [evidences]:", "e1", "e2"]


def test_unknown_names_raise():
    with pytest.raises(ValueError):
        text.build_prompt("none", F)
