"""Text columns: tokens, cleaning, splitting, prompts and verdicts. All are built-in Spark expressions."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's built-in English stop words.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too
very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm
you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't
doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()
PUNCTUATION = string.punctuation
END_MARK = "<|im_end|>"
#: Separators of the levels of text.
LEVELS = {"line": "\n", "word": " ", "sentence": "."}
#: Where the fields of a verdict stand.
VERDICT = {
    "reasoning": r"""["']reasoning["']\s*:\s*['"](.+?)['"],""",
    "error": r"""["']error["']\s*:\s*['"]?(.+?)['"]?,""",
    "correction": r"""["']correction["']\s*:\s*['"]?(.+?)['"]?,""",
    "factuality": r"""["']factuality["']\s*:\s*(True|False|'True'|'False')""",
}
#: The lines of prompts and of a report, which callers read.
HEADS = {"text": "[text]:", "claim": "[claim]:", "response": "[response]:"}
APPRAISAL = {"text": "The following is the given text [text]:", "evidences": "The following is the provided evidences [evidences]:"}
REPORT = {
    "claim": ('|====> Claim "', '" verified with the following queries:\n'),
    "query": ('|========> SearchQuery "', '" supported by the following passages:\n'),
    "passage": ("|============> Passage ", ": "),
    "response": ("[ID: ", "]\nQ: ", "\nA: ", "\nClaims:\n"),
}


def tokenize(text: Column, stopwords: list[str] | None = None) -> Column:
    """Words without ASCII punctuation, in lower case, less the stop words. Punctuation goes first: by a pattern, as Spark's translate looks each character up in a map."""
    drop = STOPWORDS if stopwords is None else stopwords
    words = F.split(F.lower(F.regexp_replace(text, f"[{re.escape(PUNCTUATION)}]+", "")), r"\s+")
    return F.filter(words, lambda x: ~x.isin("", *drop))


def clean_generation(text: Column, mode: str) -> Column:
    """Generated text without its end mark. answer: stripped before; claims: no spaces first; queries: nor blanks last."""
    if mode == "answer":
        return F.replace(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(END_MARK), F.lit(""))
    clean = F.ltrim(F.replace(text, F.lit(END_MARK), F.lit("")))
    if mode == "claims":
        return clean
    if mode == "queries":
        return F.regexp_replace(clean, r"[ \n]+$", "")
    raise ValueError(f"unknown mode {mode!r}")


def non_empty(pieces: Column) -> Column:
    return F.filter(pieces, lambda x: x != "")


def pieces(text: Column, level: str) -> Column:
    """The non-empty pieces of a text at a level: full, line, word or sentence."""
    if level == "full":
        return non_empty(F.array(text))
    return non_empty(F.split(text, r"\." if level == "sentence" else LEVELS[level], -1))


def with_sentinel(found: Column) -> Column:
    """A parent without children has one blank child."""
    return F.when(F.coalesce(F.size(found), F.lit(0)) == 0, F.array(F.lit(""))).otherwise(found)


def children(df: DataFrame, found: Column, keys: list[str], id_col: str, value_col: str, last_col: str) -> DataFrame:
    """A row for each piece, with its place and whether it is the last: both from the array, without a shuffle."""
    rows = df.select(*keys, found.alias("_found")).select(*keys, "_found", F.posexplode_outer("_found").alias(id_col, value_col)).where(F.col(id_col).isNotNull())
    return rows.select(*keys, id_col, value_col, (F.col(id_col) == F.size("_found") - 1).alias(last_col))


def split_text(df: DataFrame, col: str, level: str, keys: list[str], id_col: str) -> DataFrame:
    """Child rows of a text column: keys, id_col, the piece under the column's name, and ``last``."""
    return children(df, pieces(F.col(col), level), keys, id_col, col, "last")


def extract_claims(answers: DataFrame) -> DataFrame:
    """answers(request_id, generation) to claims: one for each line, and a blank one where there is none."""
    found = with_sentinel(pieces(clean_generation(F.col("generation"), "claims"), "line"))
    return children(answers, found, ["request_id"], "claim_id", "claim", "last_claim")


def extract_questions(generated: DataFrame) -> DataFrame:
    """(request_id, claim_id, generation) to questions: one for each line, and a blank one where there is none."""
    found = with_sentinel(pieces(clean_generation(F.col("generation"), "queries"), "line"))
    return children(generated, found, ["request_id", "claim_id"], "question_id", "question", "last_question")


def extract_tokens(questions: DataFrame) -> DataFrame:
    """questions to words with their place; a question without words has one blank word."""
    found = with_sentinel(non_empty(F.split("question", "[ \n]", -1)))
    return children(questions, found, ["request_id", "claim_id", "question_id"], "pos", "word", "last_token")


def build_prompt(kind: str, text: Column, evidence: Column | None = None) -> Column:
    """Prompt of a stage: claims from an answer, questions from a claim, or an appraisal with evidence texts."""
    if kind == "claims":
        return F.concat_ws("\n", F.lit(HEADS["text"]), text, F.lit(HEADS["response"]))
    if kind == "questions":
        return F.concat_ws("\n", F.lit(HEADS["claim"]), text, F.lit(HEADS["response"]))
    if kind == "appraisal":
        parts = [F.lit(APPRAISAL["text"]), text, F.lit(APPRAISAL["evidences"])]
        return F.concat_ws("\n", *parts, F.array_join(evidence, "\n"))
    raise ValueError(f"unknown kind {kind!r}")


def chat_messages(system: Column, user: Column) -> Column:
    """The system and the user message, as an array of (role, content)."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", system), message("user", user))


def parse_verdict(text: Column) -> Column:
    """reasoning, error, correction and factuality; blank and false where they aren't found."""
    found = {k: F.coalesce(F.regexp_extract(text, p, 1), F.lit("")) for k, p in VERDICT.items()}
    factual = F.contains(F.lower(found.pop("factuality")), F.lit("true"))
    return F.struct(*(c.alias(k) for k, c in found.items()), factual.alias("factuality"))


def render_report(request_id: Column, question: Column, answer: Column, claims: Column) -> Column:
    """Indented text of a response; claims: array of (claim, questions: array of (question, passages: array of (doc_id, text)))."""
    (c0, c1), (q0, q1), (p0, p1) = (map(F.lit, REPORT[k]) for k in ("claim", "query", "passage"))
    head, asked, answered, listed = map(F.lit, REPORT["response"])
    passage = lambda p: F.concat(p0, p["doc_id"].cast("string"), p1, p["text"])
    query = lambda q: F.concat(q0, q["question"], q1, F.array_join(F.transform(q["passages"], passage), "\n"))
    claim = lambda c: F.concat(c0, c["claim"], c1, F.array_join(F.transform(c["questions"], query), "\n"))
    return F.concat(head, request_id.cast("string"), asked, question, answered, answer, listed, F.array_join(F.transform(claims, claim), "\n"))
