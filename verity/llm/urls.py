"""URL filtering by association rules mined from labels (operator 10)."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut

#: The item that stands for an unwanted page in the transactions; a URL token never holds a space.
BLOCK = "label block"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that go before what is mined.
RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


def url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Add ``host`` (A-Z in lower case) and ``path``; both empty for null and for URLs without ``://``."""
    url = F.col(url_col)
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(F.col("_rest"), r"\A[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.col("_rest"), r"\A[^/?#]*([^?#]*)", 1)
    return df.withColumn("_rest", rest).withColumns({"host": host, "path": path}).drop("_rest")


def fits(rule: UrlRule, host: Column, path: Column) -> Column:
    """Whether a rule holds for its host or a subdomain of it, and the path starts with the rule's."""
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[UrlRule], value: str) -> Column:
    """Text or verdict of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(fits(rule, F.col("host"), F.col("path")), F.lit(getattr(rule, value))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels and suffixes of the host, parts of the path (digits as one kind), query keys, scheme."""
    number = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h="), number(x)))
    words = F.transform(F.filter(F.split(host, r"[.-]"), lambda x: ~F.array_contains(F.split(host, r"\."), x)), lambda x: F.concat(F.lit("w="), number(x)))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p="), number(x)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s="), F.substring_index(url, "://", 1)))
    known = F.filter(F.concat(labels, words, parts, keys, scheme), lambda x: (F.length(x) > 2) & ~F.contains(x, F.lit(" ")))
    return F.when(F.locate("://", url) > 0, F.array_distinct(known)).otherwise(F.array().cast("array<string>"))


def mine_rules(tokens: DataFrame, labels: DataFrame, support: float, confidence: float, lift: float, pages: int, sure: float) -> DataFrame:
    """Rules (antecedent, confidence) whose consequent is the block label, from labelled rows (``_id``, ``_tokens``).

    ``labels`` has ``_id`` and ``_bad``. Rules below the support, confidence or lift are pruned, and so is a rule
    with more tokens than another of its tokens and no higher confidence. A rule must hold for ``pages`` labelled pages
    at least, however few there are, and its confidence must be ``sure`` standard errors above the share of unwanted
    pages, so a few pages that happen to be unwanted make no rule.
    """
    known = tokens.join(labels, "_id")
    items = F.when(F.col("_bad"), F.concat(F.col("_tokens"), F.array(F.lit(BLOCK)))).otherwise(F.col("_tokens"))
    baskets = cut(known.select(items.alias("items")).where(F.size("items") > 0))
    total = baskets.count()
    if total < pages:
        return baskets.sparkSession.createDataFrame([], "antecedent array<string>, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=max(support, pages / total), minConfidence=confidence).fit(baskets)
    base, held = F.col("confidence") / F.col("lift"), F.col("support") * total / F.col("confidence")
    error = F.sqrt(F.greatest(base * (1 - base), F.lit(1e-12)) / held)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= lift) & (F.col("confidence") - base >= sure * error))
    rules = cut(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence"))
    # A rule is redundant beside a shorter one: both are looked up by the shorter one's tokens.
    whole = rules.select(F.explode("antecedent").alias("_t"), F.col("antecedent").alias("_long"), F.col("confidence").alias("_high"))
    short = rules.withColumn("_t", F.element_at("antecedent", 1))
    longer = (F.size("_long") > F.size("antecedent")) & (F.size(F.array_except("antecedent", "_long")) == 0) & (F.col("_high") <= F.col("confidence"))
    redundant = short.join(whole, "_t").where(longer).select(F.col("_long").alias("antecedent")).distinct()
    return rules.join(redundant, "antecedent", "left_anti")


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Ids of the rows of (``_id``, ``_tokens``) that hold all tokens of some rule.

    Inverted index: a rule stands under its rarest token only, so frequent tokens lead to few candidates, and the
    rest of the rule is checked against the row's own tokens.
    """
    needed = rules.select(F.explode("antecedent").alias("_t")).distinct()
    postings = tokens.select("_id", "_tokens", F.explode_outer("_tokens").alias("_t")).where("_t IS NOT NULL").join(needed, "_t")
    counts = postings.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    ranked = rules.select("antecedent", F.explode("antecedent").alias("_t")).join(counts, "_t")
    index = ranked.groupBy("antecedent").agg(F.min_by("_t", F.struct("_n", "_t")).alias("_t"))
    whole = F.size(F.array_except("antecedent", "_tokens")) == 0
    return postings.join(index, "_t").where(whole).select("_id").distinct()


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[UrlRule] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    bad: Column | None = None,
    support: float = 0.005,
    confidence: float = 0.5,
    lift: float = 1.2,
    least_pages: int = 10,
    sure: float = 4.0,
) -> DataFrame:
    """Allow or block every URL: the longest given rule that fits, else the mined rules, else allow.

    ``labels`` tells by ``label_id`` which pages are unwanted (``bad``; by default quality 0 or toxic 1, null
    counts as good). A page without label, or with a null id, is judged but teaches nothing; equal labels of an id
    count once, and of differing ones the bad one; of several pages of an id the one with the smallest URL teaches. Null and malformed URLs have an empty host and path and are allowed by default. A row is given for each row; an empty
    table gives none; without labels, or with fewer than ``least_pages`` labelled pages, no rule is mined. Equal
    confidences stand side by side. Returns id_col, host, path, rule, verdict.
    """
    rules = RULES if rules is None else rules
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)) if bad is None else bad
    rows = url_parts(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url")
    # Equal URLs get equal verdicts, so each is matched once, whatever its number of pages.
    urls = rows.select("_url", "host", "path").distinct()
    urls = urls.select(F.col("_url").alias("_id"), url_tokens(F.col("_url"), F.col("host"), F.col("path")).alias("_tokens"))
    taught = labels.select(F.col(label_id).alias("_id"), bad.alias("_bad")).groupBy("_id").agg(F.max("_bad").alias("_bad"))
    # An id teaches once, by the smallest of its URLs.
    first = url_parts(rows.where("_id IS NOT NULL").groupBy("_id").agg(F.min("_url").alias("_url")), "_url")
    seen = first.select("_id", url_tokens(F.col("_url"), F.col("host"), F.col("path")).alias("_tokens"))
    mined = mine_rules(seen, taught, support, confidence, lift, least_pages, sure)
    hit = match_rules(urls, mined).select(F.col("_id").alias("_url"), F.lit(True).alias("_hit"))
    out = rows.join(hit, "_url", "left").withColumns({"rule": longest_rule(rules, "text"), "_given": longest_rule(rules, "verdict")})
    verdict = F.coalesce("_given", F.when(F.col("_hit"), "block"), F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
