"""Secret scans with an incremental ledger of blobs (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verity.llm.common import cut, fresh, maybe_in

#: Marks around matches; they are taken out of the text first, and no pattern matches them or what replaces them.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: Java pattern, the group that must have ``least`` characters, and the rule's version.

    A changed rule gets a new version, and only then are known blobs scanned for it again.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds in the order in which equal starts are listed. The first three are the base rules.
BASE_RULES = [
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run is matched whole, so asking for its length in the pattern drops the same matches as counting after.
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    SecretRule("ghkey", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
]

FINDINGS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _find(text: Column, rule: SecretRule, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, less those that are too short.

    All matches are marked in one pass; the parts between the marks then lie at running sums of their lengths, so
    the work is linear in the text and its matches.
    """
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, OTHER * 2), rule.pattern, f"{OPEN}$0{CLOSE}")
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        span = F.struct(state["at"].alias("start"), end.alias("end"), part.alias("match"))
        found = F.when(state["inside"], F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), found.alias("found"))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("found"))
    found = F.aggregate(parts, first, step, lambda s: s["found"])
    value = lambda x: F.regexp_extract(x["match"], rule.pattern, rule.group) if rule.group else x["match"]
    long = F.filter(found, lambda x: F.length(value(x)) >= rule.least)
    spans = F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))
    # Most texts match nothing, and are not taken apart.
    return F.when(F.rlike(text, F.lit(rule.pattern)), spans).otherwise(F.array()).cast(FINDINGS)


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, id_col: str, text_col: str, rules: list[SecretRule], ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen. Returns (ledger entries to append, all findings by blob).

    ``versions`` has a row for each path and historical version. A blob is a distinct text. The ledger holds
    (blob, rule, findings), a row for each blob and rule version scanned, with no findings too. A version is scanned
    only if its blob misses some rule version, one row for each blob, and for the missing rules only.

    Null text counts as empty; repeated rows are one blob; an empty table gives no entries.
    """
    ids = versions.select(F.col(id_col).alias("_id"), blob_of(F.col(text_col)).alias("blob"))
    one = ids.groupBy("blob").agg(F.min("_id").alias("_id"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        one = one.join(seen, "blob", "left").withColumn("_todo", F.array_except(keys, F.coalesce("_seen", F.array().cast("array<string>"))))
        one = one.where(F.size("_todo") > 0)
    else:
        one = one.withColumn("_todo", keys)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = versions.select(F.col(id_col).alias("_id"), blob_of(text).alias("_blob"), text.alias("_text"))
    todo = texts.join(one, texts["_id"].eqNullSafe(one["_id"]) & (F.col("_blob") == F.col("blob"))).select("blob", "_text", "_todo")
    scanned = [F.when(F.array_contains("_todo", r.key), F.struct(F.lit(r.key).alias("rule"), _find(F.col("_text"), r, k).alias("findings"))) for k, r in enumerate(rules)]
    # The outer form: the other infers a filter on the array, and would scan each text for that too.
    fresh = todo.select("blob", F.explode_outer(F.array(*scanned)).alias("e")).where("e IS NOT NULL").select("blob", "e.rule", "e.findings")
    return fresh.groupBy("blob", "rule").agg(F.first("findings").alias("findings")), ids  # repeated rows are one


def scan_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[SecretRule] | None = None, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every row, and the ledger entries that are new.

    Returns (rows, entries): rows has id_col, blob and ``findings`` (start, rank, kind, end; by start, then kind as
    listed; code points), a row for each row; entries (blob, rule, findings) are written to the shared folder and
    are to be appended to the ledger. Null text counts as empty. Findings are joined back to every row of a blob.
    """
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    fresh, ids = scan(df, id_col, text_col, rules, ledger)
    entries = cut(fresh)
    known = entries if ledger is None else entries.unionByName(ledger.where(F.col("rule").isin([r.key for r in rules])))
    hits = known.where(F.size("findings") > 0).groupBy("blob").agg(F.collect_set("findings").alias("_all"))
    hits = hits.select("blob", F.array_sort(F.array_distinct(F.flatten("_all"))).alias("findings"))
    rows = ids.join(hits, "blob", "left")
    return rows.select(F.col("_id").alias(id_col), "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")), entries


def spans_text(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, rules: list[SecretRule] | None = None) -> DataFrame:
    """The rows of ``df``, all columns, with each secret replaced by its kind in brackets.

    Spans that overlap are one, named by the first. Texts without secrets are as they were, null ones too, and are not
    shuffled, but for few; those with some also get their new length in ``length_col``. Rows are told apart by id and text,
    so null, equal and repeated ids are each given their own; an empty table gives none.
    """
    found, _ = scan_documents(df, id_col, text_col, rules)
    of, its, own, hits = fresh(df, "_of", "_its_blob", "_own", "_hits")
    found = cut(found.where(F.size("findings") > 0).select(F.col(id_col).alias(of), F.col("blob").alias(its), F.col("findings").alias(hits)).distinct())
    looked = maybe_in(found.select(F.xxhash64(of, its).alias("h")))(F.xxhash64(F.col(id_col), blob_of(F.col(text_col))))
    rows = df.where(looked).withColumn(own, blob_of(F.col(text_col))).join(found, F.col(id_col).eqNullSafe(F.col(of)) & (F.col(own) == F.col(its)), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(state: Column, x: Column) -> Column:
        named = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] >= state["at"], named).otherwise(state["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(hits, first, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    hit = F.col(hits).isNotNull()
    out = {text_col: F.when(hit, clean).otherwise(F.col(text_col))}
    if length_col:
        out[length_col] = F.when(hit, F.length(clean).cast("long")).otherwise(F.col(length_col))
    return df.where(~looked).unionByName(rows.withColumns(out).drop(of, its, own, hits))
