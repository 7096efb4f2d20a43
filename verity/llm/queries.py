"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verity.llm import bitplanes, boosting, decontamination, maxent, neardup, packing, rules, secrets, sentencepieces, sharding, spelling, surrogates, urls
from verity.llm.common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the installed package keeps the SentencePiece model."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts give begin and end alone; repeated rows and null ids are documents of their own; an empty table gives none. No other column of the table is read."""
    coded = sentencepieces.encode_decode(_table(spark, sf_dir, "documents"), piece_model())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no words and fail; repeated rows are judged alike; without trusted documents all ratios are 0; an empty table gives none. No other column of the table is read."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return rules.judge_quality(_table(spark, sf_dir, "documents"), trusted)


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty, null ids share a shard, repeated rows have a slot each; an empty table gives none. No other column of the table is read."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def _base_columns() -> list[Column]:
    kinds = [r.kind for r in secrets.BASE_RULES]
    base = F.filter("findings", lambda x: x["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(secrets.spans_text(base), 256).alias("base_sha256")]


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no spans; repeated rows are found in alike; an empty table gives none. No other column of the table is read."""
    found, _ = secrets.scan_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_base_columns(), secrets.spans_text(F.col("findings")).alias("spans"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and malformed URLs have an empty host and path; repeated rows are judged alike; an empty table gives none. No other column of the table is read."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored by their statistics; documents without label teach nothing; an empty table gives none. No other column of the table is read."""
    return boosting.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null counts as empty; texts without words are linked to equal ones only, and texts of fewer than five words are one window; repeated rows are of one class; an empty table gives none. No other column of the table is read."""
    return neardup.join_similar(_table(spark, sf_dir, "documents"))


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts or items match nothing; repeated rows and equal ids give a pair once; empty tables give none. No other column of the table is read."""
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts hold the end token alone; repeated rows count and are scored alike; an empty table gives none. No other column of the table is read."""
    return maxent.score_documents(_table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts stay null; repeated rows are changed alike; an empty table gives none. No other column of the table is read."""
    return surrogates.pseudonymise(_table(spark, sf_dir, "documents"), "corpus")


def byte_model() -> str:
    """Where the installed package keeps the byte-level BPE file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and ids, repeats and empty tables as in ``token_pieces`` and ``pack``; no other column is read."""
    made = packing.token_pieces(_table(spark, sf_dir, "documents"), byte_model())
    return packing.pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op12_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of other sizes, with nulls or non-finite components are left out; repeats and empty tables as in ``cluster``."""
    return bitplanes.cluster(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and ids, repeats and empty tables as in ``group_variants``; no other column is read."""
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted rules of ``op5_quality_rules`` alone, for its SQL; odd rows as there."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of ``op9_secret_ledger`` alone, for its SQL; odd rows as there."""
    return op9_secret_ledger(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def secret_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``secret_base`` by way of a ledger: other rules and documents of even ids first, then what that leaves unseen.

    Odd rows as in ``op9_secret_ledger``; ids that are null are scanned in the second run only.
    """
    docs = _table(spark, sf_dir, "documents")
    old = [replace(r, version=0) if r.kind == "hex" else r for r in secrets.BASE_RULES]
    _, ledger = secrets.scan_documents(docs.where("doc_id % 2 = 0"), rules=old)
    found, _ = secrets.scan_documents(docs, rules=secrets.BASE_RULES, ledger=ledger)
    return found.select("doc_id", *_base_columns())


def url_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given rules of ``op10_url_rules`` alone, for its SQL; odd rows as there."""
    judged = op10_url_rules(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_surrogates, op3_latent_decontamination, op4_maxent_scores, op5_quality_rules, op6_boosted_quality, op7_jaccard_join, op8_hash_tree, op9_secret_ledger, op10_url_rules, op11_bin_completion, op12_bitplane_clusters, op13_spelling_variants, quality_base, secret_base, secret_rescan, url_base)}


def _clusters_sql(rounds: int = 10) -> str:
    """The rounds one after the other, on lists of integers."""
    square = "CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        """rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v AS c FROM rows ORDER BY k LIMIT 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(({square}, k)) AS best FROM rows, c{i} GROUP BY rid)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best[2] AS k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i})")
            parts.append(f"t{i} AS (SELECT k, pos, sum(x) AS s, count(*) AS n FROM s{i} GROUP BY k, pos)")
            parts.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM t{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = f"""SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
      CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON k = best[2]"""
    return "WITH " + ",\n".join(parts) + "\n" + last


def _spelling_sql() -> str:
    """Checksums bit by bit, near words by deleting each code point, roots by following forms."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""WITH RECURSIVE tokens AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    runs AS MATERIALIZED (SELECT run, count(*) AS k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named FROM tokens WHERE length(run) >= 6 GROUP BY doc_id, run),
    hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(named)) ), lambda i: CAST(('0x' || substr(hex(encode(named)), 2 * i + 1, 2)) AS BIGINT))),
      lambda c, b: {byte}), 4294967295::BIGINT) AS h FROM runs),
    made AS (SELECT k, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
    words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made GROUP BY word HAVING sum(k) >= 5 AND length(word) >= 6),
    cuts AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS MATERIALIZED (
      SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (SELECT near.word, count(*) AS n_near, min((-w.n, near.other)) AS b FROM near JOIN words w ON w.word = near.other GROUP BY near.word),
    forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 5 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 5 * n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL)
    SELECT forms.*, chain.at AS root FROM forms JOIN chain USING (word) JOIN forms f ON f.word = chain.at WHERE f.form IS NULL"""


_QUALITY_SQL = r"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS MATERIALIZED (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs)),
counted AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY rid),
windows AS (SELECT rid, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
found AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM docs LEFT JOIN counted USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM found"""

_SECRET_SQL = r"""WITH kinds(kind, rank, least) AS (VALUES ('assign', 0, 6), ('access', 1, 20), ('hex', 2, 24)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT rid, 'assign' AS kind, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
    regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM docs
  UNION ALL SELECT rid, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS m, m, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL SELECT rid, 'hex', regexp_extract_all(t, '[0-9a-f]+') AS m, m, string_split_regex(t, '[0-9a-f]+') FROM docs),
spread AS (SELECT rid, kind, unnest(m) AS m, unnest(v) AS v, unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS k FROM parts),
spans AS (SELECT rid, kind, v, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY k) AS stop, length(m) AS n FROM spread),
kept AS (SELECT spans.*, rank FROM spans JOIN kinds USING (kind) WHERE length(v) >= least),
listed AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || (stop - n) || ':' || stop, ',' ORDER BY stop - n, rank) AS said FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM docs LEFT JOIN listed USING (rid)"""

_URL_SQL = r"""WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rests AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS MATERIALIZED (SELECT rid, page_id, translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM rests),
best AS (SELECT rid, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS given
  FROM parted p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rid)
SELECT page_id, host, path, rule, given FROM parted LEFT JOIN best USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "quality_base": _QUALITY_SQL,
    "secret_base": _SECRET_SQL,
    "secret_rescan": _SECRET_SQL,
    "url_base": _URL_SQL,
    "op13_spelling_variants": _spelling_sql(), "op12_bitplane_clusters": _clusters_sql(),
}
