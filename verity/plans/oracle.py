"""DuckDB SQL that gives what the queries give."""

from __future__ import annotations

from verity.functions.text import PUNCTUATION, STOPWORDS, VERDICT


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOPS = "[" + ", ".join(map(_text, STOPWORDS)) + "]"


def _tokens(col: str) -> str:
    return f"list_filter(string_split_regex(lower(translate({col}, {_text(PUNCTUATION)}, '')), '\\s+'), lambda x: x <> '' AND NOT list_contains({STOPS}, x))"


def _words(col: str) -> str:
    return f"list_filter(string_split_regex({col}, '[ \\t\\n\\f\\r]+'), lambda x: x <> '')"


def _cell(word: str, j: str) -> str:
    """Eight times a number of the stand-in encoder's vector of a word."""
    return f"(len({word}) * 31 + CASE WHEN {j} > len({word}) THEN 0 ELSE unicode(substr({word}, {j}, 1)) END * 7) % 17 - 8"


def _pieces(col: str, separator: str) -> str:
    return f"list_filter(string_split({col}, {separator}), lambda x: x <> '')"


def _or_blank(found: str) -> str:
    return f"CASE WHEN coalesce(len({found}), 0) = 0 THEN [''] ELSE {found} END"


LF, SPACE = "chr(10)", "' '"
#: Named parts of the statements; each may use those before it.
PARTS = {
    "tok": f"SELECT doc_id, {_tokens('text')} AS toks FROM documents",
    "tf": "SELECT term, doc_id, count(*)::INT AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY term, doc_id",
    "dl": "SELECT doc_id, len(toks)::INT AS len FROM tok",
    "st": "SELECT min(doc_id) AS pid_offset, count(*) AS n, avg(len) AS avgdl FROM dl",
    "vocab": "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, count(*) AS df FROM tf GROUP BY term",
    "idfs": "SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf, avgdl FROM vocab, st",
    "imp": "SELECT tf.term, tf.doc_id, idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl)) AS impact FROM tf JOIN idfs USING (term) JOIN dl USING (doc_id)",
    "bench": f"SELECT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark",
    "requests": "SELECT conv_id * 1000 + turn AS request_id, text AS query FROM conversations WHERE role = 'user'",
    "answers": "SELECT conv_id * 1000 + turn - 1 AS request_id, text AS generation FROM conversations WHERE role = 'assistant'",
    "claim_lists": f"SELECT request_id, {_or_blank(_pieces('ltrim(generation)', LF))} AS l FROM answers",
    "claims": "SELECT request_id, (i - 1)::INT AS claim_id, l[i] AS claim, i = len(l) AS last_claim FROM (SELECT request_id, l, unnest(generate_series(1, len(l))) AS i FROM claim_lists)",
    "question_lists": "SELECT request_id, claim_id, " + _or_blank("list_filter(list_transform(string_split(claim, '.'), lambda x: trim(x)), lambda x: x <> '')") + " AS l FROM claims",
    "questions": "SELECT request_id, claim_id, (i - 1)::INT AS question_id, l[i] AS question, i = len(l) AS last_question FROM (SELECT request_id, claim_id, l, unnest(generate_series(1, len(l))) AS i FROM question_lists)",
    "token_lists": "SELECT request_id, claim_id, question_id, " + _or_blank(_pieces("question", SPACE)) + " AS l FROM questions",
    "words": "SELECT request_id, claim_id, question_id, (i - 1)::INT AS pos, l[i] AS word, i = len(l) AS last_token FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM token_lists)",
    "qterms": f"SELECT request_id, claim_id, question_id, unnest({_tokens('question')}) AS term FROM questions",
    "scored": "SELECT request_id, claim_id, question_id, doc_id, round(sum(impact), 4) AS score FROM qterms JOIN imp USING (term) GROUP BY ALL",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY request_id, claim_id, question_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored",
    "hits": "SELECT * FROM ranked WHERE rank <= 5",
    "fused": "SELECT *, row_number() OVER (PARTITION BY request_id, claim_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT request_id, claim_id, doc_id, round(sum(1.0::DOUBLE / rank), 4) AS score FROM hits GROUP BY ALL)",
    "best": "SELECT * FROM fused WHERE rank <= 3",
    "sent": "SELECT event_id AS request_id, epoch_us(ts) / 1e6 AS sent_time, 'client_out_rate_' || (user_id % 3) || '_possion_0.json' AS run_file FROM events WHERE event_type <> 'error'",
    "recv": "SELECT event_id AS request_id, epoch_us(ts) / 1e6 + value AS recv_time FROM events WHERE event_type <> 'signup'",
    "took": "SELECT request_id, run_file, sent_time, recv_time, recv_time - sent_time AS latency FROM sent JOIN recv USING (request_id)",
    "ticks": "SELECT DISTINCT 'client_out_rate_' || (user_id % 3) || '_possion_0.json' AS run_file, (floor(epoch_us(ts) / 1e6 / 86400.0) + 1) * 86400.0 AS time FROM events",
    "log": """SELECT run_file, time, num_requests_sent, last_request_sent_time, num_responses_recv, last_response_recv_time, avg_latency, median_latency, p99_latency FROM
        (SELECT t.run_file, t.time, count(request_id) AS num_requests_sent, max(sent_time) AS last_request_sent_time FROM ticks t LEFT JOIN sent s ON s.run_file = t.run_file AND sent_time <= t.time GROUP BY ALL)
        JOIN (SELECT t.run_file, t.time, count(request_id) AS num_responses_recv, max(recv_time) AS last_response_recv_time, avg(latency) AS avg_latency, quantile_cont(latency, 0.5) AS median_latency, quantile_cont(latency, 0.99) AS p99_latency
              FROM ticks t LEFT JOIN took s ON s.run_file = t.run_file AND recv_time <= t.time GROUP BY ALL) USING (run_file, time)""",
    "rising": "SELECT *, coalesce(max(num_requests_sent) OVER (PARTITION BY run_file ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log",
    "inc": "SELECT * FROM rising WHERE num_requests_sent > before QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time DESC) = 1",
    "act": "SELECT * FROM log WHERE num_responses_recv > 0 QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time) = 1",
    "starts": "SELECT log.* FROM log JOIN act USING (run_file) WHERE log.time >= act.time + 86400.0 QUALIFY row_number() OVER (PARTITION BY log.run_file ORDER BY log.time) = 1",
    "ends": "SELECT log.* FROM log JOIN inc USING (run_file) WHERE log.time <= inc.time - 172800.0 QUALIFY row_number() OVER (PARTITION BY log.run_file ORDER BY log.time DESC) = 1",
    "stats": """SELECT e.run_file, s.time AS start_time, e.time AS end_time, e.time - s.time AS time_length, e.avg_latency AS latency_avg, e.median_latency AS latency_median, e.p99_latency AS latency_p99,
        CASE WHEN e.time <> s.time THEN (e.num_requests_sent - s.num_requests_sent) / (e.time - s.time) END AS achieved_rate,
        CASE WHEN e.time <> s.time THEN (e.num_responses_recv - s.num_responses_recv) / (e.time - s.time) END AS throughput_avg FROM starts s JOIN ends e USING (run_file)""",
    "pairs": "SELECT q.vec_id % 20 AS query_id, q.vec_id AS tok_pos, d.label::BIGINT AS doc_id, max(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])) AS best FROM embeddings q, embeddings d GROUP BY ALL",
    "sims": "SELECT query_id, doc_id, round(sum(best), 4) AS score FROM pairs GROUP BY ALL",
    "cands": "SELECT DISTINCT vec_id % 20 AS query_id, (vec_id % 20 + k) % 10 AS doc_id FROM embeddings, range(7) t(k)",
    "stage_rows": "SELECT event_type AS stage, user_id, epoch_us(ts) / 1e6 AS out_time FROM events",
    "stage_in": "SELECT user_id, min(out_time) AS in_time FROM stage_rows GROUP BY user_id",
    "fanout": "SELECT stage, user_id, round(min(out_time) - any_value(in_time), 4) AS min_latency, round(max(out_time) - any_value(in_time), 4) AS max_latency, count(*) AS num_out FROM stage_rows JOIN stage_in USING (user_id) GROUP BY stage, user_id",
    "asked": "SELECT request_id, claim_id, list({'question': question, 'doc': doc} ORDER BY question_id) AS questions FROM (SELECT request_id, claim_id, question_id, question, coalesce(list(doc_id ORDER BY rank) FILTER (doc_id IS NOT NULL), []) AS doc FROM questions LEFT JOIN hits USING (request_id, claim_id, question_id) GROUP BY ALL) GROUP BY request_id, claim_id",
    "nested": "SELECT request_id, generation, to_json(list({'claim': claim, 'questions': questions} ORDER BY claim_id))::VARCHAR AS claims FROM answers JOIN claims USING (request_id) JOIN asked USING (request_id, claim_id) GROUP BY request_id, generation",
    "whole": "SELECT request_id, claim_id, max(CASE WHEN last_question THEN question_id + 1 END) AS expected, count(DISTINCT question_id) AS got FROM questions SEMI JOIN hits USING (request_id, claim_id, question_id) GROUP BY ALL",
    "done": """SELECT request_id FROM (SELECT request_id, count(*) AS n FROM whole WHERE got = expected GROUP BY request_id)
        JOIN (SELECT request_id, max(CASE WHEN last_claim THEN claim_id + 1 END) AS expected FROM claims GROUP BY request_id) USING (request_id) WHERE n = expected""",
}


def _whole_plan() -> dict[str, str]:
    """Parts of the plan with generated answers, asked queries and re-ranking, under names that start with p_."""
    import re

    def renamed(name: str) -> str:
        own = "answers claims questions token_lists qterms scored ranked hits asked".split()
        return re.sub(r"\b(" + "|".join(own) + r")\b", r"p_\1", PARTS[name])

    lines = f"rtrim(ltrim(claim || {LF} || substr(claim, 1, len(claim) // 2)), ' ' || {LF})"
    matrix = lambda ws: f"list_transform(range(1, 33), lambda i: list_transform(range(1, 9), lambda j: CASE WHEN i > len({ws}) THEN 0 ELSE {_cell(f'{ws}[i]', 'j')} END))"
    return {
        "p_answers": f"SELECT request_id, trim(query, ' ' || {LF} || chr(9)) AS generation FROM requests",
        "p_claim_lists": f"SELECT request_id, {_or_blank(_pieces('ltrim(generation)', LF))} AS l FROM p_answers",
        "p_claims": PARTS["claims"].replace("claim_lists", "p_claim_lists"),
        "p_question_lists": f"SELECT request_id, claim_id, CASE WHEN trim(claim) = '' THEN [''] ELSE {_or_blank(_pieces(lines, LF))} END AS l FROM p_claims",
        "p_questions": PARTS["questions"].replace("question_lists", "p_question_lists"),
        "p_qterms": renamed("qterms"),
        "p_scored": renamed("scored"),
        "p_ranked": renamed("ranked"),
        "p_q": f"SELECT request_id, claim_id, question_id, {matrix('ws')} AS q FROM (SELECT *, {_words('question')}[1:32] AS ws FROM p_questions)",
        "p_d": f"SELECT doc_id, {matrix('ws')} AS d FROM (SELECT doc_id, {_words('text')}[1:32] AS ws FROM documents)",
        "p_near": """SELECT request_id, claim_id, question_id, doc_id, round(list_sum(list_transform(q, lambda a: list_max(list_transform(d, lambda b: list_inner_product(a::DOUBLE[], b::DOUBLE[]))))) / 64, 4) AS score
            FROM p_ranked JOIN p_q USING (request_id, claim_id, question_id) JOIN p_d USING (doc_id) WHERE rank <= 20""",
        "p_hits": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, claim_id, question_id ORDER BY score DESC, doc_id)::INT AS rank FROM p_near) WHERE rank <= 3",
        "p_asked": renamed("asked").replace("AS p_questions", "AS questions"),
    }


PARTS |= _whole_plan()


def _sql(body: str) -> str:
    """The statement with the parts that it needs, in order."""
    import re

    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in PARTS.keys() & words - needed:
            needed.add(name)
            todo.append(PARTS[name])
    parts = ", ".join(f"{name} AS ({text})" for name, text in PARTS.items() if name in needed)
    return f"WITH {parts} {body}" if parts else body


def _topk(weight: str) -> str:
    terms = "SELECT DISTINCT query_id, term FROM bench" if weight == "set" else "SELECT query_id, term FROM bench"
    return f"SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, doc_id, round(sum(impact), 4) AS score FROM ({terms}) JOIN imp USING (term) GROUP BY ALL)) WHERE rank <= 10"


def _best5(source: str) -> str:
    return f"SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {source}) WHERE rank <= 5"


def _verdict(claim: str) -> str:
    clean = f"regexp_replace({claim}, '[''\",\\n]', '', 'g')"
    return f"('{{ ''reasoning'': ''about ' || {clean} || ''', ''error'': ''None'', ''correction'': ''c'', ''factuality'': ' || CASE WHEN length({claim}) % 2 = 0 THEN 'True' ELSE 'False' END || ' }}')"


def _parsed(text: str) -> str:
    get = lambda k: f"coalesce(regexp_extract({text}, {_text(VERDICT[k])}, 1), '')"
    return ", ".join(f"{get(k)} AS {k}" for k in ("reasoning", "error", "correction")) + f", contains(lower({get('factuality')}), 'true') AS factuality"


PROMPT = "'The following is the given text [text]:' || chr(10) || claim || chr(10) || 'The following is the provided evidences [evidences]:' || chr(10) || texts"
ENTRY = "run_file, time, num_requests_sent, num_responses_recv, round(avg_latency, 4) AS avg_latency"
MARKED = "'  ' || generation || '<|im_end|> ' || chr(10)"
LEVEL = "SELECT request_id, '{0}' AS level, unnest({1}) AS g FROM answers"
LEVELS = " UNION ALL ".join(LEVEL.format(name, found) for name, found in (("full", "list_filter([generation], lambda x: x <> '')"), ("line", _pieces("generation", LF)), ("word", _pieces("generation", SPACE)), ("sentence", _pieces("generation", "'.'"))))
REPORT = """SELECT request_id, '[ID: ' || request_id || ']' || chr(10) || 'Q: ' || query || chr(10) || 'A: ' || generation || chr(10) || 'Claims:' || chr(10) || string_agg(c, chr(10) ORDER BY claim_id) AS report FROM
    (SELECT request_id, claim_id, '|====> Claim "' || claim || '" verified with the following queries:' || chr(10) || string_agg(q, chr(10) ORDER BY question_id) AS c FROM
      (SELECT request_id, claim_id, question_id, claim, '|========> SearchQuery "' || question || '" supported by the following passages:' || chr(10) || coalesce('|============> Passage ' || h.doc_id || ': ' || d.text, '') AS q
       FROM questions JOIN claims USING (request_id, claim_id) LEFT JOIN (SELECT * FROM hits WHERE rank = 1) h USING (request_id, claim_id, question_id) LEFT JOIN documents d ON d.doc_id = h.doc_id) GROUP BY request_id, claim_id, claim)
    JOIN answers USING (request_id) JOIN requests USING (request_id) GROUP BY request_id, query, generation"""

BODIES = {
    "tokenize_docs": "SELECT doc_id, array_to_string(toks, ' ') AS tokens, len(toks)::INT AS len FROM tok",
    "term_frequencies": "SELECT * FROM tf",
    "vocabulary_df": "SELECT * FROM vocab",
    "doc_lengths": "SELECT * FROM dl",
    "corpus_stats": "SELECT pid_offset, n, round(avgdl, 6) AS avgdl FROM st",
    "idf_table": "SELECT term, round(idf, 6) AS idf FROM idfs",
    "impacts": "SELECT term, doc_id, round(impact, 6) AS impact FROM imp",
    "bm25_topk": _topk("set"),
    "bm25_bag_topk": _topk("bag"),
    "bm25_oov_terms": "SELECT DISTINCT query_id, term FROM bench ANTI JOIN vocab USING (term)",
    "bm25_known_terms": "SELECT query_id, count(DISTINCT term) AS n_terms FROM bench SEMI JOIN vocab USING (term) GROUP BY query_id",
    "bm25_pruned_topk": _topk("set"),
    "numbered_documents": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS request_id, doc_id, lang, source, md5(text) AS text_md5 FROM documents",
    "search_batches": "SELECT item_id AS query_id, text, (ntile(9) OVER (ORDER BY item_id) - 1)::INT AS batch FROM benchmark",
    "claims": "SELECT * FROM claims",
    "questions": "SELECT * FROM questions",
    "tokens": "SELECT request_id, claim_id, question_id, pos, word, last_token FROM words",
    "split_levels": f"SELECT request_id, level, count(*) AS n, max(g) AS greatest FROM ({LEVELS}) GROUP BY ALL",
    "clean_generations": f"SELECT request_id, replace(regexp_replace({MARKED}, '^\\s+|\\s+$', '', 'g'), '<|im_end|>', '') AS answer, ltrim(replace({MARKED}, '<|im_end|>', '')) AS claims, regexp_replace(ltrim(replace({MARKED}, '<|im_end|>', '')), '[ \\n]+$', '') AS queries FROM answers",
    "child_counts": """SELECT request_id, -1 AS claim_id, max(CASE WHEN last_claim THEN claim_id + 1 END)::BIGINT AS expected, count(DISTINCT claim_id) AS got FROM claims GROUP BY request_id
        UNION ALL SELECT request_id, claim_id, max(CASE WHEN last_question THEN question_id + 1 END)::BIGINT, count(DISTINCT question_id) FROM questions GROUP BY request_id, claim_id""",
    "incomplete_requests": "SELECT request_id FROM requests ANTI JOIN done USING (request_id)",
    "complete_requests": "SELECT request_id FROM requests SEMI JOIN done USING (request_id)",
    "prompts": "SELECT request_id, claim_id, '[text]:' || chr(10) || claim || chr(10) || '[response]:' AS text_prompt, '[claim]:' || chr(10) || claim || chr(10) || '[response]:' AS claim_prompt FROM claims",
    "chat_messages_json": "SELECT request_id, to_json([{'role': 'system', 'content': 'Answer briefly.'}, {'role': 'user', 'content': query}])::VARCHAR AS messages FROM requests",
    "parsed_verdicts": f"SELECT request_id, claim_id, {_parsed('made')} FROM (SELECT *, CASE WHEN claim_id % 3 = 2 THEN claim ELSE {_verdict('claim')} END AS made FROM claims)",
    "maxsim_topk": _best5("sims"),
    "rerank_candidates": _best5("(SELECT * FROM sims SEMI JOIN cands USING (query_id, doc_id))"),
    "rerank_fallback": _best5("(SELECT * FROM sims SEMI JOIN (SELECT * FROM cands WHERE query_id % 4 <> 0) USING (query_id, doc_id) UNION ALL SELECT * FROM sims WHERE query_id % 4 = 0)"),
    "matrix_pack_roundtrip": "SELECT vec_id, 8 AS n_rows, true AS same, round(list_inner_product(embedding[1:8]::DOUBLE[], embedding[9:16]::DOUBLE[]), 4) AS dot FROM embeddings",
    "evidence_fusion": "SELECT request_id, claim_id, rank, doc_id, score FROM best",
    "evidence_text": "SELECT request_id, claim_id, rank, doc_id, text FROM best JOIN documents USING (doc_id)",
    "combined_docs": "SELECT DISTINCT request_id, claim_id, doc_id FROM hits",
    "appraisals": f"SELECT request_id, claim_id, claim, {_parsed('made')} FROM (SELECT *, CASE WHEN texts IS NULL THEN '' ELSE {_verdict('(' + PROMPT + ')')} END AS made FROM claims LEFT JOIN (SELECT request_id, claim_id, string_agg(text, chr(10) ORDER BY rank) AS texts FROM best JOIN documents USING (doc_id) GROUP BY ALL) USING (request_id, claim_id))",
    "flow_join_same": "SELECT request_id, query, generation FROM requests JOIN answers USING (request_id)",
    "flow_join_ancestor": "SELECT request_id, generation, string_agg(qs, chr(10) ORDER BY claim_id) AS questions FROM answers JOIN (SELECT request_id, claim_id, string_agg(question, '|' ORDER BY question_id) AS qs FROM questions GROUP BY ALL) USING (request_id) GROUP BY request_id, generation",
    "flow_flatten": "SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY claim_id, question_id) - 1)::INT AS n, question FROM questions",
    "flow_select": "SELECT request_id, generation FROM requests JOIN answers USING (request_id)",
    "flow_pmap": f"""SELECT request_id, line_id, (j - 1)::INT AS word_id, w[j] AS generation FROM (SELECT request_id, line_id, w, unnest(generate_series(1, len(w))) AS j FROM
        (SELECT request_id, (i - 1)::INT AS line_id, {_pieces('l[i]', SPACE)} AS w FROM (SELECT request_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT request_id, {_pieces('generation', LF)} AS l FROM answers))))""",
    "flow_joined_stage": "SELECT request_id, length(query) + length(generation) AS chars FROM requests JOIN answers USING (request_id)",
    "blank_claims": "SELECT trim(claim) = '' AS blank, count(*) AS n, sum(length(claim))::BIGINT AS chars FROM claims GROUP BY ALL",
    "nested_response": "SELECT * FROM nested",
    "verified_responses": """SELECT request_id, trim(query, ' ' || chr(10) || chr(9)) AS generation, len(cl)::INT AS n_claims, list_sum(list_transform(cl, lambda c: greatest(1, len(list_filter(list_transform(string_split(c, '.'), lambda x: trim(x)), lambda x: x <> '')))))::INT AS n_questions
        FROM (SELECT *, """ + _or_blank(_pieces("trim(query, ' ' || chr(10) || chr(9))", LF)) + " AS cl FROM requests)",
    "verified_plan": PARTS["nested"].replace("answers", "p_answers").replace("JOIN claims", "JOIN p_claims").replace("JOIN asked", "JOIN p_asked"),
    "report_text": REPORT,
    "request_latency": "SELECT request_id, sent_time, recv_time, round(latency, 4) AS latency FROM took",
    "unfinished": "SELECT request_id, sent_time, round(1706745600.0::DOUBLE - sent_time, 4) AS waited FROM sent ANTI JOIN recv USING (request_id)",
    "orphans": "SELECT request_id, recv_time FROM recv ANTI JOIN sent USING (request_id)",
    "all_received": "SELECT n_sent, n_recv, n_sent = n_recv AS all_received FROM (SELECT count(DISTINCT request_id) AS n_sent FROM sent), (SELECT count(DISTINCT request_id) AS n_recv FROM recv)",
    "sent_minus_received": "SELECT request_id FROM sent EXCEPT SELECT request_id FROM recv",
    "latency_stats": "SELECT round(avg(latency), 4) AS avg, round(quantile_cont(latency, 0.5), 4) AS median, round(quantile_cont(latency, 0.99), 4) AS p99, count(*) AS count FROM took",
    "stream_latency": "SELECT round(avg(latency), 4) AS avg, count(*) AS count, true AS median_near, true AS p99_near FROM took",
    "latency_benchmark": "SELECT request_id % 7 AS batch, round(avg(latency), 4) AS avg, round(quantile_cont(latency, 0.5), 4) AS median, round(quantile_cont(latency, 0.95), 4) AS p95, count(*) AS count FROM took GROUP BY ALL",
    "latency_snapshots": "SELECT * REPLACE (round(avg_latency, 4) AS avg_latency, round(median_latency, 4) AS median_latency, round(p99_latency, 4) AS p99_latency, round(last_response_recv_time, 4) AS last_response_recv_time) FROM log",
    "stage_fanout": "SELECT * FROM fanout",
    "stage_stats": "SELECT stage, round(avg(max_latency), 3) AS avg, round(quantile_cont(max_latency, 0.5), 3) AS median, round(quantile_cont(max_latency, 0.99), 3) AS p99, count(*) AS count FROM fanout GROUP BY stage",
    "edge_latency": "SELECT event_type AS edge, round(avg(l), 4) AS avg, round(quantile_cont(l, 0.5), 4) AS median, round(quantile_cont(l, 0.99), 4) AS p99, count(*) AS count FROM (SELECT event_type, (epoch_us(ts) / 1e6 + value) - epoch_us(ts) / 1e6 AS l FROM events) GROUP BY ALL",
    "last_increase": f"SELECT {ENTRY} FROM inc",
    "first_active": f"SELECT {ENTRY} FROM act",
    "asof_entry": f"""SELECT {ENTRY}, 'after' AS side FROM (SELECT * FROM log WHERE time >= 1705000000.0 QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time) = 1)
        UNION ALL SELECT {ENTRY}, 'before' AS side FROM (SELECT * FROM log WHERE time <= 1705000000.0 QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time DESC) = 1)""",
    "run_stats": "SELECT run_file, start_time, end_time, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("time_length", "latency_avg", "latency_median", "latency_p99", "achieved_rate", "throughput_avg")) + " FROM stats",
    "run_summary": "SELECT split_part(run_file, '_', 4)::DOUBLE AS rate, round(achieved_rate, 6) AS achieved_rate, round(latency_avg, 6) AS avg_latency, round(latency_median, 6) AS median_latency, round(latency_p99, 6) AS p99_latency, round(throughput_avg, 6) AS throughput_avg FROM stats",
    "rates": """SELECT run_file, round((b.num_requests_sent - a.num_requests_sent) / (b.time - a.time), 6) AS achieved_rate, round((b.num_responses_recv - a.num_responses_recv) / (b.time - a.time), 6) AS throughput_avg
        FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time) = 1) a JOIN (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run_file ORDER BY time DESC) = 1) b USING (run_file)""",
    "asof_many": "SELECT request_id, l.time AS entry_time, l.num_requests_sent FROM sent s ASOF LEFT JOIN log l ON s.run_file = l.run_file AND s.sent_time >= l.time",
    "asof_many_after": "SELECT request_id, l.time AS entry_time, l.num_responses_recv FROM sent s ASOF LEFT JOIN log l ON s.run_file = l.run_file AND s.sent_time <= l.time",
    "bucket_of_key": "SELECT user_id, 1::BIGINT AS buckets, true AS in_range, count(*) AS items FROM events GROUP BY user_id",
    "trailing_throughput": """SELECT event_id, round(CASE WHEN t > o.t THEN (event_id - o.n) / ((t - o.t)::DOUBLE) END * 1e6, 6) AS throughput FROM (SELECT event_id, t, coalesce(
        last_value({'t': t, 'n': event_id}) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 86400000000 PRECEDING),
        first_value({'t': t, 'n': event_id}) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS o FROM (SELECT event_type, event_id, epoch_us(ts) AS t FROM events))""",
    "arrival_gaps": "SELECT event_type, count(g) AS gaps, round(avg(g), 5) AS mean_gap, round(1 / avg(g), 5) AS rate, round(stddev_pop(g) / avg(g), 5) AS cv FROM (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS g FROM (SELECT event_type, epoch_us(ts) / 1e6 AS t FROM events)) GROUP BY event_type",
    "bucket_load_hash": "SELECT bucket, items, round(items / avg(items) OVER (), 4) AS skew FROM (SELECT (user_id % 8)::INT AS bucket, count(*) AS items FROM events GROUP BY 1)",
    "bucket_load_rr": "SELECT bucket, items, round(items / avg(items) OVER (), 4) AS skew FROM (SELECT (k % 8)::INT AS bucket, count(*) AS items FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1)",
    "stream_claims": "SELECT * FROM claims",
    "stream_questions": "SELECT * FROM questions",
    "stream_tokens": "SELECT request_id, claim_id, question_id, pos, word, last_token FROM words",
    "udf_encode": f"""SELECT request_id, 32 AS n_rows, array_to_string(flatten(list_transform(range(1, 33), lambda i: list_transform(range(1, 9), lambda j:
        CASE WHEN i > len(ws) THEN 0 ELSE {_cell("ws[i]", "j")} END))), ',') AS cells FROM (SELECT request_id, {_words("query")}[1:32] AS ws FROM requests)""",
    "stream_bm25": "SELECT request_id, claim_id, question_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
    "stream_rendezvous": "SELECT request_id, claim_id, question_id, claim, question FROM claims JOIN questions USING (request_id, claim_id)",
    "stream_response": "SELECT * FROM nested",
    "stream_appraise": "SELECT request_id, claim_id, claim, coalesce(evidence, '') AS evidence FROM claims LEFT JOIN (SELECT request_id, claim_id, string_agg(doc_id, ',' ORDER BY rank) AS evidence FROM best GROUP BY ALL) USING (request_id, claim_id)",
    "udf_generate": "SELECT request_id, query, query AS generation FROM requests",
    "udf_batched": "SELECT request_id, len(string_split(query, ' '))::BIGINT AS n FROM requests",
    "udf_many": f"SELECT request_id, unnest({_pieces('generation', LF)}) AS line FROM answers",
    "udtf_split": f"SELECT request_id, (i - 1)::INT AS pos, l[i] AS piece FROM (SELECT request_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT request_id, {_pieces('generation', LF)} AS l FROM answers))",
}

ORACLE_SQL = {name: _sql(body) for name, body in BODIES.items()}
