"""Spelling variants against every pair of words, by plain Python."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from verity.llm import queries, spelling


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def count(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 199 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            n[low] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def plain(docs):
    words = count(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return sorted(out)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def varied(rng, word, alphabet):
    k = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:k] + (rng.choice(alphabet) if kind else "") + word[k + (kind < 2) :]


@pytest.mark.parametrize("alphabet", ["abc", "abcdefghéÀß", "xy"])
def test_groups_equal_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 14))) for _ in range(40)]
    base += ["prefix" + "".join(rng.choice(alphabet) for _ in range(3)) for _ in range(30)]  # a frequent beginning
    some = base + [varied(rng, w, alphabet) for w in base for _ in range(3)]
    some += [varied(rng, w, alphabet) for w in some]
    tokens = []
    for w in some:
        tokens += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 4, 5, 6, 30, 160, 900])
    rng.shuffle(tokens)
    docs, k = [], 0
    while tokens:
        size = rng.choice([0, 1, 50, 5000])
        docs.append((k % 300 if k % 17 else None, rng.choice([" ", "-", "\n", "7", "漢"]).join(tokens[:size])))
        tokens, k = tokens[size:], k + 1
    docs += [(1, None), (2, ""), docs[0], (None, "lonely"), (3, "q" * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.group_variants(df)
    assert sorted(got.columns) == sorted(COLUMNS)
    rows = sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=lambda r: r[0])
    assert rows == plain(docs)
    assert any(r[3] for r in rows)


def test_chains_of_forms_are_followed_to_the_end(spark):
    chain = [("abcdefghij"[: 10 - k] + "zzzzzzzzzz"[:k], 5 * 6 ** (6 - k)) for k in range(7)]
    forms = spark.createDataFrame([(w, n, 1, *(chain[k - 1] if k else (None, None))) for k, (w, n) in enumerate(chain)], "word string, n long, n_near long, form string, form_n long")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"abcdefghij"}
    assert spelling.roots(forms).count() == 6


def test_pairs_meet_once_and_only_if_near(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) for _ in range(300)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = sorted((r["a"], r["b"]) for r in spelling.near_pairs(df).collect())
    want = sorted((min(a, b, key=lambda w: (len(w), w)), max(a, b, key=lambda w: (len(w), w))) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(df).collect() == []


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op13_spelling_variants"])
    names = [x[0] for x in cur.description]
    got = queries.op13_spelling_variants(spark, data)
    key = lambda r: str(r)
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted(cur.fetchall(), key=key)
