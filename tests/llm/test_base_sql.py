"""What SQL can express of operators 5, 9 and 10, against that SQL; a rescan with a ledger gives the same."""

import duckdb
import pytest

from verity.llm import queries

TABLES = {"documents": "doc_id", "pages": "page_id"}
ODD_TEXTS = [
    None, "", " \n\t ", "a\n\n\na\na b", "x y z x y z x", "a a a a", "token=abcdef token: 'abcde' TOKEN = \"abc.def=\"",
    "AKIA" + "B" * 16 + "x" + "f" * 24 + "secret=" + "0" * 30, "\u00e9\U0001f600 api_key:" + "9" * 24, "AKIAAKIA" + "C" * 20, "password=passwd=secret1", "#*$%&|<> #\n#*$%&|<> #", "a\x0b\x0cb\x1cc\x85d\u00a0e",
]
ODD_URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/a?b=c#d", "x://example.com/en/", "x://a.example.com/en/q://r", "x://net/es/", "x://a.net/fr", "x://badnet/fr/", "x://com", "x://com/", "x://a.com?x/y", "x://\u00c4.NET/fr/#"]


def same(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    assert got == sorted(map(repr, cur.fetchall()))
    return got


@pytest.mark.parametrize("name", ["quality_base", "secret_base", "secret_rescan", "url_base"])
def test_base_equals_sql(spark, tmp_path, name):
    assert same(spark, name, "/root/testdata/sf0.001")
    folder = str(tmp_path)
    spark.createDataFrame([(i // 2 if i % 5 else None, t) for i, t in enumerate(ODD_TEXTS * 2)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i // 2 if i % 5 else None, u) for i, u in enumerate(ODD_URLS * 2)], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert same(spark, name, folder)
