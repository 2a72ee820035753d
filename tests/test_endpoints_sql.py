"""endpoint_alpha against its SQL where calls repeat."""

import duckdb

from strataloom import queries as Q


def test_equal_calls_are_one_endpoint(spark, tmp_path):
    url = "https://h.example/api/v1/auth"
    pages = [(1, url), (31, url), (61, url), (2, "https://h.example/api/v1/token"), (3, "https://h.example/login?x=1"), (4, "https://other.example/admin/import")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    documents = [(3, "def", "en", "h.example", 3), (25, "def", "en", "h.example", 3), (13, "def", "en", "other.example", 3), (19, None, "en", "h.example", 0)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.queries()["endpoint_alpha"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("pages", "documents"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(Q.oracle_sql()["endpoint_alpha"])
    got = sorted(tuple(r[c] for c in want.columns) for r in rows.collect())
    assert got == sorted(want.fetchall()) and sum(r[1] == "/api/v1/auth" for r in got) == 1
