"""Copies of documents are counted as the query's SQL has them, those of the empty text too."""

from quillstone.plans import catalog, library  # noqa: F401
from tests import oracle


def test_empty_texts_have_a_digest_like_others(spark, tmp_path):
    rows = [(1, "a b"), (2, ""), (3, "a b"), (4, None), (5, ""), (6, " "), (7, "ß\u0000𝄞"), (None, ""), (None, "c")]
    docs = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(docs)
    query, con = catalog.QUERIES["exact_dup_docs"], oracle.duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{docs}/*.parquet')")
    same, n, why = oracle.compare(spark, con, query.run, query.sql, str(tmp_path))
    assert same, why
    assert n == 5
