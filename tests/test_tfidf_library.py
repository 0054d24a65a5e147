"""The library's TF-IDF query against tfidf() on documents of more than 2,000 terms."""

from nearfold.operators import text
from nearfold.plans.queries import QUERIES


def test_terms_match_tfidf(spark, tmp_path):
    rows = [(1, " ".join(f"w{k}" for k in range(1500))), (2, " ".join(f"w{k}" for k in range(1000, 4000))), (3, "w1 w1 w3999 the"), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.terms for r in QUERIES["tfidf_library"](spark, str(tmp_path)).collect()}
    want = {r.doc: r["count"] for r in text.tfidf(docs).groupBy("doc").count().collect()}
    assert got == {i: want.get(i, 0) for i, _ in rows} and got[2] == 3000
