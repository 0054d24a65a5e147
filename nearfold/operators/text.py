"""TF-IDF in long form, (doc, term, weight), and cosine neighbours over it or over dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import squared_norm
from ..plans.stages import maybe_broadcast, small_enough, topk
from .recommend import best_of_block, recommend_topk

FEATURES = 50_000


#: English stop words of two or more letters, the default of every function here.
STOP_WORDS = """
about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers herself him himself
his how if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with would
you your yours yourself yourselves
""".split()


def english() -> list[str]:
    return list(STOP_WORDS)


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores, in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def term_counts(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """(doc, term, tf).

    Texts are dealt by document before they are cut up: the shuffle carries
    texts, not rows of terms, and counts and norms by document need no other.
    """
    stop = english() if stop_words is None else stop_words
    dealt = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")).repartition("doc")
    t = dealt.select("doc", F.explode(tokens(F.col("_text"))).alias("term"))
    if stop:
        t = t.filter(~F.col("term").isin(stop))
    return t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, max_features: int = FEATURES) -> DataFrame:
    """(term, n, df): the terms that occur most in the corpus; ties go to the alphabetically first."""
    per = counts.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    return per.orderBy(F.desc("n"), "term").limit(max_features)


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_features: int = FEATURES, stop_words: list[str] | None = None) -> DataFrame:
    """(doc, term, weight): raw counts times ln((1 + N) / (1 + df)) + 1, each document of length 1. Empty documents have no row."""
    counts = term_counts(docs, id_col, text_col, stop_words)
    vocab = vocabulary(counts, max_features)
    total = docs.agg(F.count(F.lit(1)).alias("_n"))
    idf = vocab.join(total).select("term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(F.broadcast(idf) if max_features <= 200_000 else idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("raw") / norm).alias("weight"))


def nonempty(weights: DataFrame) -> DataFrame:
    """(doc) with at least one term."""
    return weights.select("doc").distinct()


def cosine_topk(weights: DataFrame, queries: DataFrame, k: int = 5, all_docs: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query, other, score, rank) by an inverted index: query terms meet the documents that hold them.

    queries: column doc. all_docs: column doc; with it documents of similarity
    zero fill up to k. Ties go to the smaller id.
    """
    q = weights.join(maybe_broadcast(queries.select("doc").distinct()), "doc", "left_semi").select(F.col("doc").alias("query"), "term", F.col("weight").alias("wq"))
    met = maybe_broadcast(q).join(weights, "term").filter(F.col("doc") != F.col("query"))
    scored = met.groupBy("query", F.col("doc").alias("other")).agg(F.round(F.sum(F.col("wq") * F.col("weight")), digits).alias("score"))
    if all_docs is not None:
        # of the documents of similarity zero the k smallest that aren't among a query's neighbours are enough
        mine = scored.groupBy("query").agg(F.count(F.lit(1)).alias("_n"))
        short = queries.select(F.col("doc").alias("query")).distinct().join(mine, "query", "left").filter(F.coalesce("_n", F.lit(0)) < k)
        few = all_docs.select(F.col("doc").alias("other")).distinct().orderBy("other").limit(2 * k + 1)
        fill = short.select("query").join(F.broadcast(few)).filter("query <> other").join(scored, ["query", "other"], "left_anti")
        scored = scored.unionByName(fill.withColumn("score", F.lit(0.0)))
    return topk(scored, ["query"], [F.desc("score"), F.col("other")], k)


def dense_cosine_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 5, sent_queries: int = 10_000) -> DataFrame:
    """(query, other, score, rank) over dense vectors of one length; a stated query set against all rows. Ties go to the smaller id.

    Up to sent_queries queries go along with the tasks: each batch of rows
    meets them in matrix products and gives its k best a query. For more, the
    rows go along in blocks (recommend_topk). Null ids, and
    vectors that are null, hold null, NaN or infinity or are zero, take no part.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    unit = v.withColumn("n", F.sqrt(squared_norm(F.col("v")))).filter("id IS NOT NULL AND n > 0 AND n < double('infinity')")
    unit = unit.select("id", F.transform("v", lambda x: x / F.col("n")).alias("factor"), F.lit(0.0).alias("bias"))
    q = unit.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    if not small_enough(q, sent_queries):
        seen = q.select(F.col("id").alias("user"), F.col("id").alias("item"))
        own = q.select(*[F.col(c).alias(c) for c in q.columns])  # columns of their own, as queries are rows too
        found = recommend_topk(own, unit, seen, k, digits).select(F.col("user").alias("query"), F.col("item").alias("other"), "score")
        return topk(found, ["query"], [F.desc("score"), F.col("other")], k)  # ids may repeat here
    sent = vectors.sparkSession.sparkContext.broadcast(q.withColumn("seen", F.array("id")).toPandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(sent.value):
                b = b.sort_values("id")
                best = best_of_block(sent.value, b["id"].to_numpy(), np.stack(b["factor"].to_list()), np.zeros(len(b)), k, digits)
                yield pd.DataFrame(best, columns=["query", "other", "score"])

    found = unit.select("id", "factor").mapInPandas(run, "query long, other long, score double")
    return topk(found, ["query"], [F.desc("score"), F.col("other")], k)


def ml_tfidf(docs: DataFrame, text_col: str = "text", max_features: int = FEATURES) -> DataFrame:
    """docs with a vector `features`: the library's pipeline, with the same weights as tfidf()."""
    from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    stop = F.array(*[F.lit(w) for w in english()])
    df = docs.withColumn("_terms", F.filter(tokens(F.col(text_col)), lambda t: ~F.array_contains(stop, t)))
    df = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features).fit(df).transform(df)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(df).idf.toArray() + 1  # the library's idf lacks the 1
    df = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_sum").transform(df)  # vectors stay sparse
    return Normalizer(inputCol="_sum", outputCol="features", p=2.0).transform(df).drop("_terms", "_tf", "_sum")
