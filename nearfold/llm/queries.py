"""Queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures have no date of their own here: they are dealt over the days of 2024 by their id."""
    from pyspark.sql import functions as F

    from . import url_filter

    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = captures.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    events = spark.createDataFrame(url_filter.EVENTS, "kind string, entry string, day string, action string, category string")
    return url_filter.evaluate(captures, events)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = _documents(spark, sf_dir)
    model = language.fit(docs.filter(~language.held_out()))
    return language.identify(docs, model).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_documents(spark, sf_dir))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .mtree import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _documents(spark, sf_dir)
    net = quality.fit(docs, _labels(spark, sf_dir), usable=~quality.held_out())
    return quality.score(docs, net).withColumn("held_out", quality.held_out()).selectExpr("doc_id", "held_out", "score", "cast(score >= 0.5 as int) AS predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import encoded

    out = encoded(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _documents(spark, sf_dir)
    net = toxicity.fit(docs, _labels(spark, sf_dir), usable=~toxicity.held_out())
    return toxicity.score(docs, net).withColumn("held_out", toxicity.held_out()).selectExpr("doc_id", "held_out", "score", "cast(score >= 0.5 as int) AS predicted", "worst_word")


def queries() -> dict:
    all_ = (op1_url_filter, op2_language, op3_simhash, op4_top_k, op5_quality, op6_bpe, op7_exact_dedup, op8_packing, op9_licenses, op10_toxicity)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, licenses, mtree, url_filter

    return {"op1_url_filter": url_filter.ORACLE, "op4_top_k": mtree.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op9_licenses": licenses.oracle()}
