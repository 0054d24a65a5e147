"""A corpus pipeline over documents: five stages, each on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. The first four return rows of docs, columns as they are;
the last one returns the packed pieces. Every row is judged for itself, also
where ids are null or repeat: of equal or similar texts one row stays, the
first of those with the smallest id (null ids come last). An empty table passes
as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import exact_dedup, language, packing, similar, toxicity
from nearfold.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that the network finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(docs, labels, usable=~toxicity.held_out())
    return toxicity.keep_clean(docs, net)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages learned, go."""
    return language.keep_identified(docs, language.fit(docs.filter(~language.held_out())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays, in one row."""
    return exact_dedup.drop_exact_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles the smallest id stays."""
    return similar.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_similar), ("packing", pack)]

#: Two stages are trained networks or models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
