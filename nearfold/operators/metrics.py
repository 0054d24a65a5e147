"""Counts and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n) in order of value; null isn't counted."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(value)


def totals(df: DataFrame, distinct: str) -> DataFrame:
    """One row (n_rows, n_distinct)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(distinct).alias("n_distinct"))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def recall_at_k(approx: DataFrame, truth: DataFrame, query: str = "item", other: str = "other") -> DataFrame:
    """One row (recall): the mean over queries with a true neighbour of the share that was found."""
    hit = approx.select(query, other).distinct().withColumn("_hit", F.lit(1))
    per = truth.select(query, other).distinct().join(hit, [query, other], "left").groupBy(query).agg((F.count("_hit") / F.count(F.lit(1))).alias("_r"))
    return per.agg(mean_or_zero(F.col("_r")).alias("recall"))


def user_recall_at_k(recs: DataFrame, actual: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """One row (recall): distinct hits by listed items (which count as often as they are listed), mean over users."""
    hit = recs.select(user, item).distinct().withColumn("_hit", F.col(item))
    per = actual.select(user, item).join(hit, [user, item], "left").groupBy(user).agg((F.countDistinct("_hit") / F.count(F.lit(1))).alias("_r"))
    return per.agg(mean_or_zero(F.col("_r")).alias("recall"))


def comparison(ours: dict[str, float], other: dict[str, float], spark, lower_is_better: set[str]) -> DataFrame:
    """(metric, ours, other, winner)."""
    rows = []
    for m in ours:
        a, b = ours[m], other[m]
        rows.append((m, float(a), float(b), "tie" if a == b else "ours" if (a < b) == (m in lower_is_better) else "other"))
    return spark.createDataFrame(rows, "metric string, ours double, other double, winner string")
