"""Text reports and files from result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import maybe_broadcast


def with_titles(recs: DataFrame, titles: DataFrame, unknown: str | None = "Unknown Title") -> DataFrame:
    """recs (item, other, ...) with item_title and other_title; only a missing key is unknown, a null title stays null."""
    t = titles.select("item", "title").withColumn("_known", F.lit(True))
    t = maybe_broadcast(t)
    label = lambda: F.when(F.col("_known"), F.col("title")).otherwise(F.lit(unknown) if unknown is not None else F.col("_id").cast("string"))
    out = recs.join(t, "item", "left").withColumn("_id", F.col("item")).withColumn("item_title", label()).drop("title", "_known", "_id")
    t2 = t.withColumnRenamed("item", "other")
    return out.join(t2, "other", "left").withColumn("_id", F.col("other")).withColumn("other_title", label()).drop("title", "_known", "_id")


def neighbour_lines(recs: DataFrame, queries: DataFrame, digits: int = 4, empty: str = "(No candidates found)") -> DataFrame:
    """(item, line_no, line): a heading for each query, a line for each neighbour, or one that says there is none."""
    head = queries.select("item", F.lit(0).alias("line_no"), F.format_string("Query %d", F.col("item").cast("long")).alias("line"))
    body = recs.select("item", F.col("rank").alias("line_no"), F.format_string(f"  %2d. %d  score=%.{digits}f", F.col("rank").cast("int"), F.col("other").cast("long"), F.round(F.col("score").cast("double"), digits)).alias("line"))
    none = queries.select("item").join(recs.select("item").distinct(), "item", "left_anti").select("item", F.lit(1).alias("line_no"), F.lit(f"  {empty}").alias("line"))
    return head.unionByName(body).unionByName(none).orderBy("item", "line_no")


def cluster_lines(terms: DataFrame, samples: DataFrame) -> DataFrame:
    """(cluster, line_no, line): a cluster's terms on one line, then its titles."""
    top = terms.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("_t"))
    head = top.select("cluster", F.lit(0).alias("line_no"), F.format_string("Cluster %d: %s", F.col("cluster").cast("long"), F.col("_t")).alias("line"))
    body = samples.select("cluster", F.col("rank").alias("line_no"), F.concat(F.lit("  - "), F.col("title")).alias("line"))
    return head.unionByName(body).orderBy("cluster", "line_no")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of a report, in their order, as text."""
    lines.orderBy(*lines.columns[:2]).select("line").coalesce(1).write.mode("overwrite").text(path)


def write_elbow(table: DataFrame, path: str) -> None:
    """k,inertia with a header."""
    table.orderBy("k").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
