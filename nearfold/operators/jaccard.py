"""Exact set similarity over item and user pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import maybe_broadcast, settled, topk

#: Meetings of two items of a user that are shuffled at a time.
MEETINGS = 30_000_000


def item_user_pairs(df: DataFrame, item: str = "product_idx", user: str = "user_idx") -> DataFrame:
    """Distinct (item, user); the exploded form of each item's user set."""
    return df.select(F.col(item).alias("item"), F.col(user).alias("user")).dropna().distinct()


def sets_of(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members): sorted distinct members of each key; null keys and members have none."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(member)).alias("members"))


def lists_of(df: DataFrame, key: str, member: str) -> DataFrame:
    """(key, members): members with repetitions, sorted."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("members"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _sized(pairs: DataFrame) -> DataFrame:
    """pairs with n, how many users the item has; dealt and sorted by user, which the checkpoint keeps, so that meetings shuffle nothing."""
    sized = pairs.join(pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "item")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(sized.repartition(parts, "user").sortWithinPartitions("user"))


def _meet(left: DataFrame, right: DataFrame, apart: Column) -> DataFrame:
    """(item, other, score) of the items of both sides that have a user in common."""
    a, b = left.withColumnRenamed("n", "na").alias("a"), right.select(F.col("item").alias("other"), "user", F.col("n").alias("nb")).alias("b")
    met = a.join(b, (F.col("a.user") == F.col("b.user")) & apart)
    common = met.groupBy("item", "other").agg(F.count(F.lit(1)).alias("k"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return common.select("item", "other", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("score"))


def similar_pairs(pairs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(item, other, score) of all pairs with a common user; queries: column item.

    Pairs meet by user, so a user's items pair up with each other: this is the
    exact form, for truth. MinHash is the form for large inputs. Set sizes go
    along with the pairs, so nothing is joined to what the meeting makes.
    Without queries each pair is counted once and then mirrored.
    """
    sized = _sized(pairs)
    left = sized if queries is None else sized.join(maybe_broadcast(queries.select("item").distinct()), "item", "left_semi")
    out = _meet(left, sized, F.col("a.item") < F.col("b.other") if queries is None else F.col("a.item") != F.col("b.other"))
    if queries is None:
        both = F.explode(F.array(F.struct("item", "other"), F.struct(F.col("other").alias("item"), F.col("item").alias("other"))))
        out = out.select(both.alias("p"), "score").select("p.item", "p.other", "score")
    return out


def _lists(pairs: DataFrame) -> DataFrame:
    """(items, sizes): a row for each user, with how many users each of the items has."""
    sized = pairs.join(pairs.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n")), "item")
    both = sized.groupBy("user").agg(F.collect_list(F.struct("item", "n")).alias("own"))  # one list, so that the two agree
    return settled(both.select(F.col("own.item").alias("items"), F.col("own.n").alias("sizes")))


def _meet_lists(lists: DataFrame, parts: int, n: int) -> DataFrame:
    """(item, other, score) of the items of part n of so many and those they have a user in common with.

    A user's list goes to each of its items, some 12 bytes a meeting; items
    meet and are counted where they are sent, behind that one shuffle.
    """
    own = lists.select("items", "sizes", F.posexplode("items").alias("at", "item")).filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == n)
    own = own.select("item", F.col("sizes")[F.col("at")].alias("na"), "items", "sizes").repartition("item")
    met = own.select("item", "na", "sizes", F.posexplode("items").alias("at", "other")).filter(F.col("item") != F.col("other"))
    met = met.select("item", "other", "na", F.col("sizes")[F.col("at")].alias("nb"))
    common = met.groupBy("item", "other").agg(F.count(F.lit(1)).alias("k"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return common.select("item", "other", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("score"))


def exact_jaccard_topk(pairs: DataFrame, k: int = 5, queries: DataFrame | None = None, digits: int = 6, meetings: int = MEETINGS) -> DataFrame:
    """(item, other, score, rank); ties go to the smaller id. Ranks follow the unrounded scores.

    Where a user's items meet each other more than `meetings` times in all, a
    part of the items is ranked at a time, so disk holds about so many pairs.
    """
    parts = 1
    if queries is None:
        pairs = settled(pairs)
        met = pairs.groupBy("user").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        parts = max(1, -int(-(met or 0) // max(1, meetings)))
    if parts == 1:
        ranked = topk(similar_pairs(pairs, queries), ["item"], [F.desc("score"), F.col("other")], k)
    else:
        lists, out = _lists(pairs), []
        for n in range(parts):
            out.append(settled(topk(_meet_lists(lists, parts, n), ["item"], [F.desc("score"), F.col("other")], k)))
        ranked = reduce(DataFrame.unionAll, out)
    return ranked.withColumn("score", F.round("score", digits))
