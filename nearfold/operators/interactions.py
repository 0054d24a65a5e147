"""Interaction tables: joins to titles, dense ids, evaluation splits, filters and samples.

Rows have no order of their own in Spark; every operator that depends on one
takes the columns that give it. Rows with a null key are dropped where ids are
made, and NaN ratings count as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import sample_order
from ..functions.vectors import number
from ..plans.stages import dense_index, maybe_broadcast

RATING = 3.0


def factorize(df: DataFrame, key: str, order: list[str], name: str = "idx") -> DataFrame:
    """(key, idx): ids from 0 by first appearance; null keys get none."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_index(first, [F.col("_first")], name).drop("_first")


def title_join(df: DataFrame, meta: DataFrame, key: str = "parent_asin", title: str = "title") -> DataFrame:
    """Left join to the distinct (key, title); a key with two titles doubles its rows."""
    return df.join(meta.select(key, title).filter(F.col(key).isNotNull()).distinct(), key, "left")


def build_interactions(reviews: DataFrame, meta: DataFrame, order: tuple[str, ...] = ("row_id",), user: str = "user_id", item: str = "parent_asin") -> DataFrame:
    """(user_idx, product_idx, title, rating, timestamp)."""
    rows = reviews.filter(F.col(user).isNotNull() & F.col(item).isNotNull())
    users, items = factorize(rows, user, list(order), "user_idx"), factorize(rows, item, list(order), "product_idx")
    out = title_join(rows, meta, item).join(users, user).join(items, item)
    return out.select("user_idx", "product_idx", "title", number(F.col("rating")).alias("rating"), "timestamp")


def map_eval_splits(train: DataFrame, valid: DataFrame, test: DataFrame, meta: DataFrame, order: tuple[str, ...] = ("row_id",), meta_order: tuple[str, ...] = ("row_id",), user: str = "user_id", item: str = "parent_asin") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three splits with product ids from all metadata and user ids from training rows; unknown users and products go."""
    items = factorize(meta, item, list(meta_order), "product_idx")
    users = factorize(train, user, list(order), "user_idx")

    def mapped(df: DataFrame) -> DataFrame:
        out = title_join(df, meta, item).join(items, item).join(users, user)
        return out.select("user_idx", "product_idx", "title", number(F.col("rating")).alias("rating"), "timestamp")

    return mapped(train), mapped(valid), mapped(test)


def map_ids(df: DataFrame, ids: DataFrame, key: str, keep_missing: bool = False) -> DataFrame:
    """df with the id of its key; missing ones have null or go."""
    return df.join(maybe_broadcast(ids), key, "left" if keep_missing else "inner")


def positive(df: DataFrame, rating: str = "rating", least: float = RATING) -> DataFrame:
    """Rows rated at least so; null and NaN ratings are not."""
    return df.filter(number(F.col(rating)) >= least)


def with_ids(df: DataFrame, *ids: str) -> DataFrame:
    """Rows without a null among the ids."""
    return df.dropna(subset=list(ids))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(key, "_row.*")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, or all if there are fewer: those first in a seeded hash order of the key."""
    c = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return df.orderBy(sample_order(c, seed), *key).limit(n)


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n distinct keys."""
    return sample_rows(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], n, seed)


def prefix(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)


def id_space(train: DataFrame, others: list[DataFrame], user: str = "user_idx", item: str = "product_idx") -> DataFrame:
    """One row (n_users, n_items): users of training, items of all splits; largest id and one more."""
    items = reduce(DataFrame.unionByName, [d.select(item) for d in [train, *others]])
    n_users = train.agg((F.max(user) + 1).alias("n_users"))
    return n_users.join(items.agg((F.max(item) + 1).alias("n_items")))


def leave_last_out(df: DataFrame, user: str, latest: list[Column]) -> DataFrame:
    """df with split: a user's latest row is test, the one before valid, the rest train."""
    r = F.row_number().over(W.partitionBy(user).orderBy(*latest))
    return df.withColumn("_r", r).withColumn("split", F.when(F.col("_r") == 1, "test").when(F.col("_r") == 2, "valid").otherwise("train")).drop("_r")
