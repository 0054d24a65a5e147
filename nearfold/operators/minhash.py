"""MinHash signatures, banded index, candidates and estimates; the index as a table that can be kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import PRIME, hash_seeds
from ..plans.stages import settled, topk

HASHES, BANDS = 128, 64
#: Rows of bands that are shuffled at a time, and bytes of signatures that go along with pairs at a time.
BAND_ROWS, PAIR_BYTES = 20_000_000, 512 << 20


def signatures(pairs: DataFrame, num_hashes: int = HASHES, seed: int = 42, element: str = "user") -> DataFrame:
    """(item, sig): least hash of the item's elements for each of the hash functions.

    Pairs are shuffled by item, a few bytes each, and one aggregate has a
    minimum for each function; minima made before the shuffle would be a whole
    signature for nearly every pair. No set is ever held. Items without an
    element don't appear.
    """
    x = F.col(element).cast("long") % PRIME
    mins = [F.min((F.lit(a) * x + F.lit(b)) % F.lit(PRIME)).alias(f"m{k}") for k, (a, b) in enumerate(hash_seeds(num_hashes, seed))]
    least = pairs.dropna(subset=["item", element]).repartition("item").groupBy("item").agg(*mins)
    return least.select("item", F.array(*[F.col(f"m{k}") for k in range(num_hashes)]).alias("sig"))


def band_keys(sig: Column, num_bands: int = BANDS, rows: int | None = None) -> Column:
    """The key of each band: its rows as they are, so buckets never merge by chance."""
    size = F.size(sig) if rows is None else F.lit(rows * num_bands)
    r = (size / num_bands).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(num_bands - 1)), lambda i: F.array_join(F.slice(sig, i * r + 1, r).cast("array<string>"), "-"))


def bands(sigs: DataFrame, num_bands: int = BANDS, rows: int | None = None) -> DataFrame:
    """(band, key, item), a row for each item and band."""
    return sigs.select("item", F.posexplode(band_keys(F.col("sig"), num_bands, rows)).alias("band", "key")).select("band", "key", "item")


def candidates(index: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Distinct (item, other) that share a bucket; queries: column item. An unknown id has none.

    Every pair is a row of the result here; similar_topk() is the form that
    never makes them for items alike.
    """
    left = index if queries is None else index.join(queries.select("item").distinct(), "item", "left_semi")
    a, b = left.alias("a"), index.select("band", "key", F.col("item").alias("other")).alias("b")
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
    if queries is not None:
        return a.join(b, on & (F.col("a.item") != F.col("other"))).select("item", "other").distinct()
    once = a.join(b, on & (F.col("a.item") < F.col("other"))).select("item", "other").distinct()
    return once.unionAll(once.select(F.col("other").alias("item"), F.col("item").alias("other")))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def lsh_topk(index: DataFrame, sigs: DataFrame, k: int = 5, queries: DataFrame | None = None) -> DataFrame:
    """(item, other, score, rank): candidates by estimate; ties go to the smaller id."""
    c = candidates(index, queries)
    c = c.join(sigs, "item").withColumnRenamed("sig", "sa").join(sigs.select(F.col("item").alias("other"), F.col("sig").alias("sb")), "other")
    return topk(c.select("item", "other", estimate(F.col("sa"), F.col("sb")).alias("score")), ["item"], [F.desc("score"), F.col("other")], k)


def _shared(sigs: DataFrame, num_bands: int, rows: int, band_rows: int) -> list[DataFrame]:
    """Tables (band, key, item) of the buckets with more than one item, made for a few bands at a time.

    Up to two rows a band the key is the rows as they are, beyond a hash of them.
    """
    def key(b: int) -> Column:
        part = [F.col("sig")[b * rows + k].cast("long") for k in range(rows)]
        return part[0] if rows == 1 else part[0] * (1 << 31) + part[1] if rows == 2 else F.xxhash64(*part)

    at_once, out = max(1, band_rows // max(1, sigs.count())), []
    for at in range(0, num_bands, at_once):
        keys = F.array(*[F.struct(F.lit(b).alias("band"), key(b).alias("key")) for b in range(at, min(at + at_once, num_bands))])
        some = sigs.select("item", F.explode(keys).alias("_x")).select("_x.band", "_x.key", "item")
        some = some.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("band", "key")))
        out.append(settled(some.filter("_n > 1").drop("_n")))
    return out


def scored_pairs(sigs: DataFrame, num_bands: int = BANDS, rows: int | None = None, band_rows: int = BAND_ROWS, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """(a, b, score), a < b: each pair that shares a bucket once, with its estimate. sigs: written.

    Only items that share a bucket are joined, as numbers; signatures then go
    along with a part of the pairs at a time, so disk holds pair_bytes of them.
    """
    size = (sigs.select(F.size("sig")).first() or [num_bands])[0]
    rows = rows or size // num_bands
    met = reduce(DataFrame.unionAll, _shared(sigs, num_bands, rows, band_rows))
    one, other = met.withColumnRenamed("item", "a"), met.withColumnRenamed("item", "b")
    pairs = settled(one.join(other, ["band", "key"]).filter("a < b").select("a", "b").distinct())
    parts, out = max(1, -(-pairs.count() * size * 4 // max(1, pair_bytes))), []
    same = lambda i: F.slice("sa", i * rows + 1, rows) == F.slice("sb", i * rows + 1, rows)
    for n in range(parts):
        some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == n) if parts > 1 else pairs
        some = some.join(sigs.select(F.col("item").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("item").alias("b"), F.col("sig").alias("sb")), "b")
        if rows > 2:  # two keys may be equal by chance
            some = some.filter(F.exists(F.sequence(F.lit(0), F.lit(num_bands - 1)), same))
        out.append(settled(some.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("score"))))
    return reduce(DataFrame.unionAll, out)


def similar_topk(sigs: DataFrame, k: int = 5, num_bands: int = BANDS, rows: int | None = None, band_rows: int = BAND_ROWS, pair_bytes: int = PAIR_BYTES) -> DataFrame:
    """lsh_topk() of all items, from their signatures, with equal signatures folded.

    Items with one signature are one group, named by its smallest id: only
    groups are banded, meet and are compared, so ten thousand items of one and
    the same user cost what one of them does. Signatures count as equal if two
    64-bit hashes of them are. A group needs its k best groups, by score and
    smallest id, and of each the k smallest ids: a place in an item's first k
    is never given to another group or member. Its own members score 1, k + 1
    of them leave k beside the item itself.
    """
    sigs = settled(sigs.select("item", F.col("sig").cast("array<int>").alias("sig")))
    hashed = sigs.select("item", F.xxhash64("sig").alias("_h"), F.xxhash64(F.lit(1), "sig").alias("_i"))
    alike = settled(hashed.join(hashed.groupBy("_h", "_i").agg(F.min("item").alias("_first")), ["_h", "_i"]).select("item", "_first"))
    first = settled(topk(alike, ["_first"], [F.col("item")], k + 1, "_place"))
    copies = alike.filter("item <> _first")
    groups = sigs if copies.isEmpty() else settled(sigs.join(copies, "item", "left_anti"))
    pairs = scored_pairs(groups, num_bands, rows, band_rows, pair_bytes)
    best = pairs.select(F.col("a").alias("_first"), F.col("b").alias("_group"), "score").unionAll(pairs.select("b", "a", "score"))
    best = topk(best, ["_first"], [F.desc("score"), F.col("_group")], k).drop("rank")
    near = best.join(first.filter(F.col("_place") <= k).select(F.col("_first").alias("_group"), F.col("item").alias("other")), "_group")
    near = topk(near.select("_first", "other", "score"), ["_first"], [F.desc("score"), F.col("other")], k, "_place").drop("_place")
    near = near.unionByName(first.select("_first", F.col("item").alias("other"), F.lit(1.0).alias("score")))
    lists = near.groupBy("_first").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "other"))).alias("_near"))  # at most 2 k + 1
    out = alike.select("item", "_first").join(lists, "_first")
    mine = F.slice(F.filter("_near", lambda x: x["other"] != F.col("item")), 1, k)
    out = out.select("item", F.posexplode(mine).alias("_at", "_x"))
    return out.select("item", F.col("_x.other").alias("other"), (-F.col("_x.low")).alias("score"), (F.col("_at") + 1).alias("rank"))


def bucket_sizes(index: DataFrame) -> DataFrame:
    """(size, buckets): how many buckets have how many items."""
    sizes = index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("buckets")).orderBy("size")


def save_index(path: str, sigs: DataFrame, index: DataFrame, titles: DataFrame) -> None:
    """Three tables under path; buckets partitioned by band, so that a query reads what it needs."""
    sigs.write.mode("overwrite").parquet(f"{path}/signatures")
    index.write.mode("overwrite").partitionBy("band").parquet(f"{path}/bands")
    titles.write.mode("overwrite").parquet(f"{path}/titles")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("signatures", "bands", "titles"))


def query_index(spark: SparkSession, path: str, item: int, k: int = 5, num_bands: int = BANDS, rows: int | None = None) -> DataFrame:
    """(item, other, score, rank) of one item over a saved index, which isn't built again.

    The one signature gives a key for each band; those rows are sent to the
    buckets, and only the signatures of what they meet are read on. An id
    without a signature stands for the smallest one; an empty index has no
    neighbours.
    """
    sigs, index, _ = load_index(spark, path)
    one = sigs.join(F.broadcast(query_or_first(sigs, item)), "item")  # one row
    keys = one.select(F.col("item").alias("_item"), F.col("sig").alias("_sig"), F.posexplode(band_keys(F.col("sig"), num_bands, rows)).alias("band", "key"))
    met = index.join(F.broadcast(keys), ["band", "key"]).filter("item <> _item").select(F.col("_item").alias("item"), F.col("item").alias("other"), "_sig")
    met = met.groupBy("item", "other").agg(F.first("_sig").alias("_sig")).join(sigs.select(F.col("item").alias("other"), "sig"), "other")
    return topk(met.select("item", "other", estimate(F.col("_sig"), F.col("sig")).alias("score")), ["item"], [F.desc("score"), F.col("other")], k)


def query_or_first(sigs: DataFrame, item: int) -> DataFrame:
    """One row (item): the id if it has a signature, else the smallest id."""
    return sigs.agg(F.coalesce(F.max(F.when(F.col("item") == item, F.col("item"))), F.min("item")).alias("item"))
