"""MinHash signatures over a stream of interactions.

An extension: the least hash of a set can be merged, so a signature is kept up
to date by a streaming aggregate, or by merging each micro-batch into a stored
table of which only touched items are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import minhash


def streaming_signatures(pairs: DataFrame, num_hashes: int = minhash.HASHES, seed: int = 42) -> DataFrame:
    """(item, sig) over a streaming DataFrame (item, user); write it in update or complete mode."""
    return minhash.signatures(pairs, num_hashes, seed)


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(item, sig) of both tables; an item in both has the lesser hash at each place."""
    old = stored.select("item", F.col("sig").alias("_old"))
    both = F.zip_with("_old", "sig", lambda a, b: F.least(a, b))
    return old.join(fresh, "item", "full").select("item", F.coalesce(both, "_old", "sig").alias("sig"))


def keep_signatures(pairs: DataFrame, path: str, checkpoint: str, num_hashes: int = minhash.HASHES, seed: int = 42) -> StreamingQuery:
    """Start a query that keeps versions of the signature table under path, one a micro-batch: `v=<batch>`.

    A batch that runs again after a failure writes its version again from the
    one before, so the outcome is the same.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        fresh = minhash.signatures(batch, num_hashes, seed)
        if number:
            fresh = merge(batch.sparkSession.read.parquet(f"{path}/v={number - 1}"), fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/v={number}")

    return pairs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
