"""Plan helpers: materialising between stages, top-k with a declared tie-break, and dense ranks without one big task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window as W

#: Bytes up to which a side is broadcast, beside the rows that an operator allows.
SENT_BYTES = 64 << 20


def stable(df: DataFrame) -> DataFrame:
    """df computed once: in the cluster's checkpoint folder, or persisted where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def settled(df: DataFrame) -> DataFrame:
    """stable(), after which the shuffle files that df was made of are deleted. df itself is not used again.

    Without it they stay until the driver's garbage is collected, so that steps
    which need little disk each add up. A df that is a checkpoint stays as it is.
    """
    if _checkpoint_path(df):
        return df
    sc = df.sparkSession.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        out = df.persist()
    else:
        out = df.checkpoint()
        df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    if _made:
        _made[-1].append(out)
    return out


def _checkpoint_path(df: DataFrame) -> str | None:
    """Where the rows of a checkpointed df are."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return None
    path = plan.rdd().getCheckpointFile()
    return path.get() if path.isDefined() else None


_made: list[list[DataFrame]] = []


def settled_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """settled(make()), after which the tables that make() settled on its way are deleted. They are not used again."""
    _made.append([])
    try:
        df = make()
    finally:
        made = _made.pop()
    out, sc = settled(df), df.sparkSession.sparkContext
    for path in {_checkpoint_path(t) for t in made} - {None, _checkpoint_path(out)}:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    return out


@contextmanager
def kept_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it is deleted at the end.

    Only a session on one machine that has set none gets a temporary one.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def computed(df: DataFrame) -> DataFrame:
    """df as stable() gives it, computed now: what it was read from may go."""
    df = stable(df)
    df.count()
    return df


def topk(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order. Catalyst limits each partition before the shuffle."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, r).filter(F.col(rank) <= k)


def dense_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """df with numbers from 0 in the given order.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the sizes of the partitions before, of which only as many
    numbers come to the driver as there are partitions.
    """
    part, place = "_part", "_place"
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranked = stable(df.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(place, low))
    sizes = {r[part]: r["n"] for r in ranked.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, before = [], 0
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    offsets = df.sparkSession.createDataFrame(rows, f"{part} int, _before long")
    return ranked.join(F.broadcast(offsets), part).withColumn(name, F.col(place) + F.col("_before")).drop(part, place, "_before")


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    size: Column = F.lit(0)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, ArrayType):
            text = isinstance(f.dataType.elementType, StringType)
            size += F.when(c.isNull(), 0).otherwise(8 * F.size(c) + (F.octet_length(F.array_join(c, "")) if text else F.lit(0)))
        size += F.lit(8)
    return size


def small_enough(df: DataFrame, rows: int, most_bytes: int = SENT_BYTES) -> bool:
    """Whether df has at most that many rows and bytes; counts no further than that many rows."""
    n, size = df.limit(rows + 1).select(_bytes(df).cast("long").alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return n <= rows and (size or 0) <= most_bytes


def maybe_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, of at most SENT_BYTES, else as it is, for a join by shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df
