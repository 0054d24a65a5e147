"""Shared helpers: checkpointing, hash folds, bounded samples and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Up to so many keys, of a number each, a side is broadcast.
MOST_SENT = 1_000_000
#: Rows of a batch that are Python objects at a time.
SLICE = 2000
#: Bytes of an Arrow batch, on both sides, where the session has Spark's default of 64 MB.
BATCH_BYTES, DEFAULT_BATCH = 8 << 20, "67108864b"
#: A worker without a task for so many seconds drops what it holds.
IDLE_S = 1.0


def checkpoint_folder(sc: SparkContext) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset on one machine a temporary one is made."""
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return folder or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def sent(keys: DataFrame) -> DataFrame:
    """keys, a table of a number or two each row, written and counted: marked for broadcast up to MOST_SENT rows."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= MOST_SENT else keys


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))
    give_back()


def give_back() -> None:
    """Memory that was freed goes back to the system: idle workers count beside the JVM they belong to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


_held: dict[str, Callable[[], None]] = {}


def hold(name: str, drop: Callable[[], None]) -> None:
    """A worker holds something large under this name from task to task, and how to drop it."""
    _held[name] = drop


def drop_held(but: str | None) -> None:
    for name, drop in _held.items():
        if name != but:
            drop()
    give_back()


_turn = threading.Lock()
_tasks, _timer = 0, threading.Timer(IDLE_S, give_back)


@contextlib.contextmanager
def in_task(held: str | None) -> Iterator[None]:
    """While a worker runs a task that uses what is held under this name.

    Workers are used again: what tasks of another kind left is dropped before.
    A worker that gets no other task soon drops all of it, and what the task
    itself left behind: it may stay idle while others need the memory.
    """
    global _tasks, _timer
    _timer.cancel()
    with _turn:
        _tasks += 1
        drop_held(held)
    try:
        yield
    finally:
        _timer.cancel()
        _timer = threading.Timer(IDLE_S, _rest, [_tasks])
        _timer.daemon = True
        _timer.start()


def _rest(last: int) -> None:
    with _turn:
        if last == _tasks:  # no task began since
            gc.collect()
            drop_held(None)


def map_batches(df: DataFrame, fn: Callable[[list[list]], list], schema: str, held: str | None = None) -> DataFrame:
    """Run fn on the columns of each Arrow batch, as lists; it returns columns.

    Batches are bounded by Spark's Arrow limits on rows and bytes and looked at
    SLICE rows at a time, so a task never holds more than one batch of texts.
    held: the name of what fn holds from task to task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark_schema = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        with in_task(held):
            for b in sliced(batches):
                cols = fn([c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return _bounded(df).mapInArrow(run, spark_schema)


def _bounded(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded in bytes: rows can be long texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, DEFAULT_BATCH) == DEFAULT_BATCH:
        conf.set(key, str(BATCH_BYTES))
    return df


def arrow_lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of signed 64-bit numbers as one Arrow array of lists."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def kept_batches(docs: DataFrame, col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs for which keep, given the values of col in an Arrow batch, says True; all columns as they are."""
    at = docs.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(None):
            for b in sliced(batches):
                yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return _bounded(docs).mapInArrow(run, docs.schema)


def one_text_each(found: DataFrame) -> DataFrame:
    """Of rows (id, text, ...) with one id the text of the smallest hash, so that ids bound the rows."""
    others = [F.first(c).alias(c) for c in found.columns if c not in ("id", "text")]
    return found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *others)


def bounded_rows(df: DataFrame, key: str, group: str, rows: int, text_col: str) -> DataFrame:
    """(id, text, group) of at most `rows` rows of each group, those of the smallest hash of the key.

    Only keys are ranked, and each task sends at most `rows` of a group on; the
    texts are fetched by a join with those keys. Of several texts with a key and
    a group one is taken.
    """
    keys = df.select(F.col(key).alias("k"), F.col(group).alias("g")).filter("k IS NOT NULL AND g IS NOT NULL").distinct()
    order = W.partitionBy("g").orderBy(F.xxhash64(F.col("k").cast("string")), "k")
    kept = sent(keys.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= rows).select("k", "g"))
    found = df.join(kept, (df[key] == kept["k"]) & (df[group] == kept["g"]))
    return found.groupBy("k", "g").agg(F.min_by(text_col, F.xxhash64(text_col)).alias("text")).select(F.col("k").alias("id"), "text", F.col("g").alias("group"))


def chunks_of(texts: list, limit: int = 8_000_000) -> Iterator[tuple[int, int]]:
    """Cut a list of strings (or None) into ranges of about `limit` characters; a longer text stands alone."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most `rows` documents of each label, 0 and 1: those with the smallest hash of the id.

    usable: which rows of labels may be learned from. Of several labels of one
    document the largest counts, of several documents with one id one is taken.
    At most 2 * rows labels come to the driver.
    """
    own = labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    kept = [tuple(r) for y in (0, 1) for r in own.filter(F.col("y") == y).orderBy(*order).limit(rows).collect()]
    kept = docs.sparkSession.createDataFrame(kept, f"_id {labels.schema[id_col].dataType.simpleString()}, y int")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return one_text_each(found.join(F.broadcast(kept), F.col("id") == F.col("_id")).select("id", "text", "y"))


def train_in_one_task(examples: DataFrame, train: Callable[[Iterator[list[list]]], bytes]) -> bytes:
    """Run train in one task on an executor over the batches of examples, a bounded table; the model comes back as bytes.

    A batch is a list of columns; train sees one at a time, in the order of the first column.
    """
    numbered = examples.repartition(1).sortWithinPartitions(*examples.columns[:1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(None):
            model = train([c.to_pylist() for c in b.columns] for b in sliced(batches, 256))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = _bounded(numbered).mapInArrow(run, "model binary").collect()
    return bytes(got[0][0]) if got else train(iter(()))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a number for each row, and the name of that column. Decisions about rows are
    taken back to them by it, as ids may repeat or be null."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def without(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows of numbered() whose number isn't in gone (one column), with their own columns as they were.

    The numbers are broadcast up to MOST_SENT of them; beyond, the rows are shuffled.
    """
    side = sent(gone.toDF("_gone_" + name))
    return rows.join(side, F.col(name) == F.col("_gone_" + name), "left_anti").drop(name)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read again: for tables of texts, which it keeps compressed and by column."""
    sc = df.sparkSession.sparkContext
    path = f"{checkpoint_folder(sc)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
