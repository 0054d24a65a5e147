"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is a run of successive UTF-8 bytes, wider at each level. Documents are
split by their next digit until a group is a single document or its texts have
ended. Texts are equal because all their bytes were, no digest takes part. Only
texts whose digit others may share are moved: hashes of the shared digits are
sent to the rows first, and a row whose hash isn't among them is alone.

Defined results: null texts count as empty, and empty texts are equal to each
other. A null id sorts last; a group of null ids only has a null keep_id. Rows
that repeat the kept id with an equal text are the kept document too in
exact_groups; drop_exact_copies keeps one row of them. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, without

#: Bytes of the first digit, how much wider the next one is, and the widest.
FIRST, WIDER, WIDEST = 64, 8, 1 << 20
#: Hashes of shared digits are broadcast up to so many, of 8 bytes each.
MOST_HASHES = 2_000_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _shared(state: DataFrame) -> tuple[DataFrame, int]:
    """Groups of two or more rows with the same next digit, with a new number each."""
    found = state.groupBy("part", "digit").agg(F.count(F.lit(1)).alias("size"), F.min("who").alias("keep"))
    found = cut(found.filter("size > 1").withColumn("next", F.monotonically_increasing_id()))
    return found, found.count()


def _first_digit(text: Column, width: int) -> Column:
    """The first `width` bytes of the normalised text, from its beginning alone where that is enough."""
    begin, whole = normalised(F.substring(text, 1, 8 * width)), normalised(text)
    return F.substring(F.encode(F.when(F.char_length(begin) > width, begin).otherwise(whole), "utf-8"), 1, width)


def _groups(docs: DataFrame, who: Column, text_col: str, first: int, most_hashes: int) -> DataFrame:
    """(who, keep, size, sha), one row per row of docs; keep is the least `who` among equal texts."""
    alone = ["who", F.col("who").alias("keep"), F.lit(1).cast("long").alias("size"), "sha"]
    done: list[DataFrame] = []
    width, top = first, F.lit(0).cast("long").alias("part")
    shared, n = _shared(docs.select(who.alias("who"), top, _first_digit(F.col(text_col), first).alias("digit")))
    text = F.encode("text", "utf-8")
    base = docs.select(who.alias("who"), normalised(F.col(text_col)).alias("text"))
    state = base.select("who", F.sha2("text", 256).alias("sha"), top, text.alias("rest"))
    if n <= most_hashes:
        hashes = F.broadcast(shared.select(F.xxhash64("digit").alias("hash"), F.lit(True).alias("met")).distinct())
        state = state.join(hashes, F.xxhash64(F.substring("rest", 1, first)) == F.col("hash"), "left")
        state = cut(state.select("who", "sha", F.when(F.col("met"), F.col("part")).alias("part"), F.when(F.col("met"), F.col("rest")).alias("rest")))
        done.append(state.filter("part IS NULL").select(*alone))
        state = state.filter("part IS NOT NULL")
        width, shared = first * WIDER, None
    while True:
        state = state.withColumn("digit", F.substring("rest", 1, width))
        if shared is None:
            shared, n = _shared(state.select("who", "part", "digit"))
        if n == 0:
            done.append(state.select(*alone))
            break
        joined = state.join(shared, ["part", "digit"], "left")
        ended = F.length("digit") < width
        joined = joined.select(
            "who", "sha", "size", "keep", F.col("next").alias("part"),
            F.when(F.col("next").isNotNull() & ~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        )
        joined = cut(joined)
        single = F.col("part").isNull()
        done.append(
            joined.filter("rest IS NULL").select(
                "who", F.when(single, F.col("who")).otherwise(F.col("keep")).alias("keep"),
                F.coalesce("size", F.lit(1)).cast("long").alias("size"), "sha",
            )
        )
        state = joined.filter("rest IS NOT NULL").select("who", "sha", "part", "rest")
        width, shared = min(width * WIDER, WIDEST), None
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, most_hashes: int = MOST_HASHES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of docs."""
    return _groups(docs, F.col(id_col), text_col, first, most_hashes).select(
        F.col("who").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("who").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row of docs for each text, the first of those with the smallest id, with its columns as they are."""
    rows, name = numbered(docs)
    who = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(name).alias("row"))
    found = _groups(rows, who, text_col, first, most_hashes)
    return without(rows, name, found.filter(F.col("who") != F.col("keep")).select("who.row"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""
