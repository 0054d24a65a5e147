"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves, fewer than the distance plus one:
of two fingerprints that differ in at most two bits, one half differs in at
most one bit. Each half is indexed under its 32 variants with one bit taken
out; equal variants meet in an equality join and the distance is verified
there. A pair is emitted by one variant only, so no distinct follows. Crowded
variants are indexed again by the same rule on the other half (two pieces of
16 bits), which bounds a bucket by 2**18 fingerprints whatever the input.
Copies are folded into their fingerprint before any pair is made.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other. A null id takes part, and never is a
component's id unless all its ids are null. Repeated rows have one component.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches

#: From so many fingerprints on, a half counts as crowded.
CROWDED = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):  # bounds the table of bits of a very long text
        part = words[at : at + 65_536 + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)))) if len(words) >= size else iter([b" ".join(words)])
        h = np.array([digest(s, 42) for s in shingles], dtype=np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n)
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long."""

    def run(cols: list[list]) -> list:
        out = [fingerprint(t, size) for t in cols[1]]
        return [cols[0], [x - (1 << 64) if x >> 63 else x for x in out]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, fp long")


def _half(fp: Column, high: Column) -> Column:
    return F.when(high, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))


def _place(x: Column, width: int) -> Column:
    """Where the pair with difference x (at most two bits of 2 * width) is emitted: the first part that differs
    in at most one bit, with that bit as the wildcard, or the part's lowest bit if it is equal."""
    mask = (1 << width) - 1
    low, high = x.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(x, width).bitwiseAND(F.lit(mask))
    at = lambda part: F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1))  # noqa: E731  a power of two: its exponent
    return F.when(F.bit_count(low) <= 1, at(low)).otherwise(at(high) + width).cast("int")


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v), u < v: pairs of distinct fingerprints at one or two differing bits, each once. fps: column fp, distinct."""
    p = F.col("p")
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    masked = lambda half: half.bitwiseAND(F.bitwise_not(_bit(p % 32)))
    rows = rows.select("fp", "p", masked(_half(F.col("fp"), p >= 32)).alias("key"))
    halves = fps.select(F.explode(F.array(*[F.struct(F.lit(bool(s)).alias("high"), _half(F.col("fp"), F.lit(bool(s))).alias("half")) for s in (0, 1)])).alias("h"))
    full = halves.groupBy("h.high", "h.half").count().filter(F.col("count") >= crowded)
    full = cut(full.select("high", "half"))
    if n := full.count():
        hot = full.select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b"), "high", "half")
        hot = hot.select((F.col("b") + F.when(F.col("high"), 32).otherwise(0)).alias("p"), F.col("half").bitwiseAND(F.bitwise_not(_bit(F.col("b")))).alias("key")).distinct().withColumn("hot", F.lit(True))
        rows = rows.join(F.broadcast(hot) if n <= 10_000 else hot, ["p", "key"], "left")
        other = _half(F.col("fp"), p < 32)
        piece = lambda q: F.when(q >= 16, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.bitwise_not(_bit(q % 16)))
        fine = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda q: F.struct(q.cast("int").alias("q"), piece(q).alias("sub")))
        plain = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).cast("long").alias("sub")))
        rows = rows.select("fp", "p", "key", F.explode(F.when(F.col("hot"), fine).otherwise(plain)).alias("x")).select("fp", "p", "key", "x.q", "x.sub")
    else:
        rows = rows.withColumns({"q": F.lit(-1), "sub": F.lit(0).cast("long")})
    a = rows.withColumnRenamed("fp", "u")
    b = rows.withColumnRenamed("fp", "v")
    x = F.col("u").bitwiseXOR(F.col("v"))
    place = _place(x, 32)
    rest = F.when(F.col("a.p") < 32, F.shiftrightunsigned(x, 32)).otherwise(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p", "key", "q", "sub")]
    on += [F.col("u") < F.col("v"), F.bit_count(x) <= 2, place == F.col("a.p"), (F.col("a.q") < 0) | (_place(rest, 16) == F.col("a.q"))]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.alias("a").join(b.alias("b"), cond).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of edges (u, v), u < v.

    Alternates the large-star and small-star steps until the edges stay the
    same. The least neighbours are written before they are joined, so that the
    join can split a node with very many edges. Only sums come to the driver.
    """

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select("u", "v").distinct())
    before = sums(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        large = cut(large)
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "k"))
        small = large.join(least, F.col("v") == F.col("k")).select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        e = cut(small.filter("u < v").distinct())
        after = sums(e)
        if after == before:
            break
        before = after
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(id, fingerprint, component_id), one row per row of docs."""
    fps = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = cut(components(links(nodes.select("fp"), crowded)))
    members = cut(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "least", "root"))
    ids = cut(members.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that the join can split a large root
    found = members.join(ids, "root").select(F.col("fp").alias("node"), "component_id")
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = fps.join(cut(named), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
