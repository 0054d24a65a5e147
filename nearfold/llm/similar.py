"""Near copies by exact Jaccard similarity of word shingles, found by deletion-variant signatures.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. At 0.8 about a sixth of a SimHash's bits differ, so
no segment of it that tells texts apart would differ in one bit at most. The
same method runs over another signature: SEGMENTS segments of WIDTH symbols, each the
minimum of the shingles under a hash. Of a pair at 0.8 a symbol differs with
probability 0.2 and a segment in at most one symbol with 0.737, so each
segment is indexed under its WIDTH variants with one symbol left out, equal
variants meet in an equality join, and whole sets are verified. A pair at
exactly 0.8 shares no variant with probability 0.263**8 < 3e-5.

All pairs are made of variants that at most SMALL texts share. Larger ones are
held against PIVOTS of their texts, in rows as many as they have texts; what
is not connected then is joined again on its rarest shingles (of two sets at
0.8 or more, those without the most common 80 % share one), so a passage that
very many texts share makes no pairs of all of them. There, too, the texts of a
shingle are held against PIVOTS of them first, and only shingles whose texts are
not in one component by then make all their pairs, each at the first shingle
that both texts have. Pairs whose sizes or symbols can't reach 0.8 are dropped
before whole sets are fetched, and so are, of those that share rare shingles,
pairs whose parities differ too much.

Defined results: a text of fewer than five words is one shingle; null, empty
and wordless texts are alike. Words are split and put in lower case as in
simhash. A null id takes part, and never is a component's id unless all its
ids are null. Repeated rows and ids have one component each row; of a
component keep_one_of_each keeps the first row with the smallest id. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import _bounded, arrow_lists, cut, in_task, map_batches, numbered, sent, without, written
from .simhash import _LOWER, components, fingerprints, links

SIZE = 5
SEGMENTS, WIDTH = 8, 5
SMALL, PIVOTS, NEAREST = 12, 3, 2
#: Six bits of each symbol are compared first; more than so many differing bits of all are 4.8 standard deviations from 0.8.
SYMBOL_BITS, FAR = 6, 64
#: Parities are kept of so many buckets of shingles.
BUCKETS = 512
#: A row of the join on rare shingles has so many of its text's, to tell whether a pair has met on another one.
RAREST = 16
#: Up to so many links are connected in one task, more of them by rounds of joins.
ONE_TASK = 250_000

_draw = np.random.default_rng(42)
_A, _B = (_draw.integers(1, 2**63, SEGMENTS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_MIX = _draw.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    n, width = max(1, len(words) - size + 1), min(size, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k : k + n] * _MIX[k])
    return np.unique(out)


def symbols(found: np.ndarray) -> np.ndarray:
    """SEGMENTS x WIDTH: the minimums of a text's shingles."""
    least = np.full(SEGMENTS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):  # bounds the table of a very long text
        table = found[at : at + 4096] * _A[:, None] + _B[:, None]
        np.minimum(least, table.min(axis=1), out=least)
    return least.reshape(SEGMENTS, WIDTH)


def variants(least: np.ndarray) -> np.ndarray:
    """For each of n signatures (n x SEGMENTS x WIDTH) the signed keys of its segments' one-wildcard variants."""
    out = np.empty(least.shape, np.uint64)
    for left_out in range(WIDTH):
        key = np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out)
        for k in range(WIDTH):
            if k != left_out:
                key = _mixed(key + least[..., k] * _MIX[8 + k])
        out[..., left_out] = key
    return out.reshape(len(least), -1).view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """For each signature four signed 64-bit numbers with SYMBOL_BITS bits of each symbol."""
    bits = _mixed(least.reshape(len(least), 4, -1)) >> np.uint64(64 - SYMBOL_BITS)
    at = np.arange(bits.shape[2], dtype=np.uint64) * np.uint64(SYMBOL_BITS)
    return np.bitwise_or.reduce(bits << at, axis=2).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers with a bit for each of BUCKETS: whether an odd number of the text's shingles falls into it."""
    odd = np.bincount((_mixed(found) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(rows: DataFrame, text_col: str) -> DataFrame:
    """(node, n, keys, sketch) of rows (node, text)."""

    def run(cols: list[list]) -> list:
        sets = [shingles(t) for t in cols[1]]
        least = np.stack([symbols(s) for s in sets])
        return [cols[0], [len(s) for s in sets], arrow_lists(list(variants(least))), arrow_lists(list(sketches(least)))]

    return map_batches(rows.select("node", F.col(text_col).cast("string").alias("text")), run, "node long, n long, keys array<long>, sketch array<long>")


def _sets(rows: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, found, parity) for the given nodes: their whole sets of shingles."""
    texts = rows.select("node", F.col(text_col).cast("string").alias("text")).join(sent(nodes.select("node").distinct()), "node", "left_semi")

    def run(cols: list[list]) -> list:
        sets = [shingles(t) for t in cols[1]]
        return [cols[0], arrow_lists([x.view(np.int64) for x in sets]), arrow_lists([parities(x) for x in sets])]

    return written(map_batches(texts, run, "node long, found array<long>, parity array<long>"))


def _able(m: str, n: str) -> Column:
    """Whether sets of m and n shingles can have 0.8: with c in common, c / (m + n - c) >= 0.8."""
    return 9 * F.least(m, n) >= 4 * (F.col(m) + F.col(n))


def _near(x: str, y: str) -> Column:
    """Whether two sketches differ in at most FAR bits."""
    differ = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(4)]
    return differ[0] + differ[1] + differ[2] + differ[3] <= FAR


def _alike(x: str, y: str, m: str, n: str) -> Column:
    """Whether sets of m and n shingles with these parities can have 0.8: each bucket of another parity holds a shingle
    that only one of them has, and at 0.8 those are a ninth of m + n at most."""
    differ = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BUCKETS // 64)]
    return 9 * sum(differ[1:], differ[0]) <= F.col(m) + F.col(n)


def _linked(met: DataFrame, sigs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(u, v), u < v: of the met pairs (a, b) those with a Jaccard similarity of 0.8 or more."""
    pairs = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    for side in "uv":
        pairs = pairs.join(sigs.select(F.col("node").alias(side), F.col("sketch").alias("of_" + side)), side)
    pairs = cut(pairs.filter(_near("of_u", "of_v")).select("u", "v"))  # written, so that the joins can split a pivot of many pairs
    sets = _sets(rows, text_col, pairs.select(F.explode(F.array("u", "v")).alias("node")))
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("found").alias("y")), "v")
    return cut(both.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v"))


def _pivots(members: DataFrame, by: list[str], *more: str) -> DataFrame:
    """(key, p): up to PIVOTS nodes of each key, of the roots with the smallest hashes; p has the columns node, n, root and more."""
    own = F.struct("node", "n", "root", *more)
    least = [F.min(F.struct(F.xxhash64(*by, "root", F.lit(k)), F.xxhash64(*by, "node"), own.alias("p"))).alias(f"p{k}") for k in range(PIVOTS)]
    each = F.array_distinct(F.array(*(F.col(f"p{k}.p") for k in range(PIVOTS))))
    return cut(members.groupBy("key").agg(*least).select("key", F.explode(each).alias("p")))


def _rarest(apart: DataFrame, sigs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(key, node, root, n, sketch, parity, rarest) of nodes (node, root, n): a row for each of a node's rarest shingles
    that others have, too, and the first RAREST of them, in one order for all nodes."""
    sets = _sets(rows, text_col, apart)
    apart = apart.join(sigs.select("node", "sketch"), "node").join(sets.select("node", "parity"), "node")
    own = sets.select("node", F.explode("found").alias("h"))
    common = own.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = own.join(common, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    first = F.floor(F.col("n") / 5) + 1 - (F.col("n") - F.size("x"))  # those that no other node has are the rarest
    key = ranked.join(apart, "node").withColumn("x", F.slice(F.col("x.h"), 1, F.greatest(F.lit(0), first).cast("int")))
    return cut(key.select(F.explode("x").alias("key"), "node", "root", "n", "sketch", "parity", F.slice("x", 1, RAREST).alias("rarest")))


def _rare(apart: DataFrame, sigs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """(a, b): pairs of nodes (node, root, n) of different roots that share one of their rarest shingles, and whose sketches
    and parities are near. Pairs that other pairs' links connect, the first links being among the pairs, may be left out."""
    keys = _rarest(apart, sigs, rows, text_col)
    near = _able("n", "m") & _near("sketch", "its") & _alike("parity", "of_b", "m", "n")
    p = _pivots(keys, ["key"], "sketch", "parity").select("key", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.root").alias("other"), F.col("p.sketch").alias("its"), F.col("p.parity").alias("of_b"))
    held = keys.drop("rarest").join(p, "key").filter((F.col("root") != F.col("other")) & near).select(F.col("node").alias("a"), "b")
    found = _linked(held, sigs, rows, text_col)
    left = _open(keys.drop("root"), _merged(apart.select("node", "root"), found))
    other = left.select("key", F.col("node").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("its"), F.col("parity").alias("of_b"), F.col("rarest").alias("of"))
    # The first shingle that both rows list is a key of both texts; if they list none, the pair is made at each that it shares.
    once = F.coalesce(F.get(F.array_intersect("rarest", "of"), F.lit(0)) == F.col("key"), F.lit(True))
    met = left.join(other, "key").filter((F.col("root") < F.col("other")) & near & once).select(F.col("node").alias("a"), "b")
    return met.unionAll(found.select(F.col("u").alias("a"), F.col("v").alias("b")))


def _by_simhash(rows: DataFrame, text_col: str) -> DataFrame:
    """(a, b): texts with one fingerprint, held against the first of them, and the first ones of fingerprints that simhash links."""
    fps = cut(fingerprints(rows, "node", text_col, SIZE))
    first = cut(fps.groupBy("fp").agg(F.min("id").alias("b")))
    pairs = cut(links(first.select("fp")))
    for side, end in ("ua", "vb"):
        pairs = pairs.join(first.select(F.col("fp").alias(side), F.col("b").alias(end + "_")), side)
    same = fps.join(first, "fp").filter("id <> b").select(F.col("id").alias("a"), "b")
    return same.unionAll(pairs.select(F.col("a_").alias("a"), F.col("b_").alias("b")))


def connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), in order, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """components() of few edges, a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with in_task(None):
            ends = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
            if ends:
                found = connected(*(np.concatenate(x).astype(np.int64) for x in zip(*ends)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return _bounded(edges.coalesce(1)).mapInArrow(run, "node long, root long")


def _merged(roots: DataFrame | None, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) by the edges (u, v) and the roots so far. Edges are read from a table again: a checkpoint keeps
    what the optimizer inferred, and over several rounds of components that outgrows it."""
    if roots is not None:
        edges = edges.unionAll(roots.filter("root < node").select(F.col("root").alias("u"), F.col("node").alias("v")))
    edges = written(edges)
    few = edges.count() <= (ONE_TASK if most is None else most)
    return written(_in_one_task(edges) if few else components(edges))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members with the root of each node, of the keys whose nodes have several."""
    named = cut(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    return cut(named.join(several, "key"))


def similar_roots(rows: DataFrame, text_col: str, small: int = SMALL) -> DataFrame:
    """(node, root) for the nodes of components of two or more, of rows with a number `node` and a text.

    First each text is held against what simhash links it to and the NEAREST
    pivots that it shares most variants with, so a group of any size makes a
    few pairs a text. What comes after looks only at variants whose texts are
    not in one component yet.
    """
    sigs = written(_signatures(rows, text_col))
    keys = sigs.select(F.explode("keys").alias("key"), "node", "n")
    shared = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node"), "node", "n")).alias("p")).filter("c > 1"))
    members = cut(keys.join(shared.select("key", "c"), "key"))
    held = members.join(shared.select("key", F.col("p.node").alias("b"), F.col("p.n").alias("m")), "key").filter((F.col("node") != F.col("b")) & _able("n", "m"))
    held = held.groupBy("node", "b").agg(F.count(F.lit(1)).alias("votes"))
    nearest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("votes"), "b"))
    held = held.withColumn("nth", nearest).filter(F.col("nth") <= NEAREST).select(F.col("node").alias("a"), "b")
    roots = _merged(None, _linked(held.unionAll(_by_simhash(rows, text_col)), sigs, rows, text_col))

    left = _open(members, roots)
    few, many = left.filter(F.col("c") <= small), left.filter(F.col("c") > small)
    one = few.select("key", F.col("node").alias("a"), "n", "root")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    met = one.join(other, "key").filter((F.col("root") < F.col("other")) & _able("n", "m")).select("a", "b")
    pivots = _pivots(many, []).select("key", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.root").alias("other"))
    held = many.join(pivots, "key").filter((F.col("root") != F.col("other")) & _able("n", "m")).select(F.col("node").alias("a"), "b")
    roots = _merged(roots, _linked(met.unionAll(held), sigs, rows, text_col))

    apart = cut(_open(many.drop("root"), roots).select("node", "root", "n").distinct())
    if apart.isEmpty():
        return roots
    more = _linked(_rare(apart, sigs, rows, text_col), sigs, rows, text_col)
    return roots if more.isEmpty() else _merged(roots, more)


def _members(rows: DataFrame, id_col: str, text_col: str, small: int) -> DataFrame:
    """(node, least): the first row with the smallest id of its component, for rows of components of two or more."""
    roots = similar_roots(rows, text_col, small)
    ids = rows.select("node", F.col(id_col).alias("id"))
    found = cut(ids.join(roots, "node"))
    least = cut(found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("least")))  # written, so that the join can split a large root
    return cut(found.join(least, "root").select("node", "least"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """(id, component_id), one row per row of docs."""
    rows, name = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = rows.withColumnRenamed(name, "node")
    named = rows.select("id", "node").join(_members(rows, "id", "text", small), "node", "left")
    return named.select(F.col("id").alias(id_col), F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row of docs for each component, with its columns as they are."""
    rows, name = numbered(docs)
    own = rows.select(F.col(name).alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return without(rows, name, _members(own, "id", "text", small).filter("node <> least.node").select("node"))
