"""Exact top-k search by inner product with M-trees.

Vectors get one more component that makes their norms equal, after which the
largest inner product is the nearest neighbour, and a metric tree can search.
A tree has pages of entries: in a leaf vectors, above routing vectors with the
covering radius of their page, each with its distance to the page's own routing
vector. A query takes the page with the least possible distance first and stops
when none can hold a better row; stored distances to the parent rule out
entries by the triangle inequality before a distance is computed. Bounds only
prune, scores are exact integers.

Of rows with one and the same vector only the k + 1 smallest ids can be among
a query's k best, so no others are searched; queries with one vector are
searched once. Rows are dealt to regions around up to PIVOTS of them, each row
to the nearest one, and a region of more than SHARD rows is split by the hash
of the id; each part has a tree. No row x of a region with pivot p and radius r
has a product with a query q above q.p + |q| r. A query searches one part
first; its last score there is a floor, and it goes on only to the regions
whose bound reaches the floor, in blocks of about BLOCK queries. A tree is
copied only for blocks that need it.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part. Rows that repeat an id and a vector
count once. Vectors meet those of as many components only. Ties go to the
smaller id. A row is no neighbour of rows that repeat its id with another
vector, and these are one query together. An empty table, or one without
queries, gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

SHARD, BLOCK, PIVOTS = 8192, 4096, 1024
PAGE, FAN = 128, 16


@dataclass
class Page:
    rows: np.ndarray  # of a leaf: its vectors; else of the routing vectors
    to_parent: np.ndarray
    radius: np.ndarray | None = None
    child: list[Page] = field(default_factory=list)


class Tree:
    """An M-tree over integer vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, page: int = PAGE, fan: int = FAN):
        self.ids, self.page, self.fan = ids, page, fan
        wide = float(np.abs(vectors).max(initial=0))
        #: 64-bit floats hold the products exactly, or else Python's integers do.
        self.exact = vectors.astype(np.float64) if wide * wide * max(1, vectors.shape[1]) < 2**52 else vectors.astype(object)
        x = vectors.astype(np.float64)
        norm = (x * x).sum(axis=1)
        self.reach = float(norm.max(initial=0.0))
        self.points = np.column_stack([x, np.sqrt(np.maximum(0, self.reach - norm))])
        rows = np.arange(len(ids))
        self.top = int(rows[0]) if len(rows) else -1
        self.root = self._build(rows, self.top) if len(rows) else None
        self.computed = 0

    def __getstate__(self) -> dict:
        """The vectors are stored once, where the points hold them exactly."""
        return self.__dict__ | ({} if self.exact.dtype == object else {"exact": None})

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.exact is None:
            self.exact = np.ascontiguousarray(self.points[:, :-1])

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[centre]) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: int) -> Page:
        if len(rows) <= self.page:
            return Page(rows, self._far(rows, parent))
        centres = [int(rows[0])]
        nearest = self._far(rows, centres[0])
        for _ in range(min(self.fan, -(-len(rows) // self.page)) - 1):  # each far from those before
            centres.append(int(rows[nearest.argmax()]))
            nearest = np.minimum(nearest, self._far(rows, centres[-1]))
        distance = np.stack([self._far(rows, c) for c in centres])
        home = distance.argmin(axis=0)
        if len(np.unique(home)) == 1:  # alike vectors can't be told apart
            home = np.arange(len(rows)) * len(centres) // len(rows)
            centres = [int(rows[home == k][0]) for k in range(len(centres))]
        groups = [(c, rows[home == k]) for k, c in enumerate(centres) if (home == k).any()]
        routing = np.array([c for c, _ in groups])
        radius = np.array([self._far(g, c).max() for c, g in groups])
        return Page(routing, self._far(routing, parent), radius, [self._build(g, c) for c, g in groups])

    def search(self, query: np.ndarray, own: int | None, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), without the id `own`; floor: scores below it aren't wanted."""
        if self.root is None:
            return []
        q = query.astype(np.float64)
        here = np.append(q, 0.0)
        norm = float(q @ q)
        exact_q = query.astype(self.exact.dtype)
        if self.exact.dtype != object and float(np.abs(q).max(initial=0)) * float(np.abs(self.exact).max(initial=0)) * len(q) >= 2**52:
            self.exact = self.exact.astype(np.int64).astype(object)
            exact_q = query.astype(object)
        best: list[tuple[int, int]] = []  # (score, -id), the worst first

        def limit() -> float:
            low = best[0][0] if len(best) == k else floor
            if low is None:
                return np.inf
            d = np.sqrt(max(0.0, norm + self.reach - 2.0 * float(low)))
            return d + 1e-6 * (1 + d)

        def distances(rows: np.ndarray) -> np.ndarray:
            self.computed += len(rows)
            return np.sqrt(((self.points[rows] - here) ** 2).sum(axis=1))

        pages = [(0.0, 0, self.root, float(distances(np.array([self.top]))[0]))]
        made = 0
        while pages:
            least, _, page, to_query = heapq.heappop(pages)
            bound = limit()
            if least > bound:
                break
            sure = np.abs(page.to_parent - to_query)
            if page.radius is None:
                rows = page.rows[sure <= bound]
                if not len(rows):
                    continue
                self.computed += len(rows)
                scores = self.exact[rows] @ exact_q
                low = best[0][0] if len(best) == k else floor
                for i in np.flatnonzero(scores >= low) if low is not None else range(len(rows)):
                    one = (int(scores[i]), -int(self.ids[rows[i]]))
                    if -one[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
            else:
                ok = np.flatnonzero(sure - page.radius <= bound)
                if len(ok):
                    d = distances(page.rows[ok])
                    for i, x in zip(ok, d):
                        low = max(least, float(x) - float(page.radius[i]))
                        if low <= bound:
                            made += 1
                            heapq.heappush(pages, (low, made, page.child[i], float(x)))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x; null for a vector that takes no part."""
    ok = embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


class Regions:
    """Pivots by the number of components: which region a row is in, and which regions a query must visit."""

    def __init__(self, pivots: list[np.ndarray]):
        self.points: dict[int, np.ndarray] = {}
        for d in {len(p) for p in pivots}:
            self.points[d] = np.unique(np.stack([p for p in pivots if len(p) == d]), axis=0)
        #: by components: region numbers, rows of each and radius; -1 is the region of vectors without a pivot
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance to it."""
        p = self.points.get(x.shape[1])
        if p is None or not x.shape[1]:
            return np.full(len(x), -1), np.zeros(len(x))
        near = ((p * p).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        return near, np.sqrt(((x - p[near]) ** 2).sum(axis=1))

    def learn(self, rows: list[tuple[int, int, int, float]]) -> None:
        """rows: (components, region, rows, radius) of all regions that hold any."""
        for d in {r[0] for r in rows}:
            own = sorted(r[1:] for r in rows if r[0] == d)
            self.known[d] = tuple(np.array(c) for c in zip(*own))

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """q.p and q.p + |q| r for queries (rows) and regions (columns), the latter rounded up."""
        names, _, radius = self.known[q.shape[1]]
        if q.shape[1] not in self.points or not q.shape[1]:
            return np.zeros((len(q), len(names))), np.full((len(q), len(names)), np.inf)
        p = self.points[q.shape[1]][names]
        centre, size = q @ p.T, np.sqrt((q * q).sum(axis=1))[:, None]
        far = size * radius
        return centre, centre + far + 1e-9 * (size * np.sqrt((p * p).sum(axis=1)) + far) + 1

    def first(self, q: np.ndarray, least: int) -> np.ndarray:
        """The column of the region that each query searches first, of those with `least` rows if there are any."""
        n = self.known[q.shape[1]][1]
        centre = self.products(q)[0]
        return (centre if (n < least).all() else np.where(n >= least, centre, -np.inf)).argmax(axis=1)


def _by_width(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, part in pdf.groupby("dim"):
        yield part, np.stack([np.asarray(v, np.float64) for v in part["v"]])


def _place(rows: DataFrame, regions: Regions) -> DataFrame:
    """rows (id, v, dim) with their region and distance to its pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, x in _by_width(b):
                near, far = regions.place(x)
                yield part.assign(region=near.astype("int32"), far=far)

    return rows.select("id", "v", "dim").mapInPandas(run, "id long, v array<long>, dim int, region int, far double")


_VISIT = "id long, v array<long>, dim int, floor double, block int, region int, sub int"


def _first_visits(queries: DataFrame, regions: Regions, shard: int, blocks: int, least: int) -> DataFrame:
    """Each query (id, v, dim) with the part that it searches first, its home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, q in _by_width(b):
                if q.shape[1] in regions.known:
                    names, n, _ = regions.known[q.shape[1]]
                    column = regions.first(q, least)
                    code = (part["id"].to_numpy(np.int64) * 0x9E3779B1 >> 7) & 0x7FFFFFFF  # spreads numbers that have a common divisor
                    yield part.assign(floor=np.nan, block=(code % blocks).astype("int32"), region=names[column].astype("int32"), sub=(code % -(-n // shard)[column]).astype("int32"))

    return queries.select("id", "v", "dim").mapInPandas(run, _VISIT)


def _more_visits(homes: DataFrame, regions: Regions, shard: int) -> DataFrame:
    """A row for each query (first visits, with floors) and part that its floor leaves, without its home."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, q in _by_width(b):
                names, n, _ = regions.known[q.shape[1]]
                floor = part["floor"].to_numpy(np.float64)
                wanted = regions.products(q)[1] >= np.where(np.isnan(floor), -np.inf, floor)[:, None]
                region, own = part["region"].to_numpy(), part["sub"].to_numpy()
                for column in np.flatnonzero(wanted.any(axis=0)):
                    some = np.flatnonzero(wanted[:, column])
                    for sub in range(-(-int(n[column]) // shard)):
                        left = some[(region[some] != names[column]) | (own[some] != sub)]
                        if len(left):
                            yield part.iloc[left].assign(region=np.int32(names[column]), sub=np.int32(sub))

    return homes.select("id", "v", "dim", "floor", "block", "region", "sub").mapInPandas(run, _VISIT)


def top_k(vectors: DataFrame, wanted: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard: int = SHARD, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score) for each row that `wanted` marks as a query, against all rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(wanted, F.lit(False)).alias("q"))
    rows = cut(rows.filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id", "v").agg(F.max("q").alias("q")).withColumn("dim", F.size("v")))
    total = rows.count()
    most = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    found_k = k + most  # a query's own rows may be among what is found
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(1, -(-2 * total // shard)))).select("v").collect()
    regions = Regions([np.asarray(r.v, np.float64) for r in some])
    placed = cut(_place(rows.withColumn("place", place).filter(F.col("place") <= k + 1), regions))
    held = placed.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    held = held.collect()  # a row a pivot and number of components
    regions.learn([tuple(r) for r in held])
    parts = rows.sparkSession.createDataFrame([(r.dim, r.region, -(-r.n // shard)) for r in held], "dim int, region int, parts int")
    placed = placed.join(F.broadcast(parts), ["dim", "region"]).withColumn("sub", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    what, shards = "query_id long, id long, score long", ["dim", "region", "sub"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        tree = Tree(np.stack(pdf["v"].to_list()).astype(np.int64), pdf["id"].to_numpy())
        return pdf[shards].iloc[:1].assign(tree=[pickle.dumps(tree)])

    def find(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in trees["tree"]:
            tree = pickle.loads(blob)
            for name, v, floor in zip(queries["id"], queries["v"], queries["floor"]):
                out += [(name, i, s) for s, i in tree.search(np.asarray(v, np.int64), None, found_k, None if pd.isna(floor) else int(floor))]  # rounded down already
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    def search(visits: DataFrame) -> DataFrame:
        key = [*shards, "block"]
        needed = visits.select(*[F.col(c).alias(f"t_{c}") for c in key]).distinct()
        copies = needed.join(trees.withColumnsRenamed({c: f"t_{c}" for c in shards}), [f"t_{c}" for c in shards])
        return copies.groupBy(*[f"t_{c}" for c in key]).cogroup(visits.groupBy(*key)).applyInPandas(find, what)

    trees = cut(placed.select("id", "v", *shards).groupBy(*shards).applyInPandas(build, "dim int, region int, sub int, tree binary"))
    asked = rows.filter("q").select(F.col("id").alias("query_id"), "v")
    # a query is a vector, with a number of its own that the checkpoint fixes
    queries = cut(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("id"), "v", F.size("v").alias("dim")))
    homes = cut(_first_visits(queries, regions, shard, max(1, -(-queries.count() // block)), min(4 * found_k, shard)))
    found = cut(search(homes))
    low = F.min("score").cast("double")
    low = F.when(F.abs(low) < 2.0**52, low).otherwise(F.floor(low - F.abs(low) * 1e-9).cast("double"))
    floors = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= found_k, low).alias("floor"))
    rest = cut(homes.drop("floor").join(floors, "id", "left"))
    found = found.unionByName(search(_more_visits(rest, regions, shard)))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= found_k).select(F.col("query_id").alias("number"), "id", "score")
    names = asked.join(queries.select(F.col("id").alias("number"), "v"), "v").select("query_id", "number")
    out = names.join(found, "number").filter("id <> query_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
