"""K-means: Lloyd's steps over dense vectors, the library's model, elbow sweeps and summaries of clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sample_order
from ..functions.vectors import squared_distance
from ..plans.stages import stable, topk


def _vector(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))


def initial_centroids(points: DataFrame, k: int, seed: int = 42) -> list[tuple[int, list[float]]]:
    """k distinct rows of points (id, v), first in a seeded hash order, with cluster numbers from 0."""
    rows = points.orderBy(sample_order(F.col("id"), seed), "id").limit(k).collect()
    return [(i, [float(x) for x in r["v"]]) for i, r in enumerate(rows)]


def _distances(batch: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch and their squared distances to all centres, never below 0."""
    x = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T
    return x, np.maximum(d, 0)


def assign(points: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """(id, v, cluster, dist): nearest centroid and squared distance; ties go to the lower cluster.

    K centroids of d numbers go along with the tasks; a batch of points meets
    them in one matrix product, without a row for each pair.
    """
    names, centres = np.array([c for c, _ in centroids], np.int32), np.array([v for _, v in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(b, centres)[1]
                best = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(names[best]), pa.array(d[np.arange(len(d)), best])], names=["id", "v", "cluster", "dist"])

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v").filter("v IS NOT NULL").mapInArrow(run, f"id {kind}, v array<double>, cluster int, dist double")


def step(points: DataFrame, centroids: list[tuple[int, list[float]]]) -> tuple[dict[int, list[float]], float]:
    """Means of the members of each cluster that has any, and the inertia, in one job.

    Each batch sends one row a cluster, so the shuffle doesn't grow with the points; K rows come to the driver.
    """
    names, centres = [c for c, _ in centroids], np.array([v for _, v in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, d = _distances(b, centres)
                best = d.argmin(axis=1)
                sums, count = np.zeros_like(centres), np.bincount(best, minlength=len(centres))
                np.add.at(sums, best, x)
                cost = np.bincount(best, d[np.arange(len(d)), best], len(centres))
                own = np.flatnonzero(count)
                arrays = [pa.array([names[k] for k in own], pa.int32()), pa.array(sums[own].tolist()), pa.array(count[own]), pa.array(cost[own])]
                yield pa.RecordBatch.from_arrays(arrays, names=["cluster", "s", "n", "cost"])

    parts = points.select("v").filter("v IS NOT NULL").mapInArrow(run, "cluster int, s array<double>, n long, cost double")
    rows = parts.groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    return {r["cluster"]: [x / r["n"] for x in r["s"]] for r in rows}, float(sum(r["cost"] for r in rows))


def means(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, value): the mean of each cluster's members."""
    long = assigned.select("cluster", F.posexplode("v").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.avg("x").alias("value"))


def refill(found: dict[int, list[float]], centroids: list[tuple[int, list[float]]], points: DataFrame, seed: int) -> list[tuple[int, list[float]]]:
    """New centroids; an empty cluster takes a row in a seeded hash order."""
    empty = [c for c, _ in centroids if c not in found]
    spare = initial_centroids(points, len(empty), seed) if empty else []
    return sorted([*found.items(), *((c, v) for c, (_, v) in zip(empty, spare))])


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.coalesce(F.sum("dist"), F.lit(0.0)).alias("inertia"))


@dataclass
class KMeans:
    """Lloyd's algorithm. strict_labels keeps the labels from before the last update, as some implementations do."""

    k: int = 100
    max_iter: int = 100
    tol: float = 1e-4
    seed: int = 42
    strict_labels: bool = False
    centers: list[tuple[int, list[float]]] = field(default_factory=list)
    inertia: float = 0.0
    steps: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, id_col: str = "id", vector_col: str = "v") -> KMeans:
        points = stable(_vector(df, id_col, vector_col))
        self.centers = initial_centroids(points, self.k, self.seed)
        self.steps, before = [], self.centers
        for i in range(self.max_iter):
            before = self.centers
            found, cost = step(points, self.centers)
            self.centers = refill(found, self.centers, points, self.seed + i + 1)
            self.steps.append(cost)
            moved = sum((x - y) ** 2 for (_, a), (_, b) in zip(before, self.centers) for x, y in zip(a, b)) ** 0.5
            if moved < self.tol:
                break
        if self.strict_labels:
            new = dict(self.centers)
            old = assign(points, before).select("id", "v", "cluster")
            table = df.sparkSession.createDataFrame(list(new.items()), "cluster int, c array<double>")
            labelled = old.join(F.broadcast(table), "cluster").select("id", "cluster", squared_distance(F.col("v"), F.col("c")).alias("dist"))
        else:
            labelled = assign(points, self.centers)
        self.labels = labelled.select("id", "cluster", "dist")
        self.inertia = float(inertia(labelled).first()[0])
        return self

    def transform(self, df: DataFrame, id_col: str = "id", vector_col: str = "v") -> DataFrame:
        """(id, cluster, dist) of any rows."""
        return assign(_vector(df, id_col, vector_col), self.centers).select("id", "cluster", "dist")

    def fit_predict(self, df: DataFrame, id_col: str = "id", vector_col: str = "v") -> DataFrame:
        return self.fit(df, id_col, vector_col).labels


def elbow(df: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 75, 100), max_iter: int = 50, tol: float = 1e-3, seed: int = 42, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """(k, inertia)."""
    points = stable(_vector(df, id_col, vector_col))
    rows = [(k, KMeans(k, max_iter, tol, seed).fit(points).inertia) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def library_kmeans(df: DataFrame, k: int = 100, seeds: tuple[int, ...] = (42,), vector_col: str = "features", max_iter: int = 20):
    """The library's model, the best of several seeds by training cost."""
    from pyspark.ml.clustering import KMeans as Library

    models = [Library(k=k, seed=s, featuresCol=vector_col, predictionCol="cluster", initMode="k-means||", maxIter=max_iter).fit(df) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost)


def cluster_terms(weights: DataFrame, clusters: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """(cluster, rank, term, weight): the heaviest terms of each cluster's mean. weights: doc, term, weight; clusters: id, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    sums = weights.join(clusters.select(F.col("id").alias("doc"), "cluster"), "doc").groupBy("cluster", "term").agg(F.sum("weight").alias("_s"))
    mean = sums.join(sizes, "cluster").select("cluster", "term", F.round(F.col("_s") / F.col("_n"), digits).alias("weight"))
    return topk(mean, ["cluster"], [F.desc("weight"), F.col("term")], n)


def cluster_samples(titled: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """(cluster, rank, title): the first non-null titles of each cluster. titled: cluster, title and the order columns."""
    found = topk(titled.filter(F.col("title").isNotNull()), ["cluster"], [F.col(c) for c in order], n)
    return found.select("cluster", "rank", "title")
