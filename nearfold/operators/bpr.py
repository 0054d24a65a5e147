"""Bayesian personalised ranking: triples with sampled negatives, and training by synchronous rounds.

Factors are tables of one row an id. A round joins triples with the factors of
their user and both items, computes gradients in numpy per Arrow batch, adds
them up by id on the executors and applies AdamW to every row. Nothing of the
size of users or items comes to the driver: the loss and the squared norm of
the gradients do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import softplus
from ..plans.stages import stable

REDRAWS = 100


def draw(user, item, epoch: int, attempt, n_items: int, seed: int = 42):
    """A uniform item from a hash that any SQL engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), user.cast("string"), item.cast("string"), attempt.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(n_items)


def triples(positives: DataFrame, n_items: int, epoch: int = 0, seed: int = 42, user: str = "user", item: str = "item") -> DataFrame:
    """(user, pos, neg): one for each positive row, repetitions kept.

    Attempts 0 to 100 draw an item; the first that isn't among the user's
    positives is taken, and after the last whatever it drew. Only pairs whose
    draw was a positive go on to a next attempt, so few rows are drawn twice.
    """
    rows = positives.select(F.col(user).alias("user"), F.col(item).alias("pos")).groupBy("user", "pos").agg(F.count(F.lit(1)).alias("_times"))
    own = rows.select("user", F.col("pos").alias("neg"))
    step, done, attempt = 8, [], 0
    left = rows
    while attempt <= REDRAWS:
        tries = F.sequence(F.lit(attempt), F.lit(min(REDRAWS, attempt + step - 1)))
        drawn = left.select("user", "pos", "_times", F.explode(tries).alias("attempt"))
        drawn = drawn.withColumn("neg", draw(F.col("user"), F.col("pos"), epoch, F.col("attempt"), n_items, seed))
        ok = drawn.join(own, ["user", "neg"], "left_anti").groupBy("user", "pos", "_times").agg(F.min_by("neg", "attempt").alias("neg"))
        ok = stable(ok)
        done.append(ok.select("user", "pos", "neg", "_times"))
        left = left.join(ok.select("user", "pos"), ["user", "pos"], "left_anti")
        attempt, step = attempt + step, 101
        if attempt <= REDRAWS and left.isEmpty():
            left = left.limit(0)
            break
    last = draw(F.col("user"), F.col("pos"), epoch, F.lit(REDRAWS), n_items, seed)
    out = left.select("user", "pos", last.alias("neg"), "_times")
    for d in done:
        out = out.unionByName(d)
    return out.select("user", "pos", "neg", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_n")).drop("_n")


def mean_loss(scored: DataFrame, pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """One row (loss): the mean of softplus(neg - pos)."""
    return scored.agg(F.coalesce(F.avg(softplus(F.col(neg) - F.col(pos))), F.lit(0.0)).alias("loss"))


def initial_factors(ids: DataFrame, d: int, seed: int = 42, sigma: float = 0.01) -> DataFrame:
    """(id, factor, bias, m, v): normal numbers from hashes of the id and place, biases and moments 0."""
    unit = lambda k, s: (F.pmod(F.xxhash64("id", k, F.lit(seed + s)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda k: (F.sqrt(-2 * F.log(unit(k, 0))) * F.cos(2 * np.pi * unit(k, 1)) * sigma).cast("float"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), d + 1)
    return ids.select("id").distinct().select("id", normal.alias("factor"), F.lit(0.0).cast("float").alias("bias"), zero.alias("m"), zero.alias("v"))


@dataclass
class BPR:
    d: int = 64
    rate: float = 1e-3
    decay: float = 1e-5
    clip: float = 5.0
    rounds: int = 4
    seed: int = 42
    users: DataFrame | None = None
    items: DataFrame | None = None
    epoch: int = 0
    step: int = 0
    losses: list[float] = field(default_factory=list)

    def start(self, users: DataFrame, items: DataFrame) -> BPR:
        """users, items: column id."""
        self.users = stable(initial_factors(users, self.d, self.seed))
        self.items = stable(initial_factors(items, self.d, self.seed + 7))
        return self

    def _gradients(self, part: DataFrame) -> DataFrame:
        """(side, id, g, loss, n): gradients of the summed loss, added up per batch."""
        u = self.users.select(F.col("id").alias("user"), F.col("factor").alias("u"), F.col("bias").alias("bu"))
        i = self.items.select(F.col("id").alias("pos"), F.col("factor").alias("p"), F.col("bias").alias("bp"))
        j = self.items.select(F.col("id").alias("neg"), F.col("factor").alias("q"), F.col("bias").alias("bq"))
        rows = part.join(u, "user").join(i, "pos").join(j, "neg").select("user", "pos", "neg", "u", "p", "q", "bp", "bq")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                u, p, q = (np.stack(b[c].to_list()).astype(np.float64) for c in "upq")
                x = (u * (p - q)).sum(axis=1) + b["bp"].to_numpy() - b["bq"].to_numpy()
                g = -1 / (1 + np.exp(x))  # of softplus(-x)
                one, none = g[:, None], np.zeros((len(b), 1))
                parts = [(0, b["user"], np.hstack([one * (p - q), none])), (1, b["pos"], np.hstack([one * u, one])), (1, b["neg"], np.hstack([-one * u, -one]))]
                loss, n = float(np.logaddexp(0, -x).sum()), len(b)
                for side, ids, grads in parts:
                    keys, at = np.unique(ids.to_numpy(), return_inverse=True)
                    total = np.zeros((len(keys), grads.shape[1]))
                    np.add.at(total, at, grads)
                    yield pd.DataFrame({"side": side, "id": keys, "g": list(total), "loss": [loss] + [0.0] * (len(keys) - 1), "n": [n] + [0] * (len(keys) - 1)})
                    loss, n = 0.0, 0

        out = rows.mapInPandas(run, "side int, id long, g array<double>, loss double, n long")
        return out.groupBy("side", "id").agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("loss").alias("loss"), F.sum("n").alias("n")).withColumn("g", vector_to_array("g"))

    def _apply(self, table: DataFrame, grads: DataFrame, scale: float) -> DataFrame:
        """AdamW on every row; rows without a gradient still decay and keep their momentum."""
        rate, decay, step = self.rate, self.decay, self.step

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                w = np.hstack([np.stack(b["factor"].to_list()), b["bias"].to_numpy()[:, None]]).astype(np.float64)
                g = np.stack([np.zeros(w.shape[1]) if x is None else np.asarray(x) for x in b["g"]]) * scale
                m = 0.9 * np.stack(b["m"].to_list()) + 0.1 * g
                v = 0.999 * np.stack(b["v"].to_list()) + 0.001 * g * g
                w = w * (1 - rate * decay) - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                f = lambda a: list(a.astype(np.float32))
                yield pd.DataFrame({"id": b["id"], "factor": f(w[:, :-1]), "bias": w[:, -1].astype(np.float32), "m": f(m), "v": f(v)})

        rows = table.join(grads.select("id", "g"), "id", "left")
        return stable(rows.mapInPandas(run, "id long, factor array<float>, bias float, m array<float>, v array<float>"))

    def train_epoch(self, positives: DataFrame, n_items: int) -> float:
        """One pass over the positives (user, item) in a few synchronous rounds; returns the mean loss."""
        t = stable(triples(positives, n_items, self.epoch, self.seed))
        part = F.pmod(F.xxhash64("user", "pos", "neg", F.lit(self.epoch)), F.lit(self.rounds))
        total, count = 0.0, 0
        for r in range(self.rounds):
            grads = stable(self._gradients(t.filter(part == r)))
            norm2, loss, n = grads.agg(F.sum(F.aggregate("g", F.lit(0.0), lambda s, x: s + x * x)), F.sum("loss"), F.sum("n")).first()
            if not n:
                continue
            self.step += 1
            scale = 1 / n * min(1.0, self.clip / max((norm2**0.5) / n, 1e-12))
            self.users = self._apply(self.users, grads.filter("side = 0"), scale)
            self.items = self._apply(self.items, grads.filter("side = 1"), scale)
            total, count = total + loss, count + n
        self.epoch += 1
        self.losses.append(total / max(1, count))
        return self.losses[-1]

    def fit(self, positives: DataFrame, n_items: int, epochs: int = 30, path: str | None = None) -> BPR:
        """Trains on; with a path, keeps a checkpoint whenever the loss improves."""
        best = float("inf")
        for _ in range(epochs):
            loss = self.train_epoch(positives, n_items)
            if path and loss < best:
                self.save(path)
            best = min(best, loss)
        return self

    def save(self, path: str) -> None:
        self.users.write.mode("overwrite").parquet(f"{path}/users-{self.epoch}")
        self.items.write.mode("overwrite").parquet(f"{path}/items-{self.epoch}")
        kept = {"epoch": self.epoch, "step": self.step, "d": self.d, "losses": self.losses}
        self.users.sparkSession.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def load(self, spark: SparkSession, path: str) -> int:
        """Resumes after the saved epoch; 0 and nothing done if there is no checkpoint."""
        from pyspark.errors import AnalysisException

        try:
            kept = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        except AnalysisException:
            return 0
        self.epoch, self.step, self.d, self.losses = kept["epoch"], kept["step"], kept["d"], kept["losses"]
        self.users = spark.read.parquet(f"{path}/users-{self.epoch}")
        self.items = spark.read.parquet(f"{path}/items-{self.epoch}")
        return self.epoch


def interaction_matrix(df: DataFrame, item: str = "item", user: str = "user") -> DataFrame:
    """(item, user, n): how often each pair occurs."""
    return df.groupBy(item, user).agg(F.count(F.lit(1)).alias("n"))


def als(matrix: DataFrame, rank: int = 64, iterations: int = 1, seed: int = 42):
    """The library's implicit factorisation, for comparison; another loss. matrix: item, user, n."""
    from pyspark.ml.recommendation import ALS

    m = matrix.select(F.col("user").cast("int"), F.col("item").cast("int"), F.col("n").cast("float"))
    return ALS(rank=rank, maxIter=iterations, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="n").fit(m)
