"""Quality by a convolutional network over bytes.

Each byte has a learned embedding and learned filters run over every place of
the text. Their rectified answers are max-pooled within overlapping chunks that
cover the whole document; the mean and the maximum over the chunks combine into
one probability. A filter over embedded bytes is a sum of one table entry a
byte, which is how it is computed. All is trained in numpy.

Learning takes at most FIT_ROWS labelled rows of each class (those of the
smallest hash of the id), with all chunks of each; steps of training look at
STEP chunks at a time, however long a text is.

Defined results: a null text is empty, and an empty one scores as a document
of no bytes does (its filters answer nothing). Without labels of both classes
every score is 0.5. Null ids and repeated rows are kept. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, labelled_sample, map_batches, train_in_one_task

FIT_ROWS = 2000
#: Chunks that a step of training holds answers of.
STEP = 128
CHUNK, STRIDE = 512, 448
WIDTH, EMBED, FILTERS = 5, 8, 12
#: Bytes that one step of scoring looks at.
BLOCK = 1 << 18


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # for the mean, then for the maximum over chunks
    constant: float
    trained: bool = True

    def tables(self) -> np.ndarray:
        """What a byte adds to each filter at each place of it: WIDTH x 256 x FILTERS."""
        t = np.einsum("be,wef->wbf", self.embed, self.filters)
        t[0] += self.bias
        return np.ascontiguousarray(t, np.float32)


def starts(size: int) -> np.ndarray:
    """Where the chunks of a text of so many bytes start; the last one reaches its end."""
    return np.arange(0, max(1, size - (CHUNK - STRIDE)), STRIDE)


def answers(tables: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rectified answers at every place of data (bytes, as indices)."""
    n = len(data) - WIDTH + 1
    a = tables[0][data[:n]]
    for k in range(1, WIDTH):
        a += tables[k][data[k : k + n]]
    return np.maximum(a, 0, out=a)


def pooled(tables: np.ndarray, text: bytes) -> np.ndarray:
    """Max-pooled answers of each chunk."""
    data = np.frombuffer(text, np.uint8).astype(np.intp)
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), np.intp)])
    rows = []
    at = starts(len(data))
    per = max(1, BLOCK // STRIDE)
    for i in range(0, len(at), per):
        own = at[i : i + per]
        lo, hi = own[0], min(len(data), own[-1] + CHUNK)
        a = answers(tables, data[lo:hi])
        bounds = np.stack([own - lo, np.minimum(own - lo + CHUNK - WIDTH + 1, len(a))], axis=1).ravel()
        if bounds[-1] == len(a):
            bounds = bounds[:-1]
        rows.append(np.maximum.reduceat(a, bounds, axis=0)[::2])
    return np.concatenate(rows)


def chunked(text: str | None) -> list[bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return [b[a : a + CHUNK] for a in starts(len(b))]


def tops(tables: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chunks (bytes in rows, and how many count) the place and the value of each filter's largest answer."""
    places = CHUNK - WIDTH + 1
    place, value = np.empty((len(data), FILTERS), np.int64), np.empty((len(data), FILTERS), np.float32)
    for i in range(0, len(data), STEP):
        d = data[i : i + STEP].astype(np.intp)
        a = tables[0][d[:, :places]]
        for k in range(1, WIDTH):
            a += tables[k][d[:, k : k + places]]
        a[np.arange(places)[None, :] > (size[i : i + STEP] - WIDTH)[:, None]] = -np.inf
        place[i : i + STEP] = a.argmax(axis=1)
        value[i : i + STEP] = np.maximum(a.max(axis=1), 0)
    return place, value


def weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 0.5 / np.sqrt(WIDTH), (WIDTH, EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, 2 * FILTERS), "constant": np.zeros(1),
    }


def gradients(w: dict[str, np.ndarray], data: np.ndarray, size: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Of the weighted mean cross-entropy of texts with n chunks each, and that mean. Gradients reach the filters where they answered most."""
    tables = Net(w["embed"], w["filters"], w["bias"], w["out"], 0.0).tables()
    top, pool = tops(tables, data, size)
    of = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    avg, most = np.add.reduceat(pool, begin) / n[:, None], np.maximum.reduceat(pool, begin)
    feats = np.concatenate([avg, most], axis=1)
    z = feats @ w["out"] + w["constant"]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    d = (p - y) * weight / len(n)
    g = {"out": feats.T @ d, "constant": np.array([d.sum()])}
    df = d[:, None] * w["out"]
    dpool = (df[:, :FILTERS] / n[:, None])[of] + np.where(pool == most[of], df[of, FILTERS:], 0)
    dpool = np.where(pool > 0, dpool, 0)
    g["bias"] = dpool.sum(axis=0)
    g["filters"], g["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
    f = np.broadcast_to(np.arange(FILTERS), top.shape)
    for k in range(WIDTH):
        dt = np.zeros((256, FILTERS))
        np.add.at(dt, (np.take_along_axis(data, top + k, axis=1), f), dpool)
        g["filters"][k] = w["embed"].T @ dt
        g["embed"] += dt @ w["filters"][k].T
    return g, float(((np.logaddexp(0, z) - y * z) * weight).mean())


def train(chunks: list[list[bytes]], y: list[int], epochs: int = 15, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Net:
    """chunks: of each example.

    Each example comes once more as a short piece of itself, so that short
    documents are judged by what they hold and not by their length.
    """
    rng = np.random.default_rng(seed)
    pieces = []
    for cs in chunks:
        c = cs[rng.integers(len(cs))]
        size = int(rng.integers(16, 160))
        at = int(rng.integers(0, max(1, len(c) - size + 1)))
        pieces.append([c[at : at + size]])
    chunks, labels = [*chunks, *pieces], np.array([*y, *y], np.float64)
    w = weights(rng)
    if not len(labels) or not 0 < labels.sum() < len(labels):
        return Net(w["embed"], w["filters"], w["bias"], w["out"], 0.0, False)
    flat = np.zeros((sum(map(len, chunks)), CHUNK), np.uint8)
    size = np.zeros(len(flat), np.int64)
    for k, c in enumerate(c for cs in chunks for c in cs):
        flat[k, : len(c)] = np.frombuffer(c, np.uint8)
        size[k] = max(WIDTH, len(c))
    first = np.concatenate([[0], np.cumsum([len(cs) for cs in chunks])])
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            g, _ = gradients(w, flat[rows], size[rows], first[docs + 1] - first[docs], labels[docs], weight[docs])
            g["out"] += 1e-4 * w["out"]
            step += 1
            for name, v in g.items():
                mean[name] = 0.9 * mean[name] + 0.1 * v
                square[name] = 0.999 * square[name] + 0.001 * v * v
                w[name] = w[name] - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)
    return Net(w["embed"], w["filters"], w["bias"], w["out"], float(w["constant"][0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", usable: Column | None = None, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Net:
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if usable is None else usable, rows, id_col, text_col)

    def learn(batches: Iterator[list[list]]) -> bytes:
        chunks, y = [], []
        for _, texts, marks in batches:
            chunks += map(chunked, texts)
            y += marks
        return pickle.dumps(train(chunks, y))

    return pickle.loads(train_in_one_task(sample, learn))


def score_text(net: Net, tables: np.ndarray, text: str | None) -> float:
    if not net.trained:
        return 0.5
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return float(1 / (1 + np.exp(-net.constant)))
    rows = pooled(tables, b)
    x = np.concatenate([rows.mean(axis=0), rows.max(axis=0)]) @ net.out + net.constant
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the probability of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(cols: list[list]) -> list:
        tables = sent.value.tables()
        return [cols[0], [score_text(sent.value, tables, t) for t in cols[1]]]

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 3) == 1
