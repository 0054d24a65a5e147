"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word gives the network word inputs (a learned embedding of the word, by
its hash, and how it divides toxic from other texts) and character inputs (the
mean of learned embeddings of its character n-grams, and how those divide the
texts). The network reads overlapping windows of words in both directions,
attention pools the states, and a text's score is that of its most toxic
window; every window of the whole text is scored. Embeddings, gates, attention
and output are trained together in numpy: the network sees the window of each
text that it finds worst, chosen anew from all its windows at each epoch. How
words divide the texts leaves out the text in training.

Learning takes at most FIT_ROWS labelled rows of each class (those of the
smallest hash of the id), whole texts, read in batches and held as a number a
word.

Defined results: a null or empty text, or one without words, scores 0. Without
labels of both classes every score is 0. Null ids and repeated rows are kept
and judged like others. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, fold, kept_batches, labelled_sample, map_batches, train_in_one_task
from .words import WordTable, characters, sums

FIT_ROWS = 2000
WINDOW, STRIDE = 24, 16
#: Bits of the buckets of words and n-grams: of the counts, and of the embeddings.
WORD_BITS, GRAM_BITS, EMBED_BITS = 17, 18, 14
HIDDEN, ATTEND, EMBED = 8, 8, 4
COUNTED = 5
INPUTS = COUNTED + 2 * EMBED
BLOCK = 4096
#: While texts are scored: words whose inputs are held, characters looked up and windows run at a time. Idle or not, workers count beside the JVM.
HELD_WORDS, LOOKED_UP, RUN = 50_000, 500_000, 1024


def plain(words: list[bytes]) -> list[str]:
    """Lower case, without what surrounds or divides the letters and digits; a word of other signs stays."""
    out = []
    for w in words:
        t = w.decode("utf-8", "replace").lower()
        out.append(t if t.isalnum() else "".join(c for c in t if c.isalnum()) or t)
    return out


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, buckets of its character 3- and 5-grams in turn, how many)."""
    codes, starts = characters([w or " " for w in words])
    inner = np.cumsum(np.ones(len(codes), np.int64)) - 1 - np.repeat(starts[:-1], np.diff(starts))
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(inner.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        whole = sums(codes * power[inner], np.diff(starts)) if len(words) else np.zeros(0, np.uint64)
        size = np.repeat(np.diff(starts), np.diff(starts))
        grams = []
        for n in (3, 5):
            h = np.full(len(codes), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + np.roll(codes, -k) * np.uint64(0xC2B2AE3D27D4EB4F)
            grams.append((h, inner + n <= size))
    (h3, ok3), (h5, ok5) = grams
    both = np.stack([h3, h5], axis=1)
    ok = np.stack([ok3, ok5], axis=1)
    counts = sums(ok.sum(axis=1), np.diff(starts)) if len(words) else np.zeros(0, np.int64)
    return _mix(whole, WORD_BITS), _mix(both[ok], GRAM_BITS), counts


def log_odds(p: np.ndarray, n: np.ndarray, total_p: float, total_n: float, a: float = 0.5) -> np.ndarray:
    return np.log((p + a) / (total_p + 2 * a)) - np.log((n + a) / (total_n + 2 * a))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Net:
    """The network's weights by name, and its inputs' counts of texts with each bucket, toxic and not."""

    w: dict[str, np.ndarray]
    word: np.ndarray
    gram: np.ndarray
    totals: tuple[float, float]

    def counted(self, b: np.ndarray, grams: np.ndarray, counts: np.ndarray, without: tuple[int, int] = (0, 0)) -> np.ndarray:
        """COUNTED numbers for each hashed() word; without: a text of either class to be left out of the counts."""
        off = np.array(without, np.float32)[:, None]
        total = np.maximum(1, np.array(self.totals) - np.array(without))
        odds = lambda t, i: log_odds(*np.maximum(0, t[:, i] - off), *total).astype(np.float32)
        g = odds(self.gram, grams)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        seen = np.log1p(np.maximum(0, self.word[:, b] - off).sum(axis=0))
        return np.column_stack([odds(self.word, b) / 2, sums(g, counts) / counts, np.maximum.reduceat(g, starts) / 2, np.minimum.reduceat(g, starts) / 2, seen / 4]).astype(np.float32)

    def embedded(self, b: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The learned inputs of each hashed() word."""
        low = (1 << EMBED_BITS) - 1
        return np.concatenate([self.w["word"][b & low], sums(self.w["gram"][grams & low], counts) / counts[:, None].astype(np.float32)], axis=1)

    def inputs(self, words: list[str]) -> np.ndarray:
        """INPUTS numbers for each word."""
        if not words:
            return np.zeros((0, INPUTS), np.float32)
        found = hashed(words)
        return np.concatenate([self.counted(*found), self.embedded(*found)], axis=1).astype(np.float32)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions take from the inputs."""
        return np.concatenate([x @ self.w[f"W{d}"] + self.w[f"b{d}"] for d in "fb"], axis=1).astype(np.float32)

    def run(self, a: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. a: windows x places x projected inputs of their words; mask: 1 where there is a word."""
        n, t, h = a.shape[0], a.shape[1], HIDDEN
        states = np.zeros((n, t, 2 * h), np.float32)
        for d, name in enumerate("fb"):
            u, now = self.w[f"U{name}"], np.zeros((n, h), np.float32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                x, m = a[:, i, 3 * h * d : 3 * h * (d + 1)], mask[:, i, None]
                r = now @ u
                gates = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
                z, reset = gates[:, :h], gates[:, h:]
                c = np.tanh(x[:, 2 * h :] + reset * r[:, 2 * h :])
                if keep is not None:
                    keep[name, i] = (now, z, reset, c, r[:, 2 * h :])
                now = now + m * (1 - z) * (c - now)
                states[:, i, h * d : h * (d + 1)] = now
        hidden = np.tanh(states @ self.w["A"])
        e = hidden @ self.w["v"]
        e = np.where(mask > 0, e, -1e9)
        p = np.exp(e - e.max(axis=1, keepdims=True)) * (mask > 0)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", p, states)
        if keep is not None:
            keep["top"] = (states, hidden, p, pooled)
        return pooled @ self.w["o"] + self.w["c"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy of windows with inputs x, to the weights and (as "x") to the inputs."""
        h, keep = HIDDEN, {}
        n, t, _ = x.shape
        logit = self.run(self.projected(x.reshape(n * t, -1)).reshape(n, t, -1), mask, keep)
        states, hidden, p, pooled = keep["top"]
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.w["o"]
        dp = np.einsum("nh,nth->nt", dpool, states)
        ds = p[:, :, None] * dpool[:, None]
        de = p * (dp - (p * dp).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", de, hidden)
        dh = de[:, :, None] * self.w["v"] * (1 - hidden**2)
        g["A"] = np.einsum("nth,nta->ha", states, dh)
        ds += dh @ self.w["A"].T
        g["x"] = np.zeros((n * t, x.shape[2]), np.float32)
        for k, name in enumerate("fb"):
            u = self.w[f"U{name}"]
            back, da, du = np.zeros((n, h), np.float32), np.zeros((n, t, 3 * h), np.float32), np.zeros_like(u)
            for i in range(t - 1, -1, -1) if k == 0 else range(t):
                now, z, reset, c, rc = keep[name, i]
                up = back + ds[:, i, h * k : h * (k + 1)]
                m = mask[:, i, None]
                dz = -up * m * (c - now) * z * (1 - z)
                dc = up * m * (1 - z) * (1 - c**2)
                dr = dc * rc * reset * (1 - reset)
                da[:, i] = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * reset], axis=1)
                du += now.T @ rec
                back = up * (1 - m * (1 - z)) + rec @ u.T
            g[f"U{name}"] = du
            g[f"W{name}"] = x.reshape(n * t, -1).T @ da.reshape(n * t, -1)
            g[f"b{name}"] = da.sum(axis=(0, 1))
            g["x"] += da.reshape(n * t, -1) @ self.w[f"W{name}"].T
        return g


def windows(count: int) -> list[int]:
    """Where the windows of a text of so many words start; the last one reaches its end."""
    return list(range(0, max(1, count - (WINDOW - STRIDE)), STRIDE)) if count else []


def _untrained(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    w = {}
    for d in "fb":
        w |= {f"W{d}": rng.normal(0, 0.3, (INPUTS, 3 * h)), f"U{d}": rng.normal(0, 0.3, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
    w |= {k: rng.normal(0, 0.1, (1 << EMBED_BITS, EMBED)) for k in ("word", "gram")}
    w |= {"A": rng.normal(0, 0.3, (2 * h, ATTEND)), "v": rng.normal(0, 0.5, ATTEND), "o": rng.normal(0, 0.5, 2 * h), "c": np.array([-1.0])}
    return {k: v.astype(np.float32) for k, v in w.items()}


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of runs that start there and have so many."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def train(texts: list[str | None], y: list[int], **options) -> Net:
    return train_batches(iter([[texts, y]]), **options)


def train_batches(batches: Iterator[list[list]], epochs: int = 12, batch: int = 128, rate: float = 0.01, clean: float = 2.0, seed: int = 7) -> Net:
    """batches: of texts and labels. clean: what clean texts weigh together where toxic ones weigh 1, so that clean
    texts are left alone."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    docs: list[np.ndarray] = []
    y: list[int] = []
    for texts, marks in batches:
        y += marks
        for t in texts:
            ws = plain((t or "").encode("utf-8", "surrogatepass").split())
            docs.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)))
    labels, words = np.array(y, np.float32), list(number)
    net = Net(_untrained(rng), np.zeros((2, 1 << WORD_BITS), np.float32), np.zeros((2, 1 << GRAM_BITS), np.float32), (float(labels.sum()), float((1 - labels).sum())))
    if not len(words) or not 0 < labels.sum() < len(labels):
        net.w = {}
        return net
    found = [[x.astype(np.int32) for x in hashed(words[i : i + 10_000])] for i in range(0, len(words), 10_000)]
    b, grams, counts = (np.concatenate([f.pop(0) for f in found]) for _ in range(3))
    number.clear()
    begin = np.cumsum(counts, dtype=np.int64) - counts
    for p, k in zip(docs, labels):
        own = np.unique(p)
        side = 0 if k else 1
        net.word[side, np.unique(b[own])] += 1
        net.gram[side, np.unique(grams[_spread(begin[own], counts[own])])] += 1
    parts = [np.arange(i, min(len(words), i + 10_000)) for i in range(0, len(words), 10_000)]
    hashes = lambda u: (b[u], grams[_spread(begin[u], counts[u])], counts[u])
    table = np.stack([np.concatenate([net.counted(*hashes(u), left) for u in parts]) for left in ((0, 1), (1, 0))])  # by label
    size = np.array([len(p) for p in docs])
    flat = np.concatenate(docs)
    per = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    of = np.repeat(np.arange(len(docs)), per)
    nth = _spread(np.zeros(len(docs), np.int64), per)
    at = np.repeat(np.cumsum(size) - size, per) + nth * STRIDE
    left = np.minimum(np.repeat(size, per) - nth * STRIDE, WINDOW)
    slots = lambda k: flat[np.minimum(at[k][:, None] + np.arange(WINDOW), len(flat) - 1)]
    masks = lambda k: (np.arange(WINDOW) < left[k][:, None]).astype(np.float32)
    side = labels[of].astype(np.int64)
    weight = np.where(labels == 1, 1 / labels.sum(), clean / (1 - labels).sum()).astype(np.float32)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, low = 0, (1 << EMBED_BITS) - 1
    first = (np.cumsum(per) - per)[per > 0]
    blocks = [np.arange(i, min(len(of), i + BLOCK)) for i in range(0, len(of), BLOCK)]
    for epoch in range(epochs):
        if epoch == 0:  # the window with the most telling word
            worst = np.concatenate([np.where(masks(k) > 0, table[side[k][:, None], slots(k), 0], -9).max(axis=1) for k in blocks])
        else:
            worst = np.empty(len(of), np.float32)
            for s in (0, 1):
                ready = np.concatenate([net.projected(np.concatenate([table[s, u], net.embedded(*hashes(u))], axis=1)) for u in parts])
                own = np.flatnonzero(side == s)
                for k in (own[i : i + BLOCK] for i in range(0, len(own), BLOCK)):
                    worst[k] = net.run(ready[slots(k)], masks(k))
        order = np.lexsort((-worst, of))
        picks = order[first]
        for k in (1, 2):  # of clean texts two more
            more = order[np.minimum(first + k, len(of) - 1)]
            picks = np.concatenate([picks, more[(of[more] == of[first]) & (labels[of[more]] == 0)]])
        rng.shuffle(picks)
        for i in range(0, len(picks), batch):
            k = picks[i : i + batch]
            own, inverse = np.unique(slots(k), return_inverse=True)
            inverse = inverse.reshape(len(k), WINDOW)
            word, gram, n = hashes(own)
            x = np.concatenate([table[side[k][:, None], own[inverse]], net.embedded(word, gram, n)[inverse]], axis=2)
            g = net.gradients(x, masks(k), labels[of[k]], weight[of[k]])
            back = np.zeros((len(own), 2 * EMBED), np.float32)
            np.add.at(back, inverse.ravel(), g.pop("x")[:, COUNTED:])
            g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(g["word"], word & low, back[:, :EMBED])
            np.add.at(g["gram"], gram & low, np.repeat(back[:, EMBED:] / n[:, None], n, axis=0))
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = v * min(1.0, 1 / max(norm, 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * v
                square[name] = 0.99 * square[name] + 0.01 * v * v
                net.w[name] = net.w[name] - rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", usable: Column | None = None, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Net:
    sample = labelled_sample(docs, labels, label_col, F.lit(True) if usable is None else usable, rows, id_col, text_col)
    return pickle.loads(train_in_one_task(sample, lambda batches: pickle.dumps(train_batches((c[1], c[2]) for c in batches))))


def _judge(docs: DataFrame, net: Net) -> Callable[[list], tuple[list, list]]:
    """What gives texts their scores, and the number of the first word of the worst window."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # its size is bounded by buckets and weights
    table: list[WordTable] = []

    def judge(texts: list) -> tuple[list, list]:
        model = sent.value
        if not model.w:
            return [0.0] * len(texts), [-1] * len(texts)
        if not table:
            table.append(WordTable(lambda ws: model.projected(model.inputs(plain(ws))), HELD_WORDS))
        scores, places = [], []
        for a, b in chunks_of(texts, LOOKED_UP):
            at, counts = table[0].look_up(texts[a:b])
            per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
            of = np.repeat(np.arange(b - a), per)
            nth = _spread(np.zeros(b - a, np.int64), per)
            start = np.repeat(np.cumsum(counts) - counts, per) + nth * STRIDE
            left = np.minimum(np.repeat(counts, per) - nth * STRIDE, WINDOW)
            logit = np.zeros(len(of), np.float32)
            for i in range(0, len(of), RUN):
                mask = np.arange(WINDOW) < left[i : i + RUN, None]
                slots = np.minimum(start[i : i + RUN, None] + np.arange(WINDOW), len(at) - 1)
                logit[i : i + RUN] = model.run(table[0].rows[at[slots]], mask.astype(np.float32))
            order = np.lexsort((-logit, of))
            first = order[(np.cumsum(per) - per)[per > 0]] if len(order) else order
            best, place = np.zeros(b - a), np.full(b - a, -1)
            best[of[first]], place[of[first]] = _sigmoid(logit[first].astype(np.float64)), nth[first] * STRIDE
            scores += best.tolist()
            places += place.tolist()
        return scores, places

    return judge


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst_word): the probability of the most toxic window, and the number of its first word (-1: none)."""
    judge = _judge(docs, net)
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), lambda cols: [cols[0], *judge(cols[1])], f"id {kind}, score double, worst_word long")
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, net: Net, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less, with their columns as they are; each is judged where it is read."""
    judge = _judge(docs, net)
    return kept_batches(docs, text_col, lambda texts: [x < least for x in judge(texts)[0]])


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0
