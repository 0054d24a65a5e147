"""Language identification with spans.

A word is a run between white space, cut where its script changes; scripts
that are written without spaces are cut every few characters. Each word has a
score for every language: the log-probability of its character trigrams,
learned from labelled texts. Unicode script ranges narrow the candidates first:
a word's script leaves only the languages that were seen to use it. Viterbi
decoding over the words of a text, with a penalty for each switch of language,
labels the spans; the text's language is the one with the most letters, its
score the share of letters it holds. Texts of any length are decoded in blocks
of BLOCK words at once, from each language a block may start in, so no step is
made for each word of a long text.

Learning takes at most FIT_ROWS labelled rows of each language (those of the
smallest hash of the id); the counts are made on the executors.

Defined results: letters are what Unicode calls so; `und` with score 0 for a
null text or one without a letter. If no learned language uses a text's
scripts, the one seen most with score 0.1. Without any labelled row every text
is `und`. Ties go to the alphabetically first language. Null ids and repeated
rows are kept and judged like others. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, chunks_of, fold, kept_batches, map_batches
from .words import WordTable, spaced, sums, trigram_buckets

FIT_ROWS = 1500
#: Words that are decoded together, and characters of a word in a script without spaces.
BLOCK, UNSPACED = 1024, 4
BITS = 15
#: First code point of a run of scripts, and the script (0: none in particular).
RANGES = [
    (0, 0), (0x41, 1), (0x250, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8),
    (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0),
    (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13), (0x30000, 0),
]
SCRIPTS = 1 + max(s for _, s in RANGES)
_STARTS = [a for a, _ in RANGES]
_CODES = [s for _, s in RANGES]
#: Of RANGES, the scripts written without spaces.
_WITHOUT_SPACES = {9, 12, 13}


def _pattern() -> re.Pattern:
    """Words of a text: neutral characters stay with the script that they stand beside."""
    space = "\x20\x09-\x0D"
    ends = [*_STARTS[1:], 0x110000]
    of = {n: "".join(f"\\U{a:08x}-\\U{z - 1:08x}" for a, z, s in zip(_STARTS, ends, _CODES) if s == n) for n in set(_CODES)}
    neutral = f"[^{space}{''.join(v for n, v in of.items() if n)}]"
    some = []
    for n, own in of.items():
        if n:
            rest = f"[^{space}{''.join(v for m, v in of.items() if m not in (0, n))}]"
            some.append(f"{neutral}*[{own}]{rest}" + (f"{{0,{UNSPACED - 1}}}" if n in _WITHOUT_SPACES else "*"))
    return re.compile("|".join([*some, f"{neutral}+"]))


_WORDS = _pattern()
_NOT_LETTERS = re.compile(r"[\W\d_]+")  # leaves letters and signs for numbers
_SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER = re.compile("[^\x00-\u024f\u1e00-\u1eff\u2000-\u206f]")


def split(text: str | None) -> list[bytes]:
    """The words of a text; one whose letters are all Latin needs no look at its scripts."""
    if not text or text.isascii() or not _OTHER.search(text):
        return spaced(text)
    return [w.encode("utf-8", "surrogatepass") for w in _WORDS.findall(text)]


def letters(word: bytes) -> str:
    t = _NOT_LETTERS.sub("", word.decode("utf-8", "replace").lower())
    return t if t.isalpha() else "".join(filter(str.isalpha, t))


def script(word: str) -> int:
    return _CODES[bisect_right(_STARTS, ord(word[0])) - 1] if word else 0


@dataclass
class Model:
    names: list[str]
    weight: np.ndarray  # log-probability of a trigram bucket in each language
    allowed: np.ndarray  # script x language
    usual: int
    penalty: float = 8.0

    def features(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: its score in each language, then its letters, then whether a learned language uses its script."""
        k = len(self.names)
        plain = [letters(w) for w in words]
        out = np.zeros((len(words), k + 2), np.float32)
        if not words:
            return out
        if not k:
            out[:, 0] = [len(w) for w in plain]
            return out
        buckets, counts = trigram_buckets(plain, BITS)
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        ok = self.allowed[np.fromiter(map(script, plain), np.int64, len(plain))]
        known = ok.any(axis=1) & (size > 0)
        scores = sums(self.weight[buckets], counts)
        out[:, :k] = np.where(known[:, None], np.where(ok, scores, scores.min(axis=1, keepdims=True) - 30), 0)
        out[:, k], out[:, k + 1] = size, known
        return out

    def label(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The language of each word, by Viterbi over every text; scores: words in turn, counts: words of each text.

        A text is a chain of blocks of at most BLOCK words. The words of a block that isn't the first are decoded from
        each language that may stand before it; all such runs of all texts step together, then each chain needs a
        step for each block.
        """
        k = scores.shape[1]
        blocks = -(-counts // BLOCK)
        nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(np.repeat(counts, blocks) - nth * BLOCK, BLOCK)
        begin = np.cumsum(size) - size
        runs = np.where(nth > 0, k, 1)
        first_run = np.cumsum(runs) - runs
        of = np.repeat(np.arange(len(size)), runs)  # the block of each run
        before = np.arange(len(of)) - first_run[of]
        value = np.where((nth[of] == 0)[:, None] | (before[:, None] == np.arange(k)), 0.0, -1e9)
        order = np.argsort(-size[of], kind="stable")
        count, at_word = size[of][order], begin[of][order]
        kept = np.cumsum(size[of]) - size[of]  # where the words of each run are noted
        at_note = kept[order]
        steps = int(count[0]) if len(count) else 0
        live = np.searchsorted(-count, -np.arange(steps), side="left")  # runs with more words than t
        came = np.zeros((int(size[of].sum()), k), np.int8 if k < 128 else np.int32)
        same = np.arange(k, dtype=came.dtype)
        now_value = value[order]
        for t, n in enumerate(live):
            v = now_value[:n]
            best = v.argmax(axis=1)
            switch = v[np.arange(n), best][:, None] - self.penalty
            came[at_note[:n] + t] = np.where(v >= switch, same, best[:, None])
            now_value[:n] = np.maximum(v, switch) + scores[at_word[:n] + t]
        value[order] = now_value
        entry, final = np.zeros(len(size), np.int64), value[first_run].argmax(axis=1) if len(size) else np.zeros(0, np.int64)
        for f, n in zip(np.flatnonzero(nth == 0), blocks[blocks > 0]):
            reach, back = value[first_run[f]], []
            for i in range(f + 1, f + n):
                way = reach[:, None] + value[first_run[i] : first_run[i] + k]
                back.append(way.argmax(axis=0))
                reach = way.max(axis=0)
                reach = reach - reach.max()
            now = int(reach.argmax())
            for i in range(f + n - 1, f, -1):
                final[i], now = now, int(back[i - f - 1][now])
                entry[i] = now
            final[f] = now
        path = np.zeros(len(scores), np.int64)
        order = np.argsort(-size, kind="stable")
        last, note = (begin + size)[order] - 1, (kept[first_run + entry] + size)[order] - 1
        now, live = final[order], np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        for t, n in enumerate(live):
            path[last[:n] - t] = now[:n]
            now[:n] = came[note[:n] - t, now[:n]]
        return path


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, penalty: float = 8.0) -> Model:
    """Learn from rows with a non-null language."""
    used = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).cast("string").alias(lang_col), F.col(text_col).cast("string").alias(text_col))
    used = bounded_rows(used, id_col, lang_col, rows, text_col)

    def count(cols: list[list]) -> list:
        total: dict[tuple[str, int], int] = {}
        for lang in set(cols[0]):
            for a, b in chunks_of(cols[1]):
                seen: dict[str, int] = {}
                for which, t in zip(cols[0][a:b], cols[1][a:b]):
                    if which == lang:
                        for w in split(t):
                            w = letters(w)
                            if w:
                                seen[w] = seen.get(w, 0) + 1
                words = list(seen)
                times = np.fromiter(seen.values(), np.int64, len(words))
                buckets, counts = trigram_buckets(words, BITS)
                n = np.bincount(buckets, np.repeat(times, counts), 1 << BITS).astype(np.int64)
                n = np.concatenate([n, np.bincount([script(w) for w in words], times, SCRIPTS).astype(np.int64)])
                for i in np.flatnonzero(n):
                    total[lang, int(i)] = total.get((lang, int(i)), 0) + int(n[i])
        return [[k[0] for k in total], [k[1] for k in total], list(total.values())]

    found = map_batches(used.select("group", "text"), count, "lang string, bucket int, n long")
    found = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # bounded by languages and buckets
    names = sorted({r["lang"] for r in found})
    table = np.zeros((len(names), (1 << BITS) + SCRIPTS))
    for r in found:
        table[names.index(r["lang"]), r["bucket"]] = r["n"]
    grams, scripts = table[:, : 1 << BITS], table[:, 1 << BITS :]
    p = (grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))
    share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    usual = int(scripts.sum(axis=1).argmax()) if names else 0
    return Model(names, np.log(p).T.astype(np.float32), (share >= 0.01).T, usual, penalty)


def spans_of(path: np.ndarray, text: str, names: list[str]) -> list[tuple[int, int, str]]:
    """(first character, character after the last, language) of each run of words of one language."""
    out: list[tuple[int, int, str]] = []
    for m, k in zip((_WORDS if _OTHER.search(text) else _SPACED).finditer(text), path):
        if out and out[-1][2] == names[k]:
            out[-1] = (out[-1][0], m.end(), names[k])
        else:
            out.append((m.start(), m.end(), names[k]))
    return out


def _judge(docs: DataFrame, model: Model, spans: bool = False) -> Callable[[list], list[list]]:
    """What gives texts their languages, scores and, if asked for, spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by buckets and languages
    table: list[WordTable] = []

    def judge(whole: list) -> list[list]:
        m = sent.value
        k = len(m.names)
        if not table:
            table.append(WordTable(m.features, 300_000, split))
        lang, score, found = [], [], []
        for a, b in chunks_of(whole, 2_000_000):
            texts = whole[a:b]
            at, counts = table[0].look_up(texts)
            rows = table[0].rows[at]
            path = m.label(rows[:, :k], counts) if k else np.zeros(len(at), np.int8)
            doc = np.repeat(np.arange(len(texts)), counts)
            size = rows[:, k] if len(rows) else np.zeros(0)
            known = size * rows[:, k + 1] if len(rows) else np.zeros(0)
            per = np.bincount(doc * max(k, 1) + path, known, len(texts) * max(k, 1)).reshape(len(texts), -1)
            every, of = np.bincount(doc, size, len(texts)), per.sum(axis=1)
            for n, (best, total, seen) in enumerate(zip(per.argmax(axis=1), every, of)):
                if not total or not k:
                    lang.append("und"), score.append(0.0)
                elif not seen:
                    lang.append(m.names[m.usual]), score.append(0.1)
                else:
                    lang.append(m.names[best]), score.append(float(per[n, best] / total))
            if spans:
                ends = np.cumsum(counts)
                found += [[dict(zip(("start", "end", "lang"), s)) for s in spans_of(path[e - c : e], t or "", m.names)] if k else [] for t, c, e in zip(texts, counts, ends)]
        return [lang, score] + ([found] if spans else [])

    return judge


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, lang_pred, score[, spans])."""
    judge = _judge(docs, model, spans)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), lambda cols: [cols[0], *judge(cols[1])], schema)
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.25, text_col: str = "text") -> DataFrame:
    """The rows of docs in a learned language with at least that score, with their columns as they are; each is judged where it is read."""
    judge = _judge(docs, model)
    return kept_batches(docs, text_col, lambda texts: [lang != "und" and x >= least for lang, x in zip(*judge(texts))])


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 5) == 0
