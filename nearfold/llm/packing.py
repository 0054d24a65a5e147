"""Best-fit packing of tokenised documents under several capacities.

A piece asks for a vector: its tokens, one document, and its attention cost
(tokens squared). A sequence has a capacity for each. Lengths in descending
order, each goes to the open sequence that best fits under every constraint:
by the least weighted norm of what is left, or by the largest weighted dot
product of demand and rest; the chosen one takes as many of that length as it
can. A piece's vector follows from its length, so the plan is made from the
histogram of lengths (as many classes as a sequence has tokens, at most) over
runs of alike sequences: its size doesn't grow with the input. Pieces then take
the planned places by their rank within their length; ranks come from chunks
of about CHUNK pieces, dealt by row and not by id, and running sums over blocks
of chunks and over the chunks of a block, never from one task.

Defined results: a null or empty text is the end id alone. Null ids and
repeated rows are packed like any other row. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from itertools import chain, compress, islice, repeat
from operator import not_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import chunks_of, cut, hold, map_batches
from .words import Numbers

#: Pieces whose ranks are made together, and chunks whose sums are.
CHUNK = 2000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: ASCII punctuation but the apostrophe, which may begin a match with letters.
_AROUND = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: The bytes of the letters from U+00C0 to U+00FF; in words without other bytes beyond ASCII the table lowers them.
_LATIN = b"\xc3" + bytes(n for n in range(0x80, 0xC0) if n not in (0x97, 0xB7))
_LATIN_LOWER = bytes.maketrans(bytes(n for n in range(0x80, 0x9F) if n != 0x97), bytes(n + 32 for n in range(0x80, 0x9F) if n != 0x97))
#: Letters and digits as a, ASCII white space as it is, all else as a point.
_KINDS = bytes(c if c in b" \t\n\v\f\r" else 97 if chr(c).isalnum() and c < 128 or c in _LATIN else 46 for c in range(256))
#: Words of more bytes aren't merged many at once.
LONGEST = 40


class Merges:
    """Byte-pair merges of many words at once, the lowest rank and then the leftmost pair first in each.

    Words as long as each other are rows of one matrix. A merge takes one symbol
    from a row, so rows go on with the words that are shorter by one; a row
    without a pair to merge is done. Pairs are looked up in a hash table.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str, vocabulary: dict[str, int]):
        import json

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as they are
        others = [n for n in range(256) if n not in set(printed)]
        chars = {n: chr(n) for n in printed} | {n: chr(256 + k) for k, n in enumerate(others)}
        self.first, self.last = (np.array([vocabulary[chars[n] + end] for n in range(256)], np.int32) for end in ("", "</w>"))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocabulary[x + y] for x, y in pairs], np.int32)
        keys = np.array([vocabulary[x] << 32 | vocabulary[y] for x, y in pairs], np.int64)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & self.mask
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (x, y), NONE where they don't merge."""
        keys = x.astype(np.int64) << 32 | y
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        open_ = np.nonzero((found != keys) & (found >= 0))
        at, keys = at[open_], keys[open_]
        while len(keys):
            at = (at + 1) & self.mask
            found = self.keys[at]
            out[open_] = np.where(found == keys, self.ranks[at], self.NONE)
            more = (found != keys) & (found >= 0)
            open_, at, keys = tuple(o[more] for o in open_), at[more], keys[more]
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in turn, ids in each); no word is empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start, by_size = np.cumsum(size) - size, np.argsort(size, kind="stable")
        longest = int(size.max(initial=0))
        bounds = np.searchsorted(size[by_size], np.arange(longest + 2))
        rows, done = np.zeros(0, np.int64), []
        sym, ranks = np.zeros((0, longest), np.int32), np.zeros((0, max(0, longest - 1)), np.int32)
        for n in range(longest, 0, -1):
            fresh = by_size[bounds[n] : bounds[n + 1]]
            own = data[start[fresh][:, None] + np.arange(n)]
            added = self.first[own]
            added[:, -1] = self.last[own[:, -1]]
            rows, sym = np.concatenate([rows, fresh]), np.concatenate([sym, added])
            if n == 1:
                done.append((rows, sym))
                break
            ranks = np.concatenate([ranks, self.rank(added[:, :-1], added[:, 1:])])
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best < self.NONE
            done.append((rows[~go], sym[~go]))
            rows, sym, ranks, at, best = rows[go], sym[go], ranks[go], at[go], best[go]
            i = np.arange(len(rows))
            sym[i, at] = self.made[best]
            keep = np.ones(sym.shape, bool)
            keep[i, at + 1] = False
            sym = sym[keep].reshape(len(rows), n - 1)
            keep = np.ones(ranks.shape, bool)
            keep[i, at] = False
            ranks = ranks[keep].reshape(len(rows), n - 2)
            for some, left in ((at > 0, at - 1), (at < n - 2, at)):  # the pairs on both sides of what was made
                r, c = i[some], left[some]
                ranks[r, c] = self.rank(sym[r, c], sym[r, c + 1])
        sizes = np.zeros(len(words), np.int64)
        for r, m in done:
            sizes[r] = m.shape[1]
        begins, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), "<u4")
        for r, m in done:
            out[begins[r][:, None] + np.arange(m.shape[1])] = m
        return out, sizes


class WordIds:
    """Ids of a text, by a dictionary of its white-space separated words.

    The tokenizer drops white space and no match spans it, so the ids of a text
    are those of its words in turn. Only the six ASCII white-space characters
    separate here; others stay within a word for the tokenizer to handle. It
    also lowers case, as is done to ASCII here, and a run of punctuation beside a letter or digit is a
    match of its own, so a new word is looked up by its parts: the lower-case
    core and what surrounds it. New cores of Latin-1 letters are one match each
    and are merged many at once (Merges); other letters go to the tokenizer many
    at once, each ending with a token that ends a word. A text that may hold one
    of the tokenizer's added tokens goes to it whole. Words are numbers, and
    their ids stand in one array. When there are more than `most` words, those
    seen once are dropped, and others beyond half of `most`.
    """

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.merges = Merges(path, vocabulary)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.number, self.ids = Numbers(), np.zeros(0, "<u4")
        self.starts, self.sizes, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def _thin(self) -> None:
        """Keep the words seen more than once, half of `most` at most."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
        words = list(self.number)
        self.number = Numbers((words[i], k) for k, i in enumerate(kept.tolist()))
        self.ids = _gather(self.ids, self.starts[kept], self.sizes[kept])
        self.sizes, self.uses = self.sizes[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _by_tokenizer(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, as bytes."""
        plain, rest, own = [], [], {}
        for p in parts:
            t = p.decode("utf-8", "replace")
            (plain if t.isalpha() else rest).append((p, t))
        groups = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(t for _, t in g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            last = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(last) == len(some):
                data = ids.tobytes()
                for (p, _), a, b in zip(some, [0, *last], last):
                    own[p] = data[a:b]
            else:  # not one match each
                rest += some
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for (p, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                own[p] = array("I", e.ids).tobytes()
        return [own[p] for p in parts]

    def _learn(self, new: list[bytes]) -> None:
        """Add the ids of new words, which have the next numbers."""
        known, number = len(self.starts), self.number
        letters = lambda ws: b" ".join(ws).translate(None, _LATIN).split(b" ")
        lows, whole = list(new), [not x or x.isalnum() for x in letters(new)]
        cut, of = [], []  # words with punctuation around them, and three parts of each
        for k in compress(range(len(lows)), map(not_, whole)):
            low = lows[k]
            core = low.strip(_AROUND)
            q = core.translate(None, _LATIN)
            if not q.isalnum() and (q or not core):
                t = core.decode("utf-8", "replace").lower()  # some letters become a letter and a mark
                if not (t and t[0].isalnum() and t[-1].isalnum()):
                    continue
            if len(core) < len(low):
                cut.append(k)
                of += low.partition(core)
                of[-2], lows[k] = core, b""
        parts = dict.fromkeys(chain(lows, of))
        parts = dict(zip(parts, range(len(parts))))
        starts, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        n = np.fromiter(map(number.get, parts, repeat(known)), np.int64, len(parts))
        n[parts.get(b"", [])] = -1
        old = np.flatnonzero((n >= 0) & (n < known))
        starts[old], sizes[old] = self.starts[n[old]], self.sizes[n[old]]
        unknown = list(compress(parts, (n >= known).tolist()))
        alike = [(not x or x.isalpha()) and len(p) <= LONGEST for x, p in zip(letters(unknown), unknown)]
        names, rest = list(compress(unknown, alike)), list(compress(unknown, map(not_, alike)))
        plain, others = (np.fromiter(map(parts.__getitem__, ps), np.int64, len(ps)) for ps in (names, rest))
        if names:
            names = b" ".join(names).translate(_LATIN_LOWER).split(b" ")
        ids, n = self.merges(names)
        starts[plain], sizes[plain] = len(self.ids) + np.cumsum(n) - n, n
        got = self._by_tokenizer(rest)
        n = np.array([len(x) // 4 for x in got], np.int64)
        starts[others], sizes[others] = len(self.ids) + len(ids) + np.cumsum(n) - n, n
        self.ids = np.concatenate([self.ids, ids, np.frombuffer(b"".join(got), "<u4")])
        single = np.fromiter(map(parts.__getitem__, lows), np.int64, len(lows))
        own, n = starts[single], sizes[single]
        if cut:
            k, of = np.array(cut), np.fromiter(map(parts.__getitem__, of), np.int64, len(of)).reshape(-1, 3)
            n[k] = sizes[of].sum(axis=1)
            own[k] = len(self.ids) + np.cumsum(n[k]) - n[k]
            self.ids = np.concatenate([self.ids, _gather(self.ids, starts[of].ravel(), sizes[of].ravel())])
        self.starts, self.sizes = np.concatenate([self.starts, own]), np.concatenate([self.sizes, n])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _special(self, text: str | None) -> bool:
        """Whether an added token may stand in the text, in any case."""
        return bool(text) and "|" in text and any(t in text.lower() for t in self.added)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit numbers."""
        if len(self.number) > self.most:
            self._thin()
        whole = {i for i, t in enumerate(texts) if self._special(t)}
        words = [[] if i in whole else _words(t or "") for i, t in enumerate(texts)]
        counts, known = np.fromiter(map(len, words), np.int64, len(words)), len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int32, int(counts.sum()))
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        self.uses += np.bincount(at, minlength=len(self.uses))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        data, ends = _gather(self.ids, self.starts[at], sizes).tobytes(), (4 * ends).tolist()
        out = [data[a:b] for a, b in zip(ends, ends[1:])]
        for i in whole:
            out[i] = array("I", self.tokenizer.encode(texts[i], add_special_tokens=False).ids).tobytes()
        return out


def _words(text: str) -> list[bytes]:
    """The words of a text in lower case. Where each run of punctuation is one character and letters are Latin-1, points and commas stand alone."""
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if low.translate(None, _LATIN).isascii() and b".." not in low.translate(_KINDS):
        low = low.replace(b".", b" . ").replace(b",", b" , ")
    return low.split()


def _gather(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids with these starts and sizes, one after the other."""
    before = np.cumsum(sizes) - sizes
    return ids[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


_coders: dict[str, WordIds] = {}
hold("words", _coders.clear)


def _coder(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): tokenised documents, cut where longer than a sequence."""
    end = np.array([end_id], "<u4").tobytes()

    def run(cols: list[list]) -> list:
        out: list[list] = [[] for _ in range(5 + with_ids)]
        for a, b in chunks_of(cols[1], 2_000_000):
            for i, ids in zip(cols[0][a:b], _coder(tokenizer).encode(cols[1][a:b])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row = [i, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    for o, x in zip(out, [*row, np.frombuffer(part, "<u4").tolist()] if with_ids else row):
                        o.append(x)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, schema, held="words")


def plan(counts: dict[int, int], capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset), for pieces of each length in order of rank."""
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    left, runs = np.zeros((0, 3)), np.zeros((0, 2), np.int64)  # rest of each run of alike sequences; its first sequence and how many
    out, used = [], 0
    smallest = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        ask, n, rank = np.array([length, 1.0, float(length) ** 2]), counts[length], 0
        most = int(min(cap // ask))
        if most < 1:
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {capacity}")
        while n:
            ok = np.flatnonzero((left >= ask).all(axis=1))
            if len(ok):
                rest = left[ok] / cap
                score = ((rest - ask / cap) ** 2) @ w if rule == "norm" else -(rest * (ask / cap)) @ w
                at = ok[np.argmin(score)]
                fit = int(min(left[at] // ask))
                first, many = runs[at]
            else:  # new sequences
                at, fit, first, many = -1, most, used, -(-n // most)
                used += many
            k, take = (fit, min(many, n // fit)) if n >= fit else (n, 1)
            room = left[at] if at >= 0 else cap
            out.append((length, rank, k, first, int(cap[0] - room[0])))
            rank, n = rank + k * take, n - k * take
            fresh = [(room - k * ask, (first, take))] + ([(room, (first + take, many - take))] if many > take else [])
            if at >= 0:
                left, runs = np.delete(left, at, 0), np.delete(runs, at, 0)
            fresh = [x for x in fresh if x[0][0] >= smallest]
            if fresh:
                left = np.vstack([left, [x[0] for x in fresh]])
                runs = np.vstack([runs, np.array([x[1] for x in fresh], np.int64)])
    return np.array(out, np.int64).reshape(-1, 5)


def pack(cuts: DataFrame, size: int = 2048, most_docs: int | None = None, most_attention: float | None = None,
         weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> DataFrame:
    """cuts with sequence_id and offset added. cuts: written pieces() with id, piece and length.

    By default a sequence holds as many documents and as much attention as its
    tokens allow: tokens alone bind, for as few sequences as can be, and the
    other two choose among sequences with equal room. Lower capacities bind.
    """
    spark = cuts.sparkSession
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # size classes at most
    table = plan(counts, (size, most_docs or size, most_attention or float(size) ** 2), weights, rule)
    chunks = spark.createDataFrame([(k, -(-n // CHUNK)) for k, n in counts.items()], "length long, chunks long")
    c = cuts.withColumn("row", F.monotonically_increasing_id())  # stays the same, as cuts are written
    c = c.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).drop("chunks")
    sums = cut(c.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("chunk") / CHUNK)))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sums.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", earlier(W.partitionBy("length").orderBy("block")).alias("start"))
    sums = sums.withColumn("inner", earlier(W.partitionBy("length", "block").orderBy("chunk"))).join(blocks, ["length", "block"])
    sums = sums.select(F.col("length").alias("_length"), F.col("chunk").alias("_chunk"), (F.col("start") + F.col("inner")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "chunk").orderBy("row"))
    c = c.withColumn("own", own - 1)
    c = c.join(sums, (c["length"] == sums["_length"]) & (c["chunk"] == sums["_chunk"])).withColumn("rank", F.col("before") + F.col("own"))
    key = table[:, 0] * (1 << 42) + table[:, 1]  # a length, then a rank
    order = np.argsort(key, kind="stable")
    key, table = key[order], table[order]

    def place(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
                row = table[np.searchsorted(key, length * (1 << 42) + rank, side="right") - 1]
                nth = rank - row[:, 1]
                sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = cuts.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema.fields)
    return c.select(*names, "rank").mapInArrow(place, fields + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """pieces() and pack() together."""
    return pack(cut(pieces(docs, tokenizer, size, id_col=id_col, text_col=text_col)), size, **options).withColumnRenamed("id", id_col)
