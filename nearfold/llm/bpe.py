"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a byte string has one valid last token: the one whose
predecessor is the valid last token of the prefix before it and which the merge
ranks would leave beside that predecessor. Storing it for each prefix gives the
encoding by walking back, lets bytes be appended without touching what is there
and lets an edit be encoded again only around the edit (PrefixTable). Whether
two tokens may stand side by side is decided by undoing their merges from the
seam outwards (Merges.beside).

Texts are cut by the pattern first. Cuts at a single space between two other
characters never lie within a match, so texts are cut there cheaply and each
distinct part is encoded once per worker, up to a bound of remembered parts.
The new pieces of many texts are encoded together: one step gives the prefixes
of one length of all of them their last tokens (Merges.encode_many).

Defined results: a null text is empty; an empty text has no ids. Null ids,
repeated rows and very long texts are like any other. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
from itertools import chain, filterfalse

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, map_batches

#: Longer pieces are encoded one by one; of so many characters of texts the new pieces are encoded together.
LONGEST, TOGETHER = 64, 2_000_000
#: Bits of the number of pairs of tokens that are remembered.
PAIR_BITS = 20

#: Unicode white space, as the regular expressions of the token library see it.
SPACE = "\t-\r \x85\xa0  -     　"
_OTHERS = "\t\n\v\f\r\x85\xa0                　"


class Merges:
    """The ranks of a vocabulary, the last merge of each token, and which tokens may be neighbours."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict(sorted((r, t) for t, r in self.rank.items()))
        self.size = {r: len(t) for r, t in self.token.items()}
        self.longest = max(self.size.values())
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.seen: dict[tuple[int, int], bool] = {}
        for r, t in self.token.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i], r), self.rank.get(t[i:], r)
                if a < r and b < r and self._beside(a, b):
                    self.parts[r], self.merged[a, b] = (a, b), r
                    break
        self.finder = ahocorasick.Automaton()
        for r, t in self.token.items():
            self.finder.add_word(t.decode("latin-1"), r)
        self.finder.make_automaton()
        self._tables()

    def _tables(self) -> None:
        """The trie of tokens with its suffix links, and the merges, as arrays."""
        edges, ends, fail, first = {}, [-1], [0], [-1]
        size = max(self.token) + 1
        self.shorter = np.full(size, -1, np.int64)  # the longest token that ends a token
        longer = [(t, r, 0, 0) for t, r in self.rank.items()]  # token, rank, state, and how many bytes led there
        while longer:  # by depth, so that what a link leads to is there
            new = {}
            for t, _, at, n in longer:
                key = at << 8 | t[n]
                if key not in edges:
                    edges[key] = new[key] = len(ends)
                    ends.append(-1)
            longer = [(t, r, edges[at << 8 | t[n]], n + 1) for t, r, at, n in longer]
            for t, r, at, n in longer:
                if n == len(t):
                    ends[at] = r
            for key, to in new.items():
                at, c = key >> 8, key & 255
                link = 0
                while at and not link:
                    at = fail[at]
                    link = edges.get(at << 8 | c, 0)
                fail.append(link)
                first.append(ends[to] if ends[to] >= 0 else first[link])
                if ends[to] >= 0:
                    self.shorter[ends[to]] = first[link]
            longer = [x for x in longer if x[3] < len(x[0])]
        order = sorted(edges)
        self.edge_keys, self.edge_to = np.array(order, np.int64), np.array([edges[k] for k in order], np.int64)
        self.fail, self.first = np.array(fail, np.int64), np.array(first, np.int64)
        self.sizes, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        self.sizes[list(self.size)] = list(self.size.values())
        for r, (a, b) in self.parts.items():
            self.left[r], self.right[r] = a, b
        order = sorted((a * size + b, r) for (a, b), r in self.merged.items())
        self.merge_keys, self.merge_to = (np.array([x[k] for x in order] or [-1], np.int64) for k in (0, 1))
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)  # twice the key of a pair, plus one if it may stand so

    def _beside(self, a: int, b: int) -> bool:
        """Undo the later of the two seam tokens' merges, again and again; a merge across the seam that ranks
        before all that was undone would have come first, so the two can't be neighbours."""
        undone = 1 << 60
        while True:
            if self.merged.get((a, b), undone) < undone:
                return False
            left = a > b
            undone = a if left else b + 1  # of equal ranks the left merge comes first
            own = self.parts.get(a if left else b)
            if own is None:  # a single byte; go on with the other side
                left = not left
                undone = a if left else b + 1
                own = self.parts.get(a if left else b)
                if own is None:
                    return True
            if left:
                a = own[1]
            else:
                b = own[0]

    def beside(self, a: int, b: int) -> bool:
        known = self.seen.get((a, b))
        if known is None:
            if len(self.seen) > 1_000_000:
                self.seen = {}
            known = self.seen[a, b] = self._beside(a, b)
        return known

    def _beside_each(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_beside() of pairs."""
        out, todo = np.zeros(len(a), bool), np.arange(len(a))
        undone = np.full(len(a), 1 << 60)
        while len(todo):
            key = a * len(self.sizes) + b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            on = (self.merge_keys[at] != key) | (self.merge_to[at] >= undone)
            todo, a, b = todo[on], a[on], b[on]
            left = a > b
            left ^= self.left[np.where(left, a, b)] < 0  # a single byte; go on with the other side
            undone = np.where(left, a, b + 1)
            on = self.left[np.where(left, a, b)] >= 0
            out[todo[~on]] = True
            todo, a, b, left, undone = todo[on], a[on], b[on], left[on], undone[on]
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return out

    def beside_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """beside() of many pairs; of pairs that fall into one place of the memory the last is remembered."""
        key = a * len(self.sizes) + b
        place = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.pairs[place(key)]
        out, new = (known & 1).astype(bool), np.flatnonzero(known >> 1 != key)
        if len(new):
            keys, of = np.unique(key[new], return_inverse=True)
            got = self._beside_each(keys // len(self.sizes), keys % len(self.sizes))
            out[new] = got[of]
            self.pairs[place(keys)] = 2 * keys + got
        return out

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pieces in turn, how many each has): the last tokens of the prefixes of one length of all pieces at a time."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin, falling = (np.cumsum(sizes) - sizes)[order], -sizes[order]
        last, state = np.full(len(data), -1, np.int64), np.zeros(len(pieces), np.int64)
        for end in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(falling, -end))  # pieces that reach as far
            todo, s, c = np.arange(n), state[:n].copy(), data[begin[:n] + end]
            state[:n] = 0
            while len(todo):  # along the suffix links to a state that goes on with this byte
                key = s << 8 | c
                at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                goes = self.edge_keys[at] == key
                state[todo[goes]] = self.edge_to[at[goes]]
                on = ~goes & (s > 0)
                todo, s, c = todo[on], self.fail[s[on]], c[on]
            todo, t = np.arange(n), self.first[state[:n]]
            while len(todo):  # the longest token first
                start = begin[todo] + end + 1 - self.sizes[t]
                valid = start == begin[todo]
                inner = np.flatnonzero(~valid)
                valid[inner] = self.beside_many(last[start[inner] - 1], t[inner])
                last[begin[todo[valid]] + end] = t[valid]
                todo, t = todo[~valid], self.shorter[t[~valid]]
        of, left = np.flatnonzero(sizes), sizes[sizes > 0]
        begin, steps = np.cumsum(sizes) - sizes, [(np.zeros(0, np.int64),) * 2]
        while len(of):
            t = last[begin[of] + left - 1]
            steps.append((of, t))
            left = left - self.sizes[t]
            of, left = of[left > 0], left[left > 0]
        of, ids = (np.concatenate([x[k] for x in steps[::-1]]) for k in (0, 1))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(pieces))

    def last_tokens(self, data: str, before: list[int] | None = None) -> list[int]:
        """The valid last token of each prefix of data (bytes as latin-1), given those of its first prefixes."""
        last = list(before or [])
        known = len(last)
        skip = max(0, known - self.longest)  # no token that ends later starts before
        last += [-1] * (len(data) - known)
        size, beside = self.size, self.beside
        for end, t in self.finder.iter(data[skip:]):
            end += skip
            if end >= known and last[end] < 0:
                start = end - size[t]
                if start < 0 or beside(last[start], t):
                    last[end] = t
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at >= 0:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        one = self.rank.get(piece)
        return [one] if one is not None else self.walk(self.last_tokens(piece.decode("latin-1")))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """One byte string under edits, with the last token of each of its prefixes."""

    def __init__(self, merges: Merges, data: bytes = b""):
        self.merges, self.data = merges, data.decode("latin-1")
        self.last = merges.last_tokens(self.data)

    def ids(self) -> list[int]:
        return self.merges.walk(self.last)

    def append(self, more: bytes) -> None:
        self.data += more.decode("latin-1")
        self.last = self.merges.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Encode again from the edit on, until as many prefixes as the longest token has bytes agree with before."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new.decode("latin-1") + self.data[end:]
        last, at = old[:start], start
        while at < len(self.data):
            at = min(len(self.data), max(at, start + len(new)) + 4 * self.merges.longest)
            last = self.merges.last_tokens(self.data[:at], last)
            same = range(max(start + len(new), at - self.merges.longest), at)
            if len(same) == self.merges.longest and all(last[k] == old[k - shift] for k in same):
                last += old[at - shift :]
                break
        self.last = last


class TextCoder:
    """Encodes texts to decimal ids joined by a space, and decodes them."""

    def __init__(self, path: str, pattern: str, most: int = 250_000):
        import regex

        self.merges, self.most = Merges(path), most
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        self.bytes_of = {str(r): t for r, t in self.merges.token.items()}
        size = max(self.merges.token) + 1
        self.texts = [" " + str(r) for r in range(size)] + [f"\n{r}" for r in range(size)]  # of ids within a piece, and of its first
        self.pieces: dict[str, str] = {}
        self.first: dict[str, str] = {}  # parts of a text after a cut lack their space here
        self.inner: dict[str, str] = {}

    def _learn(self, new: set[str]) -> None:
        """Add the ids of new pieces."""
        pieces = list(new)
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        short = [(p, x) for p, x in zip(pieces, data) if len(x) <= LONGEST]
        for p, x in zip(pieces, data):
            if len(x) > LONGEST:
                self.pieces[p] = " ".join(map(str, self.merges.encode(x)))
        ids, counts = self.merges.encode_many([x for _, x in short])
        first = np.zeros(len(ids), np.int64)
        first[(np.cumsum(counts) - counts)] = len(self.texts) // 2
        joined = "".join(map(self.texts.__getitem__, (ids + first).tolist()))
        self.pieces.update(zip((p for p, _ in short), joined.split("\n")[1:]))

    def encode(self, text: str) -> str:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[str]:
        """The ids of each text."""
        if max(len(self.pieces), len(self.inner), len(self.first)) > self.most:
            self.pieces, self.first, self.inner = {}, {}, {}
        inner, first, find = self.inner, self.first, self.find
        cut = [None if self._odd(t) else t.split(" ") for t in texts]  # the parts of a text, each but the first after a space
        own = [find(t) if parts is None else None for t, parts in zip(texts, cut)]
        starts = {p[0]: find(p[0]) for p in cut if p and p[0] not in first}
        rest = set(filterfalse(inner.__contains__, chain.from_iterable(p[1:] for p in cut if p)))
        plain = [p for p in rest if p.isascii() and p.isalpha()]  # one match each
        others = {p: find(" " + p) for p in rest.difference(plain)}
        new = set(map(" ".__add__, plain))
        new.update(chain.from_iterable(chain(starts.values(), others.values(), filter(None, own))))
        self._learn(set(filterfalse(self.pieces.__contains__, new)))
        piece = self.pieces.__getitem__
        first.update((p, " ".join(map(piece, found))) for p, found in starts.items())
        inner.update(zip(plain, map(piece, map(" ".__add__, plain))))
        inner.update((p, " ".join(map(piece, found))) for p, found in others.items())
        each = inner.__getitem__
        return [" ".join(map(piece, found)) if parts is None else " ".join([first[parts[0]], *map(each, parts[1:])]) for parts, found in zip(cut, own)]

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether a space may not be cut at in this way, or there is nothing."""
        return not text or text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (" " + c in text or c + " " in text or text[0] == c or text[-1] == c) for c in _OTHERS)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


_coders: dict[tuple[str, str], TextCoder] = {}


def _coder(path: str, pattern: str) -> TextCoder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = TextCoder(path, pattern)
    return _coders[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded): ids in decimal joined by a space; decoded: the bytes those ids stand for."""

    def run(cols: list[list]) -> list:
        coder = _coder(ranks, pattern)
        texts = [t or "" for t in cols[1]]
        ids = [x for a, b in chunks_of(texts, TOGETHER) for x in coder.encode_all(texts[a:b])]
        return [cols[0], [x.count(" ") + 1 if x else 0 for x in ids], ids, [coder.decode(x) for x in ids]]

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, n_tokens long, ids string, decoded binary")
    return out.withColumnRenamed("id", id_col)


def decoded(encodings: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of each row's ids (decimal, joined by a space; null: none)."""

    def run(cols: list[list]) -> list:
        coder = _coder(ranks, pattern)
        return [cols[0], [coder.decode(x or "") for x in cols[1]]]

    kind = encodings.schema[id_col].dataType.simpleString()
    out = map_batches(encodings.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, decoded binary")
    return out.withColumnRenamed("id", id_col)
