"""White-space separated words of many texts as numbers, with features made once for each distinct word."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Numbers(dict):
    """Numbers for new keys in the order they are asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def spaced(text: str | None) -> list[bytes]:
    """The words of a text between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordTable:
    """Numbers words and keeps a row of features for each; emptied when it holds `most` words."""

    def __init__(self, features: Callable[[list], np.ndarray], most: int = 150_000, split: Callable[[str | None], list] = spaced):
        self.features, self.most, self.split, self.number, self.rows = features, most, split, Numbers(), None

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row of `rows` for each word of all texts in turn, words in each text)."""
        if len(self.number) > self.most:
            self.number, self.rows = Numbers(), None
        known = len(self.number)
        words = list(map(self.split, texts))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        get = self.number.__getitem__
        at = np.fromiter((n for ws in words for n in map(get, ws)), np.int32, int(counts.sum()))
        if len(self.number) > known or self.rows is None:
            new = list(self.number)[known:] if known else list(self.number)
            made = np.concatenate([self.features(new[i : i + 10_000]) for i in range(0, len(new), 10_000)]) if new else self.features([])
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
        return at, counts


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, each between a start and an end mark; where each word starts, with the end)."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def trigram_buckets(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each character trigram of the marked words in turn, trigrams of each word: its length, one at least)."""
    codes, starts = characters([w or " " for w in words])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = codes[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ codes[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)
    inside = np.ones(len(codes), bool)
    inside[starts[1:] - 1] = inside[starts[1:] - 2] = False
    return h[inside[:-2]].astype(np.int64), np.diff(starts) - 2


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; counts are positive."""
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) if len(counts) else np.zeros((0, *values.shape[1:]), values.dtype)
