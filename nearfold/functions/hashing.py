"""Hashes that any SQL engine can repeat: a universal family over a Mersenne prime, and md5 orders for samples."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def hash_seeds(n: int = 128, seed: int = 42) -> list[tuple[int, int]]:
    """n distinct pairs (a, b) of the family (a * x + b) mod PRIME."""
    rng = random.Random(seed)
    out: dict[tuple[int, int], None] = {}
    while len(out) < n:
        out[rng.randrange(1, PRIME), rng.randrange(PRIME)] = None
    return list(out)


def text_element(c: Column) -> Column:
    """A string as an integer below PRIME."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % PRIME


def sample_order(c: Column, seed: int) -> Column:
    """An order that is the same in every engine and for every partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))
