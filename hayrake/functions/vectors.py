"""Vector functions over arrays, accumulated in doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in the order of the elements; the cosine of unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def pool(hidden: Column, mask: Column, how: str) -> Column:
    """One vector of the positions of array<array<number>>: mean, last_token or cls; mask tells which count.

    Without any position that counts, mean takes all and last_token the last.
    """
    marked = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m == 1, h)), lambda h: h.isNotNull())
    used = F.when(F.size(marked) > 0, marked).otherwise(hidden)
    if how == "cls":
        return F.element_at(hidden, 1)
    if how == "last_token":
        return F.element_at(used, -1)
    if how != "mean":
        raise ValueError(f"pooling {how!r} is not one of mean, last_token, cls")
    zero = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    total = F.aggregate(used, zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(used))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank) for ranks from 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def dead_fraction(live: Column, dead: Column) -> Column:
    return F.coalesce(F.try_divide(dead.cast("double"), (live + dead).cast("double")), F.lit(0.0))


#: The state's factor, and powers of it and of its inverse modulo 2 ** 64 for as many bytes as are walked at once.
_FACTOR, _BLOCK = 0x9E3779B97F4A7C15, 1 << 16


def _powers(x: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(_BLOCK, x, dtype=np.uint64))


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def hashed_vector(text: str, dims: int) -> np.ndarray:
    """A deterministic stand-in for an embedding: a 64-bit state walks over the bytes and adds a number to a place.

    state * factor + byte + place, for all bytes of a block at once: over the
    power of the factor, the states are a running sum.
    """
    data, state, out = np.frombuffer(text.encode(), dtype=np.uint8), np.uint64(0xC0FFEE), np.zeros(dims, dtype=np.float32)
    for start in range(0, len(data), _BLOCK):
        steps = data[start : start + _BLOCK] + np.arange(start, min(start + _BLOCK, len(data)), dtype=np.uint64)
        states = (np.cumsum(steps * _DOWN[: len(steps)], dtype=np.uint64) + state) * _UP[: len(steps)]
        state = states[-1]
        numbers = (states >> np.uint64(32)).astype(np.float32) / np.float32(0xFFFFFFFF) * np.float32(2) - np.float32(1)
        np.add.at(out, (states % np.uint64(dims)).astype(np.intp), numbers)  # one after the other, so sums round as in a loop
    if not out.any():
        out[0] = 1
    return (out / np.sqrt((out.astype(np.float64) ** 2).sum())).astype(np.float16).astype(np.float32)


def mock_embedding(dims: int) -> Column:
    """A pandas UDF of text that gives `hashed_vector`."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hashed_vector(t or "", dims))

    return embed
