"""Vectors as array columns: products, norms, blending, scores, and a hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from folium.functions.text import col, let

DIMENSION = 384


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """NULL if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x
    )


def l2_score(distance: Column) -> Column:
    """1 - d / 2: the cosine, for vectors of length one."""
    return F.lit(1.0) - distance / 2


def unit(a: Column | str) -> Column:
    scaled = lambda v, size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(F.lit(0.0)).cast("float"))
    return let(col(a), lambda v: let(norm(v), lambda size: scaled(v, size)))


def blend(text: Column | str, summary: Column | str, weight: float = 0.3) -> Column:
    """(1 - w) text + w summary, at length one."""
    mixed = F.zip_with(col(text), col(summary), lambda x, y: x.cast("double") * F.lit(1 - weight) + y.cast("double") * F.lit(weight))
    return unit(mixed)


#: Features of which a worker remembers the place; then it begins anew.
REMEMBERED = 300_000


class _Places(dict):
    """feature -> its place: below the dimension where it counts up, above where it counts down; hashed when first asked for."""

    def __init__(self, dimension: int):
        self.dimension = dimension

    def __missing__(self, feature: str) -> int:
        h = int.from_bytes(hashlib.md5(feature.encode("utf-8", "replace")).digest()[:8], "big")
        place = h % self.dimension + (0 if h >> 63 else self.dimension)
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = place
        return place


_PLACES: dict[int, _Places] = {}
_WORDS = re.compile(r"\w+")


def hash_embedding(text: str | None, dimension: int = DIMENSION) -> np.ndarray:
    """Signed feature hashing of words and word pairs, at length one; zeros for a text without words."""
    words = _WORDS.findall((text or "").lower())
    if not words:
        return np.zeros(dimension, np.float32)
    places = _PLACES.get(dimension) or _PLACES.setdefault(dimension, _Places(dimension))
    found = [places[w] for w in words]
    found += [places[p] for p in map(" ".join, zip(words, words[1:], strict=False))]
    counts = np.bincount(found, minlength=2 * dimension)
    out = (counts[:dimension] - counts[dimension:]).astype(np.float32)
    size = float(np.linalg.norm(out))
    return out / size if size else out


Embedder = Callable[[pd.Series], "list[np.ndarray]"]


def hashing_embedder(dimension: int = DIMENSION) -> Embedder:
    return lambda texts: [hash_embedding(t, dimension) for t in texts]


def embed(text: Column | str, embedder: Embedder | None = None) -> Column:
    """Embedding of a text column by any batch embedder (texts to vectors); hashing by default."""
    encode = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(v, np.float32).tolist() for v in encode(texts)], index=texts.index)

    return run(col(text))
