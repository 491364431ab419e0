"""Vectors: cosine, centroids, hashed text embeddings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or zero vectors and for vectors of unlike length."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    scale = norm(a) * norm(b)
    return F.when(fine & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, centroid: the mean of each group's vectors at unit length. Sums combine before the shuffle; none are collected whole."""
    parts = rows.select(key, F.posexplode(F.col(vector)).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    arrays = parts.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    return arrays.select(key, unit(F.col("centroid")).alias("centroid"))


def fnv1a(strings: list[str]) -> np.ndarray:
    """The 32-bit FNV-1a hashes of strings of characters below 256."""
    out = np.full(len(strings), 2166136261, np.uint32)
    lengths = np.array([len(x) for x in strings])
    chars = np.zeros((len(strings), int(lengths.max(initial=0))), np.uint32)
    chars[np.arange(chars.shape[1])[None] < lengths[:, None]] = np.frombuffer("".join(strings).encode("latin-1"), np.uint8)
    for i in range(chars.shape[1]):
        live = lengths > i
        out[live] = (out[live] ^ chars[live, i]) * np.uint32(16777619)
    return out


def _features(text: str) -> tuple[list[str], list[int]]:
    words = re.findall("[a-z0-9]+", text.lower())
    grams = [f"c3:{w[i : i + 3]}" for w in words if len(w) >= 4 for i in range(len(w) - 2)]
    pairs = [f"w2:{a} {b}" for a, b in zip(words, words[1:])]
    return [*(f"w1:{w}" for w in words), *grams, *pairs], [1] * (len(words) + len(grams)) + [2] * len(pairs)


def embed(text: Column) -> Column:
    """A signed hash embedding of words, character trigrams of longer words and word pairs (which count twice), at unit length;
    a null or wordless text gives zeros. The hash's low bits choose the place, its top bit the sign. One Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        found = [_features(t or "") for t in texts]
        known = {f: i for i, f in enumerate(dict.fromkeys(f for names, _ in found for f in names))}
        h = fnv1a(list(known)).astype(np.int64)
        place, sign = (h & 0x7FFFFFFF) % DIMENSIONS, np.where(h >> 31, -1.0, 1.0)
        out = []
        for names, counts in found:
            at = np.fromiter((known[f] for f in names), np.int64, len(names))
            v = np.bincount(place[at], sign[at] * counts, DIMENSIONS) if len(at) else np.zeros(DIMENSIONS)
            out.append(v / n if (n := np.sqrt((v * v).sum())) else v)
        return pd.Series(out)

    return run(text)


def to_bytes(vector: Column) -> Column:
    """A vector as little-endian float32; null gives no bytes."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: b"" if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector.cast("array<float>"))


def from_bytes(blob: Column) -> Column:
    """The vector of little-endian float32 bytes; null and none give an empty one, a length that is no multiple of 4 is an error."""
    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        for b in blobs:
            if b is not None and len(b) % 4:
                raise ValueError(f"embedding blob length {len(b)} is not a multiple of 4")
        return blobs.map(lambda b: np.frombuffer(b or b"", "<f4"))

    return run(blob)
