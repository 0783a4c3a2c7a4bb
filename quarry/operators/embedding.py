"""Embedding operator: a batch function ``texts -> matrix`` applied with Arrow batches.

A user plugs any model in as an :class:`Embedder` (``dim`` + ``__call__``);
it runs inside a pandas UDF on executors, ``batch_size`` texts per call, order
preserved, with the count and the vector width checked per batch.

:class:`HashEmbedder` is the default, deterministic model stand-in: each word
(maximal run of non-blank characters) adds a signed one-hot vector chosen by the
word's SHA-256, and the sum is L2-normalised. :func:`hash_embed_column` is the
same function over Arrow batches: each distinct word is hashed once, and one
vectorised bincount makes a batch's vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.constants import EMBED_BATCH_SIZE, WORD_PATTERN


class Embedder(Protocol):
    dim: int
    name: str

    def __call__(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed feature hashing of words into ``dim`` buckets, L2-normalised."""

    def __init__(self, dim: int = 64, name: str | None = None):
        if dim < 1:
            raise ValueError("dim must be positive")
        self.dim = int(dim)
        self.name = name or f"hash-embed-{dim}"
        self._words = re.compile(WORD_PATTERN)

    def word_features(self, word: str) -> tuple[int, float]:
        h = hashlib.sha256(word.encode("utf-8")).hexdigest()
        bucket = int(h[:8], 16) % self.dim
        sign = 1.0 if h[8] < "8" else -1.0
        return bucket, sign

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        # word -> (bucket, sign) memo, bounded; vocabularies are Zipfian so most lookups hit
        cache = self.__dict__.setdefault("_cache", {})
        if len(cache) > 2_000_000:
            cache.clear()
        rows: list[int] = []
        cols: list[int] = []
        vals: list[float] = []
        for row, text in enumerate(texts):
            if not text:
                continue
            for w in self._words.findall(text):
                f = cache.get(w)
                if f is None:
                    f = cache[w] = self.word_features(w)
                rows.append(row)
                cols.append(f[0])
                vals.append(f[1])
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        if rows:
            np.add.at(out, (np.asarray(rows), np.asarray(cols)), np.asarray(vals))
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norms, out=out, where=norms > 0)
        return out.astype(np.float32)


def _features(words: Sequence[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of words, as :meth:`HashEmbedder.word_features` gives them; the empty word has sign 0."""
    digests = b"".join([hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest() for w in words])
    raw = np.frombuffer(digests, np.uint8).reshape(-1, 32)
    bucket = np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.int64) % dim
    sign = np.where(raw[:, 4] < 128, 1.0, -1.0)
    sign[np.fromiter(map(len, words), np.int64, len(words)) == 0] = 0.0
    return bucket, sign


def hash_vectors(texts: pa.Array, dim: int) -> np.ndarray:
    """:class:`HashEmbedder` for a batch: each distinct word is hashed once, counts are one ``bincount``."""
    counts = np.zeros((len(texts), dim))
    step = max(1, (1 << 20) // dim)
    for lo in range(0, len(texts), step):
        part = texts.slice(lo, step).fill_null("").cast(pa.large_string())
        for c in "\t\r\n":
            part = pc.replace_substring(part, c, " ")
        part = pc.split_pattern(part, " ")
        words = part.flatten().dictionary_encode()
        bucket, sign = _features(words.dictionary.to_numpy(zero_copy_only=False).tolist(), dim)
        word = words.indices.to_numpy()
        at = np.repeat(np.arange(len(part)) * dim, np.diff(part.offsets.to_numpy())) + bucket[word]
        counts[lo:lo + step] = np.bincount(at, sign[word], len(part) * dim).reshape(-1, dim)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    np.divide(counts, norms, out=counts, where=norms > 0)
    return counts.astype(np.float32)


def hash_embed_column(text, dim: int = 64) -> Column:
    """:class:`HashEmbedder` as a column: one Arrow batch function, no row-at-a-time Python call."""
    @F.arrow_udf(T.ArrayType(T.FloatType(), containsNull=False))
    def _vectors(texts: pa.Array) -> pa.Array:
        out = hash_vectors(texts, dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel(), type=pa.float32()))

    # non-deterministic: keeps the optimizer from copying the UDF into every consumer of its result
    return _vectors.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def embed_column(text: Column | str, embedder: Embedder, batch_size: int = EMBED_BATCH_SIZE) -> Column:
    """Vector column computed by ``embedder`` in Arrow batches on executors.

    The built-in :class:`HashEmbedder` takes a faster, equivalent route
    (:func:`hash_embed_column`); any other embedder is called on ``batch_size`` texts at a time.
    """
    if isinstance(embedder, HashEmbedder):
        return hash_embed_column(text, embedder.dim)
    dim = int(embedder.dim)

    @F.pandas_udf(T.ArrayType(T.FloatType(), containsNull=False))
    def _embed(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        parts = []
        for i in range(0, len(values), batch_size):
            batch = values[i : i + batch_size]
            mat = np.asarray(embedder(batch), dtype=np.float32)
            if mat.ndim != 2 or mat.shape[0] != len(batch):
                raise ValueError(f"embedder returned {mat.shape[0] if mat.ndim else 0} vectors for {len(batch)} texts")
            if mat.shape[1] == 0:
                raise ValueError("embedder returned an empty vector")
            if mat.shape[1] != dim:
                raise ValueError(f"embedder returned width {mat.shape[1]}, declared {dim}")
            parts.append(mat)
        mat = np.vstack(parts) if parts else np.zeros((0, dim), dtype=np.float32)
        return pd.Series(list(mat))

    col = F.col(text) if isinstance(text, str) else text
    return _embed.asNondeterministic()(col)


def embed(df: DataFrame, embedder: Embedder, text_col: str = "chunk_text", out_col: str = "vector",
          batch_size: int = EMBED_BATCH_SIZE) -> DataFrame:
    """Append ``out_col`` (``array<float>``) and ``native_dim`` computed from ``text_col``."""
    from quarry.session import ship_package

    ship_package(df.sparkSession)  # embedders defined in this package are unpickled on executors
    return df.withColumn(out_col, embed_column(text_col, embedder, batch_size)).withColumn(
        "native_dim", F.size(out_col)
    )


def embedder_from_function(fn: Callable[[Sequence[str]], np.ndarray], dim: int, name: str) -> Embedder:
    """Wrap a plain ``list[str] -> ndarray`` function as an :class:`Embedder`."""

    class _Fn:
        def __init__(self):
            self.dim, self.name = dim, name

        def __call__(self, texts):
            return fn(texts)

    return _Fn()
