"""Embedding operator: hash embedder paths agree; user embedders are checked."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding
from quarry.operators.embedding import HashEmbedder, embed, embed_column, embedder_from_function, hash_embed_column


def test_hash_embedder_paths_agree(spark):
    texts = ["alpha beta gamma alpha", "", "ünïcode  wörds\tand\nlines", "x" * 1000, "a b c d e f g h"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: np.array(r.v, dtype=np.float32) for r in df.select("id", hash_embed_column("t", 32).alias("v")).collect()}
    ref = HashEmbedder(32)(texts)
    for i in range(len(texts)):
        assert got[i].shape == (32,)
        assert np.array_equal(got[i], ref[i])
    assert np.allclose(np.linalg.norm(ref[[0, 2, 3, 4]], axis=1), 1.0, atol=1e-6)
    assert not ref[1].any()


def test_each_distinct_word_of_a_batch_is_hashed_once(monkeypatch):
    asked = []
    sha256 = embedding.hashlib.sha256
    monkeypatch.setattr(embedding, "hashlib", SimpleNamespace(sha256=lambda w: asked.append(w) or sha256(w)))
    texts = ["a b a", None, "", " b\t\ta\r\n", "ü"] * 50
    got = embedding.hash_vectors(pa.array(texts)[1:], 16)
    assert sorted(asked) == sorted([b"", b"a", b"b", "ü".encode()])
    assert np.array_equal(got, HashEmbedder(16)(texts)[1:])


def test_generic_embedder_batches_and_checks(spark):
    calls = []

    def fn(texts):
        calls.append(len(texts))
        return np.tile(np.array([0.1, 0.2, 0.3, 0.4], dtype=np.float32), (len(texts), 1))

    e = embedder_from_function(fn, 4, "const")
    df = spark.range(40).select(F.col("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).coalesce(1)
    out = embed(df, e, "t").collect()
    assert all(r.vector == pytest.approx([0.1, 0.2, 0.3, 0.4]) and r.native_dim == 4 for r in out)

    bad = embedder_from_function(lambda texts: np.zeros((len(texts) - 1, 4), dtype=np.float32), 4, "short")
    with pytest.raises(Exception, match="vectors for"):
        df.select(embed_column("t", bad)).collect()
    empty = embedder_from_function(lambda texts: np.zeros((len(texts), 0), dtype=np.float32), 0, "empty")
    with pytest.raises(Exception, match="empty vector"):
        df.select(embed_column("t", empty)).collect()
