"""Fit a PCA transform on a text corpus: NDJSON texts -> embeddings -> mean + components -> model file."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarry.constants import PCA_EMBED_BATCH_SIZE
from quarry.operators.embedding import Embedder, embed
from quarry.operators.pca import PcaResult, fit_pca, write_model
from quarry.sources.ndjson import read_texts


def fit_pca_on_corpus(spark: SparkSession, corpus_path: str, embedder: Embedder, out_path: str,
                      name: str, k: int | None = None, max_texts: int | None = None) -> tuple[PcaResult, str]:
    """Returns the fitted model and its transform id. ``k`` defaults to min(n, d).

    The embedded sample is written to ``<out_path>_sample`` once, so the mean and
    the covariance passes read vectors instead of calling the model twice.
    """
    texts = read_texts(spark, corpus_path, max_texts)
    vecs = embed(texts, embedder, "text", "vector", batch_size=PCA_EMBED_BATCH_SIZE).select("vector")
    sample_path = f"{out_path.rstrip('/')}_sample"
    vecs.write.mode("overwrite").parquet(sample_path)
    stored = spark.read.parquet(sample_path)
    if stored.limit(1).count() == 0:
        raise ValueError("no input")
    result = fit_pca(stored, "vector", k)
    return result, write_model(spark, result, out_path, name)
