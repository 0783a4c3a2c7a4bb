"""PCA over an embedding column: distributed covariance (``pyspark.ml``), small d x k result.

The only data brought to the driver is the d x k component matrix and the
d-long mean (bounded by the model dimension, not by the row count).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.constants import PCA_PADDED_WIDTH
from quarry.operators.centroid import column_mean


@dataclass
class PcaResult:
    mean: np.ndarray              # (d,)
    components: np.ndarray        # (d, k): column j is component j (feature x component)
    explained_variance: np.ndarray  # (k,)
    n: int

    def to_json(self, padded_width: int = PCA_PADDED_WIDTH) -> str:
        """``{"mean": [...], "components": [[...]]}``; each feature row zero-extended to ``padded_width``."""
        d, k = self.components.shape
        rows = np.zeros((d, max(padded_width, k)), dtype=np.float32)
        rows[:, :k] = self.components
        return json.dumps({"mean": [float(np.float32(x)) for x in self.mean],
                           "components": [[float(x) for x in r] for r in rows]}, separators=(",", ":"))


def fit_pca(df: DataFrame, vec_col: str = "vector", k: int | None = None) -> PcaResult:
    """Principal components of the centred vectors; signs fixed so each component's largest |entry| is positive."""
    vecs = df.select(array_to_vector(F.col(vec_col)).alias("features"))
    stats = column_mean(df, vec_col).collect()[0]
    n = int(stats["n"])
    mean = np.asarray(stats["mean"] or [], dtype=np.float64)
    d = mean.shape[0]
    if n == 0 or d == 0:
        raise ValueError("no vectors to fit")
    k = min(n, d) if k is None else int(k)
    if k < 1 or k > min(n, d):
        raise ValueError(f"k must be in 1..min(n, d) = {min(n, d)}")
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vecs)
    comps = model.pc.toArray()  # d x k
    signs = np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(comps.shape[1])])
    signs[signs == 0] = 1.0
    comps = comps * signs
    return PcaResult(mean=mean, components=comps, explained_variance=np.asarray(model.explainedVariance.toArray()), n=n)


def gram_parts(df: DataFrame, part_col: str, vec_col: str = "vector") -> DataFrame:
    """Statistics that can be added up: per part and width, n, the vectors' sum and their Gram matrix (row by row).

    Each task adds its batches' products; the rows that meet in the shuffle are one per task, part and width.
    """
    kind = dict(df.dtypes)[part_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            known = b[b["v"].map(lambda v: v is not None and len(v) > 0)]
            for (part, dim), rows in known.groupby([known["part"], known["v"].map(len)], dropna=False):
                x = np.stack(rows["v"].to_list()).astype(np.float64)
                part = None if pd.isna(part) else part
                n, total, gram = held.get((part, dim), (0, 0.0, 0.0))
                held[part, dim] = (n + len(x), total + x.sum(0), gram + x.T @ x)
        if held:
            yield pd.DataFrame([(p, d, n, t, g.ravel()) for (p, d), (n, t, g) in held.items()], columns=["part", "dim", "n", "total", "gram"])

    rows = df.select(F.col(part_col).alias("part"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.mapInPandas(run, f"part {kind}, dim int, n long, total array<double>, gram array<double>")
    return _added(rows, ["part", "dim"]).withColumnRenamed("part", part_col)


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    add = lambda c: vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), add("total"), add("gram"))


def covariance_of(parts: DataFrame) -> DataFrame:
    """(dim, n, mean, covariance (row by row)) of all vectors, from the rows of :func:`gram_parts` added up."""
    one = _added(parts, ["dim"])
    mean = F.transform("total", lambda x: x / F.col("n"))
    cell = lambda g, k: (g - F.get("total", F.floor(k / F.col("dim")).cast("int")) * F.get("total", (k % F.col("dim")).cast("int")) / F.col("n"))
    return one.select("dim", "n", mean.alias("mean"), F.transform("gram", lambda g, k: cell(g, k) / F.nullif(F.col("n") - 1, F.lit(0))).alias("covariance"))


def fit_from_parts(parts: DataFrame, k: int | None = None) -> PcaResult:
    """:func:`fit_pca` from kept statistics: only the d x d covariance comes to the driver."""
    rows = covariance_of(parts).collect()  # one row per vector width
    if len(rows) != 1:
        raise ValueError("no vectors to fit" if not rows else "vectors of several widths")
    n, d = int(rows[0]["n"]), int(rows[0]["dim"])
    k = min(n, d) if k is None else int(k)
    if k < 1 or k > min(n, d):
        raise ValueError(f"k must be in 1..min(n, d) = {min(n, d)}")
    values, vectors = np.linalg.eigh(np.array(rows[0]["covariance"]).reshape(d, d))
    comps = vectors[:, ::-1][:, :k]
    signs = np.sign(comps[np.abs(comps).argmax(axis=0), np.arange(k)])
    signs[signs == 0] = 1.0
    values = np.clip(values[::-1], 0, None)
    return PcaResult(mean=np.array(rows[0]["mean"]), components=comps * signs, explained_variance=values[:k] / max(values.sum(), 1e-300), n=n)


def project(df: DataFrame, result: PcaResult, vec_col: str = "vector", out_col: str = "projected") -> DataFrame:
    """``(v - mean) @ components`` as ``array<double>``: one matrix product per Arrow batch, the model broadcast once."""
    model = df.sparkSession.sparkContext.broadcast((result.mean, result.components))

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        mean, components = model.value
        known = [v for v in vectors if v is not None]
        got = iter((np.stack(known).astype(np.float64) - mean) @ components if known else ())
        return pd.Series([None if v is None else next(got) for v in vectors], dtype=object)

    return df.withColumn(out_col, run(F.col(vec_col)))


def write_model(spark, result: PcaResult, path: str, name: str) -> str:
    """Write the model JSON (one text file) and return its transform id ``<name>@<8 hex>``.

    The id is the first four bytes of the SHA-256 of the written JSON, computed
    with the same Spark expression as :func:`quarry.functions.hashing.transform_id`.
    """
    from quarry.functions.hashing import transform_id

    doc = spark.createDataFrame([(result.to_json(),)], "value string")
    doc.coalesce(1).write.mode("overwrite").text(path)
    return doc.select(transform_id("value", name).alias("t")).first()["t"]
