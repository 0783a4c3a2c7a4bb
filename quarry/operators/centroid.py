"""Per-group vector centroids (element-wise mean), without exploding vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import walk_order_key


def centroids(chunks: DataFrame, group_cols: Sequence[str] = ("ws", "model"), vec_col: str = "vector",
              order_cols: Sequence[str] = ("relpath", "chunk_index")) -> DataFrame:
    """Mean vector, sample count and native dimension per group.

    The native dimension is the width of the group's first chunk in walk order
    (``order_cols``: path elements, then chunk index); only vectors of that width
    enter the mean. One shuffle over ``(group, width)`` with partial aggregation
    (``Summarizer`` plans as a partial + final ``ObjectHashAggregate``); the
    per-group pick then runs over one row per (group, width).
    """
    rel, idx = order_cols
    keyed = chunks.select(
        *group_cols,
        F.size(vec_col).alias("_dim"),
        array_to_vector(F.col(vec_col)).alias("_v"),
        F.struct(walk_order_key(rel).alias("p"), F.col(idx).alias("i")).alias("_first"),
    ).filter(F.col("_dim") > 0)
    per_dim = keyed.groupBy(*group_cols, "_dim").agg(
        Summarizer.mean(F.col("_v")).alias("_mean"),
        F.count(F.lit(1)).alias("sample"),
        F.min("_first").alias("_first"),
    )
    picked = per_dim.groupBy(*group_cols).agg(
        F.min_by(F.struct(F.col("_dim").alias("native_dim"), "sample", "_mean"), F.col("_first")).alias("_c")
    )
    return picked.select(
        *group_cols,
        F.col("_c.native_dim").alias("native_dim"),
        F.col("_c.sample").alias("sample"),
        vector_to_array(F.col("_c._mean")).alias("centroid"),
    )


#: Parts whose vector sums are kept apart, so that a change refreshes one part of a workspace.
PARTS = 64


def part_of(path_col: str):
    """The part that a path's sums belong to."""
    return F.pmod(F.xxhash64(path_col), F.lit(PARTS)).cast("int")


def vector_sums(chunks: DataFrame, group_cols: Sequence[str], vec_col: str = "vector",
                order_cols: Sequence[str] = ("relpath", "chunk_index")) -> DataFrame:
    """Statistics that can be added up: per group and width, sample, vector_sum and the first chunk in walk order."""
    rel, idx = order_cols
    rows = chunks.select(*group_cols, F.size(vec_col).alias("native_dim"), array_to_vector(F.col(vec_col)).alias("_v"),
                         F.struct(walk_order_key(rel).alias("p"), F.col(idx).cast("int").alias("i")).alias("first")).where("native_dim > 0")
    out = rows.groupBy(*group_cols, "native_dim").agg(F.count(F.lit(1)).alias("sample"), Summarizer.sum(F.col("_v")).alias("_s"), F.min("first").alias("first"))
    return out.select(*group_cols, "native_dim", "sample", vector_to_array("_s").alias("vector_sum"), "first")


def centroids_of(sums: DataFrame, group_cols: Sequence[str] = ("ws", "model")) -> DataFrame:
    """:func:`centroids` from the rows of :func:`vector_sums`, whatever parts they were taken over."""
    per_dim = sums.groupBy(*group_cols, "native_dim").agg(
        F.sum("sample").alias("sample"), Summarizer.sum(array_to_vector("vector_sum")).alias("_s"), F.min("first").alias("first"))
    picked = per_dim.groupBy(*group_cols).agg(F.min_by(F.struct("native_dim", "sample", vector_to_array("_s").alias("s")), "first").alias("_c"))
    return picked.select(*group_cols, F.col("_c.native_dim").alias("native_dim"), F.col("_c.sample").alias("sample"),
                         F.transform("_c.s", lambda x: x / F.col("_c.sample")).alias("centroid"))


def column_mean(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """Element-wise mean of a vector column over all rows: one row ``(n, mean)``."""
    return df.select(array_to_vector(F.col(vec_col)).alias("_v")).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean")
    )


def explode_vector(df: DataFrame, vec_col: str, keep: Sequence[str], digits: int = 6) -> DataFrame:
    """Vector as rows ``(…keep, dim_index, value)`` rounded for comparisons (small results only)."""
    return df.select(*keep, F.posexplode(vec_col).alias("dim_index", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), digits) + F.lit(0.0)
    ).withColumn("dim_index", F.col("dim_index").cast("bigint"))
