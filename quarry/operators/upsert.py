"""Keyed catalog maintenance: upsert (replace), merge (field-wise), edges.

Both operations shuffle once on the key. Within a batch the newest row per key
is chosen with ``max_by`` (a declarative aggregate, so a hot key is reduced
map-side before the shuffle). Against an existing table: upsert is
``left_anti`` + ``unionByName``; merge is a full outer join with
``coalesce(new, old)`` per field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(order_cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order_cols])


def latest_per_key(updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   fields: Sequence[str] | None = None) -> DataFrame:
    """Upsert semantics inside one batch: the newest row per key replaces all its fields."""
    fields = list(fields or [c for c in updates.columns if c not in keys])
    agg = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in fields]), _order(order_cols)).alias("_r")
    )
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in fields])


def merged_per_key(updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   fields: Sequence[str] | None = None) -> DataFrame:
    """Merge semantics inside one batch: per field, the newest non-NULL value."""
    fields = list(fields or [c for c in updates.columns if c not in keys and c not in order_cols])
    order_sql = "struct(" + ", ".join(f"`{c}`" for c in order_cols) + ")"
    aggs = [F.expr(f"max_by(`{c}`, {order_sql}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in fields]
    return updates.groupBy(*keys).agg(*aggs)


def newest(updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str] | None) -> DataFrame:
    """One row per key: the newest by ``order_cols``; without an order, a key with two different rows is an error."""
    if order_cols:
        return latest_per_key(updates, keys, order_cols)
    rest = [c for c in updates.columns if c not in keys]
    one = updates.distinct().groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    row = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("an upsert without an order has two rows for one key")))
    return one.select(*keys, row.alias("_r")).select(*keys, "_r.*")


def upsert_table(existing: DataFrame, updates: DataFrame, keys: Sequence[str],
                 order_cols: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``existing`` whose key is not updated, plus the newest update per key."""
    batch = newest(updates, keys, order_cols)
    if order_cols:
        batch = batch.drop(*[c for c in order_cols if c in batch.columns and c not in existing.columns])
    kept = existing.join(batch.select(*keys), list(keys), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def merge_table(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                fields: Sequence[str] | None = None) -> DataFrame:
    """Existing rows with supplied (non-NULL) fields overwritten; new keys inserted.

    ``fields`` names the updatable fields (default: every non-key column of
    ``updates``); all other columns of ``existing`` are kept as they are.
    """
    batch_fields = list(fields or [c for c in updates.columns if c not in keys and c not in order_cols])
    batch = merged_per_key(updates, keys, order_cols, batch_fields)
    kept_cols = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept_cols])
    new = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in batch_fields])
    joined = old.join(new, list(keys), "full_outer")
    out = []
    for c in kept_cols + [c for c in batch_fields if c not in kept_cols]:
        if c in batch_fields and c in kept_cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(f"_old_{c}")).alias(c))
        elif c in batch_fields:
            out.append(F.col(f"_new_{c}").alias(c))
        else:
            out.append(F.col(f"_old_{c}").alias(c))
    return joined.select(*keys, *out)


def distinct_edges(*edge_frames: DataFrame) -> DataFrame:
    """Union of edge frames ``(relation, in_id, out_id)`` without duplicates."""
    out = edge_frames[0].select("relation", "in_id", "out_id")
    for e in edge_frames[1:]:
        out = out.unionByName(e.select("relation", "in_id", "out_id"))
    return out.dropDuplicates(["relation", "in_id", "out_id"])
