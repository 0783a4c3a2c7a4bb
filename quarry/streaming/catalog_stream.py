"""Incremental catalog maintenance with Structured Streaming.

Registrations (nodes, workspaces) or any keyed records arrive as JSON files in
a landing folder; each micro-batch is applied to a catalog table with the same
upsert / merge operators as the batch jobs (``foreachBatch``). The checkpoint
lives under the session's ``spark.checkpoint.dir`` (a shared folder on a
cluster), so a restarted query resumes after the last committed batch, and a
batch that fails before its pointer switch leaves the previous table version live.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.session import checkpoint_dir
from quarry.sources.catalog import Catalog


def apply_batch(catalog: Catalog, table: str, keys: Sequence[str], order_cols: Sequence[str], mode: str):
    """A ``foreachBatch`` function applying one micro-batch to ``table``."""
    if mode not in ("upsert", "merge"):
        raise ValueError("mode must be 'upsert' or 'merge'")

    def _apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if mode == "upsert":
            catalog.upsert(table, batch, keys, order_cols)
        else:
            catalog.merge(table, batch, keys, order_cols)

    return _apply


def start_catalog_stream(spark: SparkSession, catalog: Catalog, landing_dir: str, schema: str, table: str,
                         keys: Sequence[str], order_cols: Sequence[str], mode: str = "upsert",
                         name: str | None = None, available_now: bool = False,
                         max_files_per_trigger: int | None = None,
                         checkpoint_location: str | None = None, fmt: str = "json",
                         options: dict[str, str] | None = None) -> StreamingQuery:
    """Start a stream ``landing_dir (JSON by default) -> table``; ``available_now`` drains what is there and stops.

    The checkpoint defaults to ``<spark.checkpoint.dir>/streams/<name or table>``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.load(landing_dir)
    ckpt = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name or table}"
    writer = stream.writeStream.foreachBatch(apply_batch(catalog, table, keys, order_cols, mode)).option(
        "checkpointLocation", ckpt)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
