"""The catalogue: Parquet tables on a shared file system, partitioned by key and maintained by dynamic partition overwrite.

A table is a folder ``<root>/<table>/by=<column>/of=<n>`` of Spark's own partitioned Parquet. Its partition columns are
``ws`` and ``relation``, where the table has them, and ``bucket``, the hash of column ``by`` modulo ``n``; a new table gets
``n`` from the catalogue and ``by`` from the declared bucket columns, the keys of its first upsert, or its first column.
Reads drop the bookkeeping columns; filters on ``ws`` and ``relation`` prune folders.

Maintenance touches only the partitions that hold a key of the update: they are read, combined with it, and written with
``partitionOverwriteMode=dynamic``, which stages the new files and then swaps the partitions. Partitions that end up
without rows are deleted afterwards. A job that fails before the swap changes nothing; one that fails
during it leaves partitions that are old or new and may be run again. Two writers of one partition are not arbitrated.

Declared tables (``schemas.SCHEMAS``) are read with their declared columns; others with the columns of their files, where
``ws`` and ``relation`` are always text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import upsert as U
from quarry.schemas import BUCKET_COLUMNS, SCHEMAS

EDGES = "edge"
_SCOPES = ("ws", "relation")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # ---------------------------------------------------------------- folders
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        fs = self._fs()
        return [x.getPath().getName() for x in fs.listStatus(self._path(folder))] if fs.exists(self._path(folder)) else []

    def _partition(self, column: str, value: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, value)

    def layout(self, table: str) -> tuple[str, int] | None:
        """(bucket column, number of buckets) of a table, None if it does not exist."""
        for by in self._names(f"{self.root}/{table}"):
            for of in self._names(f"{self.root}/{table}/{by}"):
                if by.startswith("by=") and of.startswith("of="):
                    return by[3:], int(of[3:])
        return None

    def exists(self, table: str) -> bool:
        return self.layout(table) is not None

    def _folder(self, table: str, layout: tuple[str, int]) -> str:
        return f"{self.root}/{table}/by={layout[0]}/of={layout[1]}"

    def _files(self, folder: str) -> dict[str, frozenset[str]]:
        """The innermost partition folders of ``folder``, each with the names of its files."""
        names = self._names(folder)
        inner = [n for n in names if "=" in n and not n.startswith((".", "_"))]
        if not inner:
            return {folder: frozenset(names)} if names else {}
        return {k: v for n in inner for k, v in self._files(f"{folder}/{n}").items()}

    # ---------------------------------------------------------------- read and write
    def read(self, table: str) -> DataFrame:
        return self._read(table).drop("bucket")

    def _read(self, table: str) -> DataFrame:
        """The table with its ``bucket`` column."""
        layout = self.layout(table)
        if layout is None:
            raise KeyError(f"table {table} does not exist")
        folder = self._folder(table, layout)
        if table in SCHEMAS:
            fields = T.StructType.fromDDL(SCHEMAS[table]).fields
        else:
            fields = [f for f in self.spark.read.option("mergeSchema", "true").parquet(folder).schema.fields if f.name != "bucket"]
        fields = [T.StructField(f.name, T.StringType() if f.name in _SCOPES else f.dataType) for f in fields]
        return self.spark.read.schema(T.StructType([*fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)

    def bucket(self, table: str) -> Column:
        """The bucket of a row of ``table``, as an expression over its bucket column."""
        by, of = self.layout(table) or (BUCKET_COLUMNS[table], self.buckets)
        return F.pmod(F.xxhash64(F.col(by).cast("string")), F.lit(of)).cast("int")

    def _bucketed(self, df: DataFrame, layout: tuple[str, int]) -> DataFrame:
        for c in _SCOPES:
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("string"))
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(layout[0]).cast("string")), F.lit(layout[1])).cast("int"))

    def _new_layout(self, table: str, df: DataFrame, keys: Sequence[str] = ()) -> tuple[str, int]:
        plain = [c for c in (*keys, *df.columns) if c not in _SCOPES]
        return BUCKET_COLUMNS.get(table) or plain[0], self.buckets

    def _save(self, table: str, df: DataFrame, layout: tuple[str, int], mode: str = "dynamic", dealt: bool = False) -> None:
        """Write rows with their buckets; unless ``dealt`` out already, rows of one partition meet first (large ones in parts)."""
        parts = [*(c for c in _SCOPES if c in df.columns), "bucket"]
        out = df if dealt else df.hint("rebalance", *parts)
        (out.write.option("compression", "zstd").mode("append" if mode == "append" else "overwrite").option("partitionOverwriteMode", "static" if mode == "static" else "dynamic")
         .partitionBy(*parts).parquet(self._folder(table, layout)))

    def _swap(self, table: str, df: DataFrame, layout: tuple[str, int], within: Iterable[str], dealt: bool = False) -> None:
        """Overwrite the partitions of ``df``; those of the folders ``within`` that got no rows are deleted."""
        folders = [f"{self._folder(table, layout)}/{name}" for name in within]
        before = {k: v for f in folders for k, v in self._files(f).items()}
        self._save(table, df, layout, dealt=dealt)
        after = {k: v for f in folders for k, v in self._files(f).items()}
        for path, files in before.items():
            if after.get(path) == files:
                self._fs().delete(self._path(path), True)

    def write(self, table: str, df: DataFrame, keys: Sequence[str] = ()) -> None:
        """Replace the whole table (``df`` must not read it)."""
        layout = self.layout(table) or self._new_layout(table, df, keys)
        self._save(table, self._bucketed(df, layout), layout, "static")

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows: new files beside the others."""
        layout = self.layout(table) or self._new_layout(table, df)
        self._save(table, self._bucketed(df, layout), layout, "append", dealt=True)

    def sql(self, query: str, tables: Sequence[str], **args) -> DataFrame:
        """Run a parameterised query (``:name`` markers bound from ``args``) over catalog tables."""
        for t in tables:
            self.read(t).createOrReplaceTempView(t)
        return self.spark.sql(query, args=args or None)

    # ---------------------------------------------------------------- keyed maintenance
    def _touched(self, table: str, updates: DataFrame, keys: Sequence[str], layout: tuple[str, int]) -> tuple[DataFrame, set[str]]:
        """The stored rows of the partitions that ``updates`` has keys for, and the names of those partitions."""
        if layout[0] not in keys:
            raise ValueError(f"table {table} is bucketed by {layout[0]}, which is no key of this update")
        scopes = [c for c in _SCOPES if c in updates.columns]
        stored = self._read(table)
        # at most one row per partition of the table
        hit = self._bucketed(updates, layout).select(*scopes, "bucket").distinct().collect()
        names = {"/".join(self._partition(c, str(r[c])) for c in (*scopes, "bucket")) for r in hit}
        if not scopes:
            rows = stored.where(F.col("bucket").isin([r.bucket for r in hit]))
        else:
            pairs = self.spark.createDataFrame(hit, stored.select(*scopes, "bucket").schema) if hit else stored.select(*scopes, "bucket").limit(0)
            rows = stored.join(F.broadcast(pairs), [*scopes, "bucket"], "left_semi")
        return rows.drop("bucket"), names

    def _change(self, table: str, updates: DataFrame, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame], first: DataFrame,
                dealt: bool = False) -> None:
        layout = self.layout(table)
        if layout is None:
            layout = self._new_layout(table, first, keys)
            self._save(table, self._bucketed(first, layout), layout, "static", dealt)
            return
        rows, within = self._touched(table, updates, keys, layout)
        self._swap(table, self._bucketed(combine(rows), layout), layout, within, dealt)

    def upsert(self, table: str, updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str] | None = None) -> None:
        """Insert or replace whole rows by key (the newest update per key wins)."""
        self._change(table, updates, keys, lambda rows: U.upsert_table(rows, updates, keys, order_cols), U.newest(updates, keys, order_cols))

    def merge(self, table: str, updates: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
              fields: Sequence[str] | None = None) -> None:
        """Update only the supplied (non-NULL) fields; insert new keys."""
        self._change(table, updates, keys, lambda rows: U.merge_table(rows, updates, keys, order_cols, fields),
                     U.merged_per_key(updates, keys, order_cols, fields))

    def replace_keys(self, table: str, rows: DataFrame, keys: DataFrame, dealt: bool = False) -> None:
        """Delete the rows that have one of ``keys`` (all its columns equal) and add ``rows``; other partitions stay untouched.

        Every key of ``rows`` should be in ``keys``, whose columns must include the bucket column and the table's scopes.
        ``dealt``: ``rows`` are dealt out by :meth:`bucket`, and need not be moved.
        """
        names = keys.columns
        self._change(table, keys, names, lambda old: old.join(keys.distinct(), names, "left_anti").unionByName(rows, allowMissingColumns=True), rows, dealt)

    def replace_workspace(self, table: str, ws: str, rows: DataFrame) -> None:
        """Replace every row of one workspace, also when ``rows`` has none for it."""
        rows = rows.filter(F.col("ws") == ws)
        layout = self.layout(table)
        if layout is None:
            self.write(table, rows)
            return
        self._swap(table, self._bucketed(rows, layout), layout, [self._partition("ws", ws)])

    def replace_edges(self, edges: DataFrame, relations: Sequence[str], workspaces: Sequence[str] = ()) -> None:
        """Replace ``relations`` in the workspaces of ``edges(relation, in_id, out_id, ws)`` and in ``workspaces``."""
        rows = edges.select("relation", "in_id", "out_id", "ws").distinct()
        layout = self.layout(EDGES)
        if layout is None:
            self.write(EDGES, rows)
            return
        named = {r.ws for r in rows.select("ws").distinct().collect()} | set(workspaces)
        within = [f"{self._partition('ws', w)}/{self._partition('relation', r)}" for w in sorted(named) for r in relations]
        self._swap(EDGES, self._bucketed(rows, layout), layout, within)

    def set_edges(self, ws: str, edges: DataFrame, relations: Sequence[str]) -> None:
        """The edges of one workspace for ``relations``, without duplicates; a relation without edges is emptied."""
        self.replace_edges(U.distinct_edges(edges).withColumn("ws", F.lit(ws)), relations, [ws])
