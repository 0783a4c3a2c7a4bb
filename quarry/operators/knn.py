"""Exact cosine k-nearest-neighbour search.

* one query: literal query vector, filters first, JVM scoring, ``orderBy().limit(k)``
  (planned as ``TakeOrderedAndProject``: each task keeps k rows);
* one query per group (per workspace, per file): ``row_number() <= k`` over a
  window, which Spark plans with a map-side ``WindowGroupLimit`` so a hot group
  ships at most k rows per task through the shuffle;
* many queries: queries are packed into tiles and chunks into blocks; a task scores
  a block against a tile with one matrix product and keeps exactly k rows per query, ties
  broken by id, then a per-query window picks the final k. No query passes the driver, chunks
  are scanned once, and no query x chunk pairs are materialised.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.vectors import cosine_to_query
from quarry.sources.staging import written

#: Values (rows x width) of a block of chunks or a tile of queries.
BLOCK_VALUES = 1 << 17
#: Tiles of at most this many bytes are sent to every task; more are dealt out.
BROADCAST_BYTES = 16 << 20
#: Result rows that a task holds at once.
POOL_ROWS = 500_000


def top_k(df: DataFrame, k: int, score_col: str = "score", tie_col: str = "id",
          group_cols: Sequence[str] | None = None, rank_col: str | None = None) -> DataFrame:
    """Best ``k`` rows by ``score`` descending, ties broken by ``tie_col`` ascending."""
    order = [F.col(score_col).desc(), F.col(tie_col).asc()]
    if not group_cols:
        out = df.orderBy(*order).limit(k)
        if rank_col:
            out = out.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
        return out
    w = Window.partitionBy(*group_cols).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank_col) if rank_col else ranked.drop("_rank")


def vector_search(chunks: DataFrame, query: Sequence[float], k: int, vec_col: str = "vector",
                  filters=None, group_cols: Sequence[str] | None = None, id_col: str = "id",
                  rank_col: str | None = None, norm_col: str | None = None) -> DataFrame:
    """Filter, then score by cosine similarity to ``query``, then keep the top ``k``.

    Rows whose vector width differs from the query, or has zero norm, get a NULL
    score and are dropped.
    """
    df = chunks
    for f in filters or []:
        df = df.filter(f)
    if norm_col is None and "norm" in df.columns:
        norm_col = "norm"
    scored = df.withColumn("score", cosine_to_query(vec_col, query, norm_col)).filter(F.col("score").isNotNull())
    return top_k(scored, k, "score", id_col, group_cols, rank_col)


def _packed(df: DataFrame, row_cols: Sequence[str], vec_col: str, values: int) -> DataFrame:
    """Blocks of rows of one vector width: (dim, rows, units), ``units`` the unit vectors as doubles, about ``values`` of them.

    Rows without a vector, or with one that is zero, are dropped. One pass, no shuffle.
    """
    row = T.StructType([df.schema[c] for c in row_cols])
    out = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("rows", T.ArrayType(row)), T.StructField("units", T.BinaryType())])
    schema = to_arrow_schema(out)

    def block(parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        rows = pa.concat_arrays([p[0] for p in parts])
        units = np.concatenate([p[1] for p in parts])
        listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array([units.shape[1]], pa.int32()), listed.cast(schema.field("rows").type), pa.array([units.tobytes()], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        count: dict[int, int] = {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[~np.isnan(sizes.astype(float))]).astype(int).tolist():
                at = np.flatnonzero(sizes == dim)
                v = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                norm = np.linalg.norm(v, axis=1)
                ok = np.isfinite(norm) & (norm > 0)
                rows, units = b.column(0).take(pa.array(at[ok])), v[ok] / norm[ok, None]
                step = max(1, values // max(dim, 1))
                for lo in range(0, len(rows), step):
                    part = rows.slice(lo, step), units[lo:lo + step]
                    if count.get(dim, 0) + len(part[0]) > step:
                        yield block(held.pop(dim))
                        count[dim] = 0
                    held.setdefault(dim, []).append(part)
                    count[dim] = count.get(dim, 0) + len(part[0])
        for parts in held.values():
            yield block(parts)

    # non-finite values cannot be ranked; zero vectors have no direction
    return df.select(F.struct(*row_cols).alias("row"), F.col(vec_col).cast("array<double>").alias("v")).where(F.size("v") > 0).mapInArrow(run, out)


def batch_knn(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vector",
              qid_col: str = "query_id", qvec_col: str = "query_vector", carry_cols: Sequence[str] = ()) -> DataFrame:
    """Top-``k`` chunks by cosine similarity for every query row.

    Output: ``qid_col, id_col, *carry_cols, score, rank``. A query is answered from
    the chunks of its own width; queries with a NULL or zero vector get no rows.

    Queries are packed into tiles (a written table) and chunks into blocks in one scan; every task multiplies
    pairs of one block and one tile of the same width and keeps the k best rows per query of what it has seen. If
    the tiles are few (``BROADCAST_BYTES``) they go to every task, else both sides are dealt out over a grid.
    """
    row_cols = [id_col, *carry_cols]
    fields = [T.StructField(qid_col, queries.schema[qid_col].dataType)] + [T.StructField(c, chunks.schema[c].dataType) for c in row_cols]
    out_schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    schema = to_arrow_schema(out_schema)
    tiles = written(_packed(queries, [qid_col], qvec_col, BLOCK_VALUES).withColumnsRenamed({"rows": "asked", "units": "wanted"}), "query-tiles")
    blocks = _packed(chunks, row_cols, vec_col, BLOCK_VALUES)
    size = tiles.agg(F.coalesce(F.sum(F.octet_length("wanted")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(tiles), "dim")
    else:
        cells = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.withColumn("_cell", F.pmod(F.monotonically_increasing_id(), F.lit(cells)))
        pairs = blocks.join(tiles.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))), ["dim", "_cell"])
    found = pairs.select("dim", "rows", "units", "asked", "wanted").mapInArrow(_scorer(k, qid_col, row_cols, schema), out_schema)
    return top_k(found, k, "score", id_col, [qid_col], rank_col="rank")


def _scorer(k: int, qid_col: str, row_cols: list[str], schema: pa.Schema):
    id_col = row_cols[0]

    def best(pool: pa.Table) -> pa.Table:
        """The first k rows per query by (score descending, id)."""
        pool = pool.append_column("_q", pool[qid_col].combine_chunks().dictionary_encode().indices)
        pool = pool.take(pc.sort_indices(pool, sort_keys=[("_q", "ascending"), ("score", "descending"), (id_col, "ascending")]))
        q = pool["_q"].to_numpy()
        return pool.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q, side="left") < k)).drop_columns(["_q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.Table] = []
        held = limit = 0
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                rows, asked = b.column(1)[i].values, b.column(3)[i].values
                units = np.frombuffer(b.column(2)[i].as_buffer(), np.float64).reshape(-1, dim)
                # rounded, so that ties do not depend on the block a row is in
                scores = np.round(units @ np.frombuffer(b.column(4)[i].as_buffer(), np.float64).reshape(-1, dim).T, 12)
                take = min(k, len(scores))
                if take <= 0:
                    continue
                kth = np.partition(scores, len(scores) - take, axis=0)[len(scores) - take]
                r, q = np.nonzero(scores >= kth)
                cols = {qid_col: asked.field(0).take(pa.array(q))} | {c: rows.field(n).take(pa.array(r)) for n, c in enumerate(row_cols)}
                part = best(pa.table({**cols, "score": pa.array(scores[r, q])}).cast(schema))
                pool.append(part)
                held += len(part)
                if held > max(POOL_ROWS, 2 * limit):  # what stays is at most k rows per query
                    pool = [best(pa.concat_tables(pool))]
                    held = limit = len(pool[0])
                    if limit > POOL_ROWS:  # many queries: the shuffle's own limit goes on from here
                        yield from pool[0].to_batches(max_chunksize=10_000)
                        pool, held, limit = [], 0, 0
        if pool:
            yield from best(pa.concat_tables(pool)).to_batches(max_chunksize=10_000)

    return run
