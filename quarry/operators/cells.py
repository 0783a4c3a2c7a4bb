"""Exact cosine top-k over a cell-partitioned chunk table.

``build`` fits centres on a bounded sample, gives every vector to its nearest centre and writes blocks of vectors
partitioned by cell, with each cell's centre, its greatest angle to a member (its radius) and its size. A vector of a
cell is at least ``angle(query, centre) - radius`` away from a query (the triangle inequality holds for
angles), so ``search`` first looks into the most promising cells of a query, and then only into those whose
bound is not below the k-th best score found. Results are those of a full scan, ties included; a poor fit costs
time, not rows. Only partitions that some query needs are read.

Vectors are compared within their width; each width has its own cells. Vectors and queries that are NULL, empty, zero
or not finite have no direction and are left out. Repeated vectors and a hot cell are blocks like any others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators import knn
from quarry.operators.knn import _packed, _scorer, top_k
from quarry.session import ship_package
from quarry.sources.staging import written

#: Cells per width, and vectors per cell that the centres are fitted on: bounds of what is fitted on the driver.
CELLS, SAMPLE_PER_CELL, ROUNDS = 64, 40, 8
#: Added to bounds, for rounding.
SLACK = 1e-9


@dataclass
class CellIndex:
    """``blocks`` (cell, dim, rows, units) partitioned by cell; ``cells`` (cell, dim, centre, radius, n): a row per cell."""
    blocks: DataFrame
    cells: DataFrame
    row_cols: list[str]


def _fit(x: np.ndarray, n: int) -> np.ndarray:
    """Unit centres of spherical k-means on a sample of unit vectors; spread first centres, a few rounds."""
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), 1)]
    far = x @ centres[0]
    while len(centres) < min(n, len(x)) and far.min() < 1 - 1e-12:
        centres = np.vstack([centres, x[int(far.argmin())]])
        far = np.maximum(far, x @ centres[-1])
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centres


def build(chunks: DataFrame, path: str, id_col: str = "id", vec_col: str = "vector", carry_cols: Sequence[str] = (),
          cells: int = CELLS) -> CellIndex:
    """Write the index of ``chunks`` below ``path``. At most ``cells * SAMPLE_PER_CELL`` vectors of a width are sampled."""
    spark = chunks.sparkSession
    ship_package(spark)
    row_cols = [id_col, *carry_cols]
    packed = written(_packed(chunks, row_cols, vec_col, knn.BLOCK_VALUES), "cell-blocks")
    sizes = packed.groupBy("dim").agg(F.sum(F.size("rows")).alias("n")).collect()  # a row per width
    centres: dict[int, np.ndarray] = {}
    first: dict[int, int] = {}
    for r in sorted(sizes):
        want = cells * SAMPLE_PER_CELL
        some = _sampled(packed.where(F.col("dim") == r.dim), r.dim, min(1.0, want / r.n)).limit(want).collect()
        first[r.dim] = sum(map(len, centres.values()))
        x = np.stack([np.frombuffer(s.unit, np.float64) for s in some]) if some else np.eye(1, r.dim)
        centres[r.dim] = _fit(x, cells)
    model = spark.sparkContext.broadcast((centres, first))
    out = T.StructType([*packed.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    schema = to_arrow_schema(out)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first = model.value
        for b in batches:
            for i in range(b.num_rows):
                dim, rows = b.column(0)[i].as_py(), b.column(1)[i].values
                units = np.frombuffer(b.column(2)[i].as_buffer(), np.float64).reshape(-1, dim)
                near = units @ centres[dim].T
                own = near.argmax(1)
                angle = np.arccos(np.clip(near.max(1), -1, 1))
                for c in np.unique(own).tolist():
                    at = np.flatnonzero(own == c)
                    listed = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), rows.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), listed.cast(schema.field("rows").type), pa.array([units[at].tobytes()], pa.binary()),
                         pa.array([first[dim] + c], pa.int32()), pa.array([float(angle[at].max())])], schema=schema)

    packed.mapInArrow(assign, out).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    blocks = spark.read.schema(out).parquet(f"{path}/blocks")
    stats = blocks.groupBy("cell", "dim").agg(F.max("radius").alias("radius"), F.sum(F.size("rows")).alias("n"))
    middle = spark.createDataFrame([(first[d] + i, [float(v) for v in c]) for d, m in centres.items() for i, c in enumerate(m)], "cell int, centre array<double>")
    cells_ = stats.join(middle, "cell")
    cells_.write.mode("overwrite").parquet(f"{path}/cells")
    return CellIndex(blocks, spark.read.schema(cells_.schema).parquet(f"{path}/cells"), row_cols)


def open_index(spark: SparkSession, path: str, row_cols: Sequence[str]) -> CellIndex:
    """The index that was built below ``path`` over at least one vector."""
    return CellIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/cells"), list(row_cols))


def _sampled(packed: DataFrame, dim: int, share: float) -> DataFrame:
    """(unit): about ``share`` of a width's vectors, each by a hash of its own bytes, equal ones once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([raw[k:k + 8 * dim] for k in range(0, len(raw), 8 * dim)], pa.binary())], ["unit"])

    units = packed.select("units").mapInArrow(run, "unit binary")
    return units.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 30)) < int(share * 1.2 * (1 << 30)) + 1).distinct().orderBy(F.xxhash64("unit"))


def _bounds(index: CellIndex, queries: DataFrame, qid_col: str, qvec_col: str) -> DataFrame:
    """(qid, dim, unit, cells): each query's unit vector and its width's cells (bound, cell), most promising first."""
    # a row per cell and width: at most CELLS centres a width
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    rows = index.cells.orderBy("cell").collect()
    for dim in {r.dim for r in rows}:
        mine = [r for r in rows if r.dim == dim]
        known[dim] = (np.array([r.cell for r in mine]), np.array([r.centre for r in mine]), np.array([r.radius for r in mine]))
    model = queries.sparkSession.sparkContext.broadcast(known)
    out = T.StructType([T.StructField("qid", queries.schema[qid_col].dataType)]).add("dim", T.IntegerType()).add("unit", T.ArrayType(T.DoubleType())).add("cells", T.ArrayType(T.StructType.fromDDL("bound double, cell int")))
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for qid, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v is None or len(v) not in model.value or not 0 < np.linalg.norm(v) < np.inf:
                    continue
                unit = np.array(v) / np.linalg.norm(v)
                cell, centre, radius = model.value[len(v)]
                angle = np.arccos(np.clip(centre @ unit, -1, 1))
                bound = np.cos(np.maximum(angle - radius, 0)) + SLACK
                order = np.lexsort((cell, angle, -bound))
                found = [{"bound": float(bound[k]), "cell": int(cell[k])} for k in order]
                for c, x in zip(cols, (qid, len(v), unit.tolist(), found)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).cast("array<double>").alias("v")).mapInArrow(run, out)


def _scores(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    """Best k rows per query of ``asked(cell, qid, dim, unit)``, by cell; other partitions are not read."""
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # at most one per cell
    tiles = _packed_by_cell(asked)
    pairs = index.blocks.where(F.col("cell").isin(cells)).drop("radius").join(tiles, ["cell", "dim"])
    schema = T.StructType([asked.schema["qid"]])
    element = index.blocks.schema["rows"].dataType.elementType
    for c in index.row_cols:
        schema = schema.add(c, element[c].dataType)
    schema = schema.add("score", T.DoubleType())
    found = pairs.select("dim", "rows", "units", "asked", "wanted").mapInArrow(_scorer(k, "qid", index.row_cols, to_arrow_schema(schema)), schema)
    return written(top_k(found, k, "score", index.row_cols[0], ["qid"]), "cell-scores")


def _packed_by_cell(asked: DataFrame) -> DataFrame:
    """(cell, dim, asked, wanted): tiles of a bounded number of queries per cell, whatever a cell's share of them is."""
    rows = max(1, knn.BLOCK_VALUES // 1024)
    numbered = asked.withColumn("tile", F.pmod(F.xxhash64("qid"), F.lit(max(1, asked.count() // (rows * CELLS) + 1))))
    tiles = numbered.groupBy("cell", "dim", "tile").agg(F.collect_list(F.struct("qid", "unit")).alias("q"))
    flat = F.flatten(F.transform("q", lambda x: x.unit))
    return tiles.select("cell", "dim", F.transform("q", lambda x: F.struct(x.qid.alias("qid"))).alias("asked"), _doubles(flat).alias("wanted"))


def _doubles(values):
    @F.arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([np.asarray(v.values, np.float64).tobytes() for v in x], pa.binary())

    return run(values)


def search(index: CellIndex, queries: DataFrame, k: int, qid_col: str = "query_id", qvec_col: str = "query_vector", probe: int = 2) -> tuple[DataFrame, DataFrame]:
    """(results, work): qid, the index's columns, score and rank, as ``knn.batch_knn``; and per query the cells looked into and skipped.

    ``probe`` cells of each query are looked into first; they set the score below which cells are skipped.
    """
    bounds = written(_bounds(index, queries, qid_col, qvec_col), "cell-bounds")
    base = bounds.select("qid", "dim", "unit", F.posexplode("cells").alias("place", "c")).select("qid", "dim", "unit", "place", "c.*")
    first = _scores(index, base.where(F.col("place") < probe), k)
    kth = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("kth"))
    rest = base.where(F.col("place") >= probe).join(kth, "qid", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(-2.0)))
    rest = written(rest.drop("kth"), "cell-rest")
    found = first.unionByName(_scores(index, rest, k)) if not rest.isEmpty() else first
    work = bounds.select("qid", F.size("cells").alias("cells")).join(rest.groupBy("qid").count(), "qid", "left")
    looked = F.least(F.lit(probe), F.col("cells")) + F.coalesce("count", F.lit(0))
    work = work.select(F.col("qid").alias(qid_col), looked.alias("looked_into"), (F.col("cells") - looked).alias("skipped"))
    return top_k(found.withColumnRenamed("qid", qid_col), k, "score", index.row_cols[0], [qid_col], rank_col="rank"), work
