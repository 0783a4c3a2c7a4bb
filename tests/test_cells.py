"""Pruned top-k equals a full scan: clustered, skewed and tied vectors, several widths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells as C
from quarry.operators import knn
from quarry.operators.knn import batch_knn


def vectors(kind, rng, n=900, d=12):
    if kind == "clustered":
        centres = rng.normal(size=(20, d))
        return centres[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, d))
    if kind == "skewed":  # a third of all rows are one vector, a third lies close to it
        x = rng.normal(size=(n, d))
        x[: n // 3] = x[0]
        x[n // 3: 2 * n // 3] = x[0] + 0.01 * rng.normal(size=(n // 3, d))
        return x
    if kind == "tied":
        return rng.integers(-1, 2, (n, d)).astype(float)[:, :4].repeat(3, axis=1)
    return rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["clustered", "skewed", "tied", "random"])
def test_same_rows_as_a_full_scan(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_VALUES", 1200)
    rng = np.random.default_rng(3)
    x = vectors(kind, rng)
    rows = [(f"c{i:05}", v.tolist(), i) for i, v in enumerate(x)]
    rows += [("zero", [0.0] * 12, -1), ("none", None, -2), ("empty", [], -3), ("w1", [1.0, 2.0], -4), ("w2", [2.0, 1.0], -5)]
    chunks = spark.createDataFrame(rows, "id string, vector array<double>, n long").repartition(5)
    asked = [(i, (x[rng.integers(0, len(x))] + 0.02 * rng.normal(size=12)).tolist()) for i in range(40)]
    asked += [(100, [0.0] * 12), (101, None), (102, [1.0, 1.0]), (103, [1.0, 2.0, 3.0]), (104, x[5].tolist())]
    queries = spark.createDataFrame(asked, "query_id int, query_vector array<double>")
    index = C.build(chunks, str(tmp_path / "index"), carry_cols=["n"], cells=20)
    assert index.cells.agg(F.sum("n")).first()[0] == (np.linalg.norm(x, axis=1) > 0).sum() + 2
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.n, round(r.score, 9)) for r in df.collect())
    for k in (1, 7) if kind == "tied" else (7,):
        got, work = C.search(index, queries, k)
        assert key(got) == key(batch_knn(chunks, queries, k, carry_cols=["n"]))
        skipped, looked = work.agg(F.sum("skipped"), F.sum("looked_into")).first()
        if kind == "clustered":
            assert skipped > 3 * looked
        assert work.count() == 42


def test_only_needed_partitions_are_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(vectors("clustered", rng))], "id string, vector array<double>")
    index = C.build(chunks, str(tmp_path / "index"), cells=20)
    asked = C._bounds(index, chunks.limit(1), "id", "vector").select("qid", "dim", "unit", F.explode(F.slice("cells", 1, 1)).alias("c")).select("qid", "dim", "unit", "c.cell")
    cell = asked.first().cell
    plan = index.blocks.where(F.col("cell").isin([cell]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and f"(cell" in plan


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "id string, vector array<double>")
    index = C.build(none, str(tmp_path / "a"))
    got, work = C.search(index, spark.createDataFrame([(1, [1.0])], "query_id int, query_vector array<double>"), 3)
    assert got.collect() == [] and work.collect() == []
    index = C.build(spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<double>"), str(tmp_path / "b"))
    got, _ = C.search(index, spark.createDataFrame([], "query_id int, query_vector array<double>"), 3)
    assert got.collect() == []
