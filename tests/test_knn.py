"""Exact KNN: single query, per-group, batch (mapInArrow) against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import knn
from quarry.operators.knn import batch_knn, top_k, vector_search


def _brute(vecs, ids, q, k):
    out = []
    qn = np.linalg.norm(q, axis=1)
    for j in range(len(q)):
        s = []
        for i, v in zip(ids, vecs):
            vn = np.linalg.norm(v)
            if vn == 0 or qn[j] == 0:
                continue
            s.append((-(float(np.dot(v, q[j]) / (vn * qn[j]))), i))
        out.append([i for _, i in sorted(s)[:k]])
    return out


@pytest.mark.parametrize("sent", [0, 1 << 24])
@pytest.mark.parametrize("pool", [20, 500_000])
def test_batch_knn_matches_brute_force(spark, monkeypatch, sent, pool):
    monkeypatch.setattr(knn, "BLOCK_VALUES", 160)
    monkeypatch.setattr(knn, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(knn, "POOL_ROWS", pool)
    rng = np.random.default_rng(7)
    n, d, nq, k = 3000, 16, 25, 7
    vecs = rng.normal(size=(n, d)).astype(np.float32)
    vecs[5] = 0  # zero vector: never returned
    vecs[10] = vecs[11]  # exact tie: broken by id
    ids = [f"c{i:05d}" for i in range(n)]
    q = rng.normal(size=(nq, d))
    q[3] = 0  # zero query: no rows
    q[4] = vecs[10]
    chunks = spark.createDataFrame([(ids[i], vecs[i].tolist()) for i in range(n)], "id string, vector array<float>").repartition(6)
    queries = spark.createDataFrame([(j, q[j].tolist()) for j in range(nq)], "query_id int, query_vector array<double>")
    res = batch_knn(chunks, queries, k).collect()  # several tiles of queries
    got = {}
    for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    want = _brute(vecs.astype(np.float64), ids, q, k)
    for j in range(nq):
        if j == 3:
            assert j not in got
        else:
            assert got[j] == want[j], j
    assert got[4][:2] == ["c00010", "c00011"]


def test_vector_search_filters_before_topk(spark):
    rows = [("a", "w1", [1.0, 0.0]), ("b", "w2", [1.0, 0.0]), ("c", "w1", [0.0, 1.0]), ("d", "w1", [0.0, 0.0]),
            ("e", "w1", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, ws string, vector array<float>")
    res = vector_search(df, [1.0, 0.0], 5, filters=[F.col("ws") == "w1"]).collect()
    assert [r.id for r in res] == ["a", "c"]  # zero norm and other width dropped; w2 filtered first
    per = top_k(df.withColumn("score", F.lit(1.0)), 1, group_cols=["ws"]).collect()
    assert sorted(r.id for r in per) == ["a", "b"]


def test_topk_plans(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("g"),
                                  F.rand(1).alias("score"))
    single = top_k(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in single
    grouped = top_k(df, 5, group_cols=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in grouped and "CartesianProduct" not in grouped


def test_equal_vectors_and_mixed_widths(spark):
    same = spark.range(20_000).select(F.format_string("c%05d", "id").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    wide = spark.createDataFrame([("w", [1.0, 0.0, 0.0])], "id string, vector array<double>")
    queries = [(j, [1.0, 2.0]) for j in range(50)] + [(90, [2.0, 0.0, 0.0]), (91, None), (92, [1.0] * 7)]
    q = spark.createDataFrame(queries, "query_id int, query_vector array<double>")
    got = {}
    for r in batch_knn(same.unionByName(wide).repartition(4), q, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert set(got) == {*range(50), 90} and got[90] == [(1, "w")]
    assert all(sorted(got[j]) == [(i + 1, f"c{i:05d}") for i in range(5)] for j in range(50))
    plan = batch_knn(same, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_queries_do_not_pass_the_driver_and_chunks_are_scanned_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    spark.range(500).select(F.col("id").cast("string").alias("id"), F.array(*[F.rand(i) for i in range(4)]).alias("vector")).write.parquet(f"{tmp_path}/c")
    q = spark.range(40).select(F.col("id").alias("query_id"), F.array(*[F.rand(9 + i) for i in range(4)]).alias("query_vector"))
    for name in ("toLocalIterator", "collect", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(knn, "BLOCK_VALUES", 16)  # ten tiles
    plan = batch_knn(spark.read.parquet(f"{tmp_path}/c"), q, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/c") == 1 and "WindowGroupLimit" in plan
