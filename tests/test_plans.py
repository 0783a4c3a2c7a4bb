"""Plan checks over every registered query: no pair blow-ups, no row-at-a-time Python, pruned scans."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_no_row_udf(spark):
    from quarry.plans.registry import queries

    for name, q in queries().items():
        if name == "pca_explained":
            continue
        plan = _plan(q(spark, SF))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name  # only Arrow-batched Python


def test_scans_are_pruned(spark):
    from quarry.plans.registry import queries

    plan = _plan(queries()["run_ids"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    plan = _plan(queries()["vector_search_ws"](spark, SF))
    assert "TakeOrderedAndProject" in plan or "WindowGroupLimit" in plan


def test_per_group_topk_limits_before_shuffle(spark):
    from quarry.plans.registry import queries

    for name in ("find_file_suffix", "text_search_cs", "vector_search_ws", "vector_search_file"):
        plan = _plan(queries()[name](spark, SF))
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_centroid_partial_aggregation(spark):
    from quarry.plans.registry import queries

    plan = _plan(queries()["workspace_centroid"](spark, SF))
    assert "partial_aggregate_metrics" in plan or "partial_" in plan
    assert "Generate" not in plan.split("ObjectHashAggregate")[-1]  # no per-element explode under the aggregate


def test_no_exchange_carries_file_content(spark):
    from quarry.plans.registry import queries

    for name in ("token_chunks", "chunk_snippet", "embed_pipeline", "embeddable_files", "text_search_maxbytes"):
        plan = _plan(queries()[name](spark, SF))
        for line in plan.split("\n"):
            assert "Exchange" not in line or ("content" not in line and "chunk_text" not in line), name
        assert "REBALANCE" not in plan.upper(), name
