"""Structured Streaming registrations applied to the catalog with foreachBatch."""

import json

from quarry.sources.catalog import Catalog
from quarry.streaming.catalog_stream import start_catalog_stream


def test_stream_upsert(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text("\n".join(json.dumps(r) for r in [
        {"id": "n1", "name": "one", "kind": "pc", "seq": 1}, {"id": "n2", "name": "two", "kind": "vm", "seq": 2}]))
    cat = Catalog(spark, str(tmp_path / "cat"))
    schema = "id string, name string, kind string, seq long"
    q = start_catalog_stream(spark, cat, str(landing), schema, "node", ["id"], ["seq"], "merge",
                             name="nodes_test", available_now=True, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    (landing / "b.json").write_text(json.dumps({"id": "n1", "name": "uno", "kind": None, "seq": 3}))
    q = start_catalog_stream(spark, cat, str(landing), schema, "node", ["id"], ["seq"], "merge",
                             name="nodes_test", available_now=True, checkpoint_location=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    rows = {r.id: (r.name, r.kind) for r in cat.read("node").collect()}
    assert rows == {"n1": ("uno", "pc"), "n2": ("two", "vm")}  # merge kept n1's kind; second run saw only b.json


def test_stream_of_driver_events_equals_batch_upsert(spark, tmp_path):
    import os

    import pytest as _pytest
    from pyspark.sql import functions as F

    from quarry.operators.upsert import latest_per_key

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        _pytest.skip("driver tables not present")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    cat = Catalog(spark, str(tmp_path / "cat"))
    q = start_catalog_stream(spark, cat, sf, schema, "user_state", ["user_id"], ["ts", "event_id"], "upsert",
                             name="events_stream", available_now=True, checkpoint_location=str(tmp_path / "ck"),
                             fmt="parquet", options={"pathGlobFilter": "events.parquet"})
    q.awaitTermination(300)
    got = {r.user_id: (r.event_type, r.value) for r in cat.read("user_state").collect()}
    ev = spark.read.parquet(f"{sf}/events.parquet")
    want = {r.user_id: (r.event_type, r.value)
            for r in latest_per_key(ev, ["user_id"], ["ts", "event_id"], ["event_type", "value"]).collect()}
    assert got == want and len(got) == ev.select(F.countDistinct("user_id")).first()[0]
