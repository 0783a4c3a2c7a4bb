"""Upsert vs merge semantics, versioned catalog, edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import upsert as U
from quarry.sources.catalog import Catalog


def _rows(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_upsert_replaces_merge_keeps(spark):
    base = spark.createDataFrame([("n1", "alpha", "pc", 1)], "id string, name string, kind string, seq long")
    upd = spark.createDataFrame([("n1", "alpha2", None, 2), ("n2", "beta", "vm", 3)],
                                "id string, name string, kind string, seq long")
    rep = _rows(U.upsert_table(base.drop("seq"), upd, ["id"], ["seq"]))
    assert rep["n1"]["name"] == "alpha2" and rep["n1"]["kind"] is None  # replace loses kind
    mer = _rows(U.merge_table(base.drop("seq"), upd, ["id"], ["seq"], ["name", "kind"]))
    assert mer["n1"]["name"] == "alpha2" and mer["n1"]["kind"] == "pc"  # merge keeps it
    assert mer["n2"] == {"id": "n2", "name": "beta", "kind": "vm"}


def test_latest_per_key_orders_by_struct(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, 2, "b"), (1, t, 10, "c"), (1, t - dt.timedelta(days=1), 99, "a")],
                               "k int, ts timestamp, eid int, v string")
    assert U.latest_per_key(df, ["k"], ["ts", "eid"], ["v"]).collect()[0].v == "c"


def _files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_keyed_tables_and_edges(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.upsert("node", spark.createDataFrame([("a", "x", 1)], "id string, name string, seq long"), ["id"], ["seq"])
    cat.upsert("node", spark.createDataFrame([("a", "y", 2), ("b", "z", 3)], "id string, name string, seq long"), ["id"], ["seq"])
    assert {k: v["name"] for k, v in _rows(cat.read("node")).items()} == {"a": "y", "b": "z"}
    cat.merge("node", spark.createDataFrame([("a", None, "pc", 4)], "id string, name string, kind string, seq long"), ["id"], ["seq"], ["name", "kind"])
    assert (_rows(cat.read("node"))["a"]["name"], _rows(cat.read("node"))["a"]["kind"]) == ("y", "pc")
    with pytest.raises(ValueError, match="bucketed by id"):
        cat.upsert("node", spark.createDataFrame([("q", 1)], "name string, seq long"), ["name"], ["seq"])
    e = spark.createDataFrame([("r", "a", "b"), ("r", "a", "b")], "relation string, in_id string, out_id string")
    cat.set_edges("w1", e, ["r"])
    cat.set_edges("w1", e, ["r"])
    cat.set_edges("w2", e, ["r"])
    assert cat.read("edge").count() == 2  # one copy per workspace, however often a job re-runs


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"), buckets=8)
    rows = spark.range(400).select(F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("ws"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("relpath"),
                                   F.col("id").alias("size"))
    cat.write("file", rows)
    folder = tmp_path / "cat" / "file"
    before = _files(folder)
    assert len({p.split("/part-")[0] for p in before}) == 24
    new = spark.createDataFrame([("w1", "f1", -1), ("w1", "new", -2)], "ws string, relpath string, size long")
    gone = spark.createDataFrame([("w1", "f1"), ("w1", "new"), ("w1", "f4")], "ws string, relpath string")
    cat.replace_keys("file", new, gone)
    after = _files(folder)
    changed = {p.split("/part-")[0] for p, _ in set(before.items()) ^ set(after.items())}
    touched = {r.bucket for r in gone.select(cat.bucket("file").alias("bucket")).collect()}
    assert {p.split("/")[-1] for p in changed} == {f"bucket={b}" for b in touched} and all("ws=w1" in p for p in changed)
    got = {(r.ws, r.relpath): r["size"] for r in cat.read("file").select("ws", "relpath", "size").collect()}
    want = {(f"w{i % 3}", f"f{i}"): i for i in range(400)} | {("w1", "f1"): -1, ("w1", "new"): -2}
    del want["w1", "f4"]
    assert got == want
    cat.upsert("file", spark.createDataFrame([("w2", "f2", 7)], "ws string, relpath string, size long"), ["ws", "relpath"])
    assert cat.read("file").where("ws = 'w2' AND relpath = 'f2'").first()["size"] == 7 and cat.read("file").count() == len(want)


def test_a_partition_that_loses_its_rows_goes(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"), buckets=50)
    cat.write("file", spark.createDataFrame([("w", "a"), ("w", "b")], "ws string, relpath string"))
    cat.replace_keys("file", cat.read("file").limit(0), spark.createDataFrame([("w", "a")], "ws string, relpath string"))
    assert [r.relpath for r in cat.read("file").collect()] == ["b"]
    assert len(_files(tmp_path / "cat" / "file")) == 1


def test_replace_workspace_partition(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.write("file", spark.createDataFrame([("w1", "a"), ("w1", "b"), ("w2", "c")], "ws string, relpath string"))
    cat.replace_workspace("file", "w1", spark.createDataFrame([("w1", "a")], "ws string, relpath string"))
    assert sorted((r.ws, r.relpath) for r in cat.read("file").collect()) == [("w1", "a"), ("w2", "c")]
    plan = cat.read("file").filter(F.col("ws") == "w2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "ws" in plan


def test_reports_append(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    for i in range(3):
        before = _files(tmp_path / "cat")
        cat.append("run_report", spark.createDataFrame([(f"r{i}", "s")], "run_id string, step string"))
        assert before.items() <= _files(tmp_path / "cat").items()
    assert sorted(r.run_id for r in cat.read("run_report").collect()) == ["r0", "r1", "r2"]


def test_registration_tools(spark, tmp_path):
    from quarry.plans import tools as T

    cat = Catalog(spark, str(tmp_path / "cat"))
    T.register_nodes(cat, spark.createDataFrame(
        [("n1", " ", "pc", 16, [" a ", "", "b"], 1), ("n2", "Beta", None, None, None, 2), ("n1", "Alpha", None, None, None, 3)],
        "id string, name string, kind string, ram_gb int, labels array<string>, seq long"))
    nodes = {r.id: r for r in T.list_nodes(cat).collect()}
    assert nodes["n1"].name == "Alpha" and nodes["n1"].kind is None  # re-registration replaces the record
    assert nodes["n2"].name == "Beta"
    T.register_nodes(cat, spark.createDataFrame([("n3", "", None, 1)], "id string, name string, kind string, seq long"))
    assert {r.id: r.name for r in T.list_nodes(cat).collect()}["n3"] == "n3"  # blank name -> node id
    T.register_workspaces(cat, spark.createDataFrame(
        [("w1", "/srv/a", "n1", 1), ("w2", "/srv/b", "n2", 2)], "id string, path string, node string, seq long"))
    T.register_workspaces(cat, spark.createDataFrame([("w1", "/srv/a2", "n2", 3)], "id string, path string, node string, seq long"))
    cat.write("den", spark.createDataFrame([("d1", "Den One")], "id string, name string"))
    cat.replace_edges(spark.createDataFrame(
        [("den_has_workspace", "d1", "w2", "w2")], "relation string, in_id string, out_id string, ws string"), ["den_has_workspace"])
    ws = [(r.id, r.path, r.node_id, r.node_name, r.den_id) for r in T.list_workspaces(cat).collect()]
    assert ws == [("w1", "/srv/a2", "n2", "Beta", None), ("w2", "/srv/b", "n2", "Beta", "d1")]
    assert [r.id for r in T.list_workspaces(cat, den_id="d1").collect()] == ["w2"]
    on_node = {(r.in_id, r.out_id) for r in cat.read("edge").filter("relation = 'on_node'").collect()}
    assert on_node == {("w1", "n2"), ("w2", "n2")}  # the stale w1 -> n1 edge was replaced


def test_constraint_report_catches_case_collisions(spark):
    from quarry.functions.hashing import file_id
    from quarry.operators.quality import catalog_checks

    files = spark.createDataFrame([("w", "README.md"), ("w", "readme.md"), ("w", "src/a.go")], "ws string, relpath string")
    folded = files.withColumn("id", file_id("ws", "relpath", case_fold=True))
    kept = files.withColumn("id", file_id("ws", "relpath", case_fold=False))
    nodes = spark.createDataFrame([("n1", ""), ("n2", "b")], "id string, name string")
    rep = {(r.table_name, r.check_name): r.violations for r in catalog_checks({"file": folded, "node": nodes}).collect()}
    assert rep[("file", "unique(id)")] == 1 and rep[("file", "unique(ws,relpath)")] == 0
    assert rep[("node", "name <> ''")] == 1
    rep2 = {(r.table_name, r.check_name): r.violations for r in catalog_checks({"file": kept}).collect()}
    assert rep2[("file", "unique(id)")] == 0


@pytest.mark.parametrize("size", [1, 4, 4 << 20])
def test_read_file(spark, size):
    from quarry.operators.reading import read_file, read_slices
    from quarry.operators.segments import to_segments

    text = "héllo wörld\n  two é\tthree \n"
    whole = spark.createDataFrame([("w", "a.txt", text), ("w", "none.txt", "")], "ws string, relpath string, content string")
    content = to_segments(whole, segment_bytes=size)
    for rel in ("a.txt", "none.txt"):
        for hex_mode in (False, True):
            for lo, hi in ((0, 5), (1, 4), (-3, 9), (3, 1), (5, 500), (11, 12), (0, 10**6), (40, 60)):
                for most in (None, 3):
                    req = spark.createDataFrame([("w", rel, lo, hi)], "ws string, relpath string, start int, end int")
                    want = read_slices(whole, req, hex_mode, max_chars=most).first()
                    got = read_file(content, "w", rel, lo, hi, hex_mode, most).first()
                    assert (got.chunk, got.truncated) == (want.chunk, want.truncated), (rel, hex_mode, lo, hi, most)
    with pytest.raises(ValueError, match="relative to the workspace"):
        read_file(content, "w", "/etc/passwd", 0, 1)
    with pytest.raises(FileNotFoundError):
        read_file(content, "w", "b.txt", 0, 1)


@pytest.mark.parametrize("ws", ["007", "2024-01-01", "1e3", "a=b/c %41", "true"])
def test_workspace_ids_stay_text(spark, tmp_path, ws):
    cat = Catalog(spark, str(tmp_path / "cat"))
    cat.replace_workspace("file", ws, spark.createDataFrame([(ws, "a")], "ws string, relpath string"))
    assert [tuple(r) for r in cat.read("file").select("ws", "relpath").collect()] == [(ws, "a")]
    assert cat.read("file").filter(F.col("ws") == "alpha").count() == 0
    cat.replace_workspace("file", "alpha", spark.createDataFrame([("alpha", "b")], "ws string, relpath string"))
    assert sorted(r.ws for r in cat.read("file").collect()) == sorted([ws, "alpha"])


def test_emptied_workspace_and_relation(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    none = spark.createDataFrame([], "ws string, relpath string")
    cat.write("file", spark.createDataFrame([("w1", "a"), ("w2", "b")], "ws string, relpath string"))
    cat.replace_workspace("file", "w1", none)
    assert [tuple(r) for r in cat.read("file").select("ws", "relpath").collect()] == [("w2", "b")]
    cat.replace_workspace("file", "w2", none)
    assert cat.read("file").count() == 0 and "relpath" in cat.read("file").columns
    e = spark.createDataFrame([("r", "a", "b"), ("s", "a", "c")], "relation string, in_id string, out_id string")
    cat.set_edges("w1", e, ["r", "s"])
    cat.set_edges("w1", e.filter("relation = 'none'"), ["r"])
    assert [r.relation for r in cat.read("edge").collect()] == ["s"]


def test_failed_write_changes_nothing(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "cat"))
    with pytest.raises(KeyError):
        cat.read("node")
    cat.write("node", spark.createDataFrame([("a", "x"), ("b", "y")], "id string, name string"))
    bad = cat.read("node").select("id", F.raise_error(F.lit("no")).cast("string").alias("name"), F.lit(1).alias("seq"))
    with pytest.raises(Exception, match="no"):
        cat.upsert("node", bad, ["id"], ["seq"])
    assert {r.id: r.name for r in cat.read("node").collect()} == {"a": "x", "b": "y"}


def test_upsert_without_order_refuses_two_rows_per_key(spark):
    base = spark.createDataFrame([("a", 1)], "id string, v int")
    same = spark.createDataFrame([("a", 2), ("a", 2)], "id string, v int")
    assert [tuple(r) for r in U.upsert_table(base, same, ["id"]).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="two rows for one key"):
        U.upsert_table(base, spark.createDataFrame([("a", 2), ("a", 3)], "id string, v int"), ["id"]).collect()
