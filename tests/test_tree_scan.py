"""Frontier rounds and segments: the same rows as the one-pass reader, spread over all tasks."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import tree_scan as S
from quarry.sources.workspace_fs import read_workspace


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    rng = random.Random(5)
    root = tmp_path_factory.mktemp("tree") / "ws"
    root.mkdir()
    folders = [root]
    for i in range(120):
        d = rng.choice(folders) / rng.choice([f"d{i}", f".h{i}", f"ü {i}", ".GIT", "node_modules"])
        d.mkdir(exist_ok=True)
        folders.append(d)
    for i in range(400):
        (rng.choice(folders) / rng.choice([f"f{i}.go", f".x{i}", f"_y{i}.MD", f"é{i}"])).write_bytes(rng.randbytes(rng.choice([0, 1, 50, 5000])))
    deep = root
    for i in range(60):
        deep = deep / f"l{i}"
        deep.mkdir()
        (deep / "leaf.py").write_text("x\n" * i)
    os.symlink(root, root / "loop")
    os.symlink(root / "nowhere", root / "dead")
    os.mkfifo(root / "pipe")
    return root


def rows(df):
    return sorted((r.kind, r.ws, r.relpath, r.size, r.mtime, r.sha, r.lang) for r in df.collect())


def test_same_rows_as_the_one_pass_reader_at_any_budget(spark, tree):
    want = rows(read_workspace(spark, str(tree), "w"))
    assert len(want) > 200
    for budget in (5, 20_000):
        assert rows(S.scan_tree(spark, str(tree), "w", budget)) == want
    assert rows(S.scan_tree(spark, f"file://{tree}", "w")) == want


def test_nothing_is_listed_twice_and_rounds_follow_the_budget(spark, tree, monkeypatch):
    listed = S.list_tree(spark, str(tree), 9).collect()
    assert len({r.relpath for r in listed}) == len(listed)
    rounds = []
    monkeypatch.setattr(S, "staging_path", lambda s, n, real=S.staging_path: rounds.append(real(s, n)) or rounds[-1])
    S.list_tree(spark, str(tree)).count()
    assert len(os.listdir(rounds[-1])) == 2  # the root and one round
    S.list_tree(spark, str(tree), 40).count()
    assert 3 < len(os.listdir(rounds[-1])) < 20  # sixty folders deep


def test_a_wide_folder_is_spread_over_the_tasks(spark, tmp_path):
    wide = tmp_path / "wide"
    wide.mkdir()
    for i in range(100_000):
        (wide / f"f{i}").touch()
    found = S.stat_entries(S.list_tree(spark, str(tmp_path), 1000), str(tmp_path), "w")
    per = found.groupBy(F.input_file_name()).count().agg(F.sum("count"), F.max("count"), F.count("*")).first()
    assert per[0] == 100_002
    assert per[2] >= spark.sparkContext.defaultParallelism and per[1] < 3 * per[0] / per[2]


def test_pruned_root_and_missing_root(spark, tmp_path):
    (tmp_path / "node_modules" / "a").mkdir(parents=True)
    assert S.scan_tree(spark, str(tmp_path / "node_modules"), "w").collect() == []
    r = S.scan_tree(spark, str(tmp_path / "none"), "w").collect()
    assert {x.kind for x in r} == {"reject"} and all("none" in x.error for x in r)


def test_arrow_file_system_gives_the_same_names(tree):
    from pyarrow import fs

    a, p = S.ArrowTree(str(tree), fs.LocalFileSystem()), S.PosixTree(str(tree))
    mine = sorted(x for x in a.entries("") if x[0] not in ("loop", "dead", "pipe"))
    assert mine == sorted(x for x in p.entries("") if x[0] not in ("loop", "dead", "pipe"))
    name = next(n for n, k in mine if k == "file")
    assert a.stat(name)[:2] == p.stat(name)[:2]
    with a.open(name) as x, p.open(name) as y:
        assert x.read(10) == y.read(10)


def test_contents_in_segments(spark, tree):
    found = S.stat_entries(S.list_tree(spark, str(tree)), str(tree), "w").where("kind = 'file'")
    got = {}
    for r in S.read_files(found, str(tree), 700).orderBy("relpath", "segment").collect():
        data, sha = got.get(r.relpath, (b"", None))
        assert r["at"] == len(data) and sha is None
        got[r.relpath] = (data + bytes(r.content), r.sha)
    assert len(got) == found.count()
    for rel, (data, sha) in got.items():
        assert data == (tree / rel).read_bytes() and sha == hashlib.sha256(data).hexdigest()


def test_a_file_that_vanishes_is_a_reject(spark, tmp_path):
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    listed = S.list_tree(spark, str(tmp_path))
    (tmp_path / "b").unlink()
    got = {r.relpath: r.kind for r in S.stat_entries(listed, str(tmp_path), "w").collect()}
    assert got == {"": "dir", "a": "file", "b": "reject"}
    read = S.read_files(listed.where("kind = 'file'").withColumn("ws", F.lit("w")).withColumn("size", F.lit(1)), str(tmp_path)).collect()
    assert {r.relpath: r.error is None for r in read} == {"a": True, "b": False}
