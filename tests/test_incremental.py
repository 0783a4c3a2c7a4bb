"""Re-indexing reads, cuts, embeds and rewrites only what changed."""

import os
import re

import numpy as np
import pytest

from quarry.operators.delta import capture, distinct_new
from quarry.operators.embedding import HashEmbedder
from quarry.plans import index_jobs as J
from quarry.sources.catalog import Catalog


def note(report, word):
    return next(n for n in report.notes if n.startswith(word))


def state(cat):
    files = {r.relpath: (r["size"], r.sha, r.id) for r in cat.read("file").collect()}
    dirs = {r.relpath for r in cat.read("directory").collect()}
    chunks = {(r.relpath, r.chunk_index): (r.start, r.end, r.content_sha, tuple(r.vector)) for r in cat.read("vector_chunk").collect()}
    edges = {(r.relation, r.in_id, r.out_id) for r in cat.read("edge").collect()}
    cents = {(r.ws, r.model): (r.sample, tuple(np.round(r.vector, 5))) for r in cat.read("workspace_vector").collect()}
    content = {}
    for r in cat.read("content").orderBy("relpath", "segment").collect():
        content[r.relpath] = content.get(r.relpath, b"") + bytes(r.content)
    return files, dirs, chunks, edges, cents, content


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ws"
    for i in range(30):
        p = root / f"d{i % 5}" / f"f{i}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("".join(f"word{i} line {j}\n" for j in range(3 * i)) + "shared tail\n" * 40)
    (root / "bin").write_bytes(b"\0\1")
    (root / "empty").write_text("")
    return root


def test_second_run_touches_only_changes(spark, tree, tmp_path):
    emb = HashEmbedder(8)
    cat = Catalog(spark, str(tmp_path / "cat"), buckets=8)
    run = lambda c, **kw: J.index_all(spark, c, str(tree), "w", emb, "m", str(tmp_path / "runs"), max_tokens=16, **kw)
    first = run(cat)
    assert first.acceptance == "pass", first.risks
    assert note(first, "files") == "files: 0 same, 0 changed, 32 added, 0 removed"
    cut, embedded = map(int, re.findall(r"(\d+) (?:cut|embedded)", note(first, "chunks")))
    assert 0 < embedded < cut  # the shared tails are embedded once
    again = run(cat)
    assert note(again, "files") == "files: 32 same, 0 changed, 0 added, 0 removed"
    assert note(again, "chunks") == "chunks: 0 cut, 0 embedded, 0 contents carried over" and again.acceptance == "pass"

    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "cat").rglob("*.parquet"))}
    (tree / "d1" / "f6.txt").write_text("a new text\n" + "shared tail\n" * 40)
    (tree / "d2" / "f7.txt").unlink()
    (tree / "d9").mkdir()
    (tree / "d9" / "new.txt").write_text((tree / "d3" / "f8.txt").read_text())
    for p in (tree / "d4").iterdir():
        p.unlink()
    (tree / "d4").rmdir()
    third = run(cat)
    assert third.acceptance == "pass", third.risks
    assert note(third, "files") == "files: 24 same, 1 changed, 1 added, 7 removed"
    cut, embedded, carried = map(int, re.findall(r"(\d+)", note(third, "chunks")))
    assert embedded < 10 and carried > 0  # the copy's chunks are known
    kept = {p for p, t in before.items() if os.path.exists(p) and os.stat(p).st_mtime_ns == t}
    assert sum("/content/" in p for p in kept) > 0 and sum("/file/" in p for p in kept) > 0

    fresh = Catalog(spark, str(tmp_path / "fresh"), buckets=8)
    run(fresh)
    got, want = state(cat), state(fresh)
    for a, b in zip(got, want):
        assert a == b
    assert run(cat, full=True).acceptance == "pass" and state(cat) == want
    other = J.index_embed(spark, cat, "w", emb, "m", str(tmp_path / "runs"), max_tokens=5)
    assert other.acceptance == "pass" and int(re.search(r"(\d+) cut", note(other, "chunks"))[1]) > 0  # other settings cut anew


def test_capture(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "y"), ("e", 5, None)], "k string, n int, s string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 4, "y"), ("d", 5, "z")], "k string, n int, s string")
    assert {r.k: r.status for r in capture(old, new, ["k"], ["n", "s"]).collect()} == {"a": "same", "b": "same", "c": "changed", "d": "added", "e": "removed"}
    assert capture(old.limit(0), new.limit(0), ["k"], ["n"]).collect() == []


def test_distinct_new(spark):
    rows = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "b"), ("s3", "c")], "content_sha string, chunk_text string")
    known = spark.createDataFrame([("s2",), ("s2",)], "content_sha string")
    assert sorted(tuple(r) for r in distinct_new(rows, known).collect()) == [("s1", "a"), ("s3", "c")]


def test_unreadable_file_fails_the_run_and_is_reported(spark, tree, tmp_path, monkeypatch):
    (tree / "gone.txt").write_text("x")
    real = J.list_tree

    def listed(s, root, *a):
        out = real(s, root, *a)
        out.count()
        os.unlink(tree / "gone.txt")
        return out

    monkeypatch.setattr(J, "list_tree", listed)
    cat = Catalog(spark, str(tmp_path / "cat"), buckets=4)
    rep = J.index_scan(spark, cat, str(tree), "w", str(tmp_path / "runs"))
    assert rep.acceptance == "fail" and "1 unreadable" in rep.risks[0]
    assert cat.read("file").count() == 32


def test_vectors_are_stored_once(spark, tree, tmp_path):
    """What a run stages of chunks and vectors is gone at its end, and their artefact is compressed."""
    from quarry.session import checkpoint_root

    staged = lambda: {p for p in os.listdir(checkpoint_root(spark)) if re.match("quarry-(new-chunks|new-vectors|known-vectors|chunk-rows)-", p)}
    before, cat = staged(), Catalog(spark, str(tmp_path / "cat"), buckets=4)
    for change in (None, "d1/f6.txt"):
        if change:
            (tree / change).write_text("a new text\n" + "shared tail\n" * 40)
        rep = J.index_all(spark, cat, str(tree), "w", HashEmbedder(8), "m", str(tmp_path / "runs"), max_tokens=16)
        assert rep.acceptance == "pass" and staged() == before
        path = next(p for p in rep.artifact_paths if p.endswith("vectors.ndjson"))
        assert not [p for p in os.listdir(path) if p.endswith(".json")]
        rows = {(r["relpath"], r["index"]): tuple(np.float32(r["vector"]).tolist()) for r in spark.read.json(path).collect()}
        kept = {(r.relpath, r.chunk_index): tuple(np.float32(r.vector).tolist()) for r in cat.read("vector_chunk").collect()}
        assert rows and rows == ({k: v for k, v in kept.items() if k[0] == change} if change else kept)
