"""Tree-scan data source and the index jobs end to end (ported e2e: tiny workspace, constant embedder)."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators.embedding import embedder_from_function
from quarry.plans import index_jobs as J
from quarry.plans import tools as T
from quarry.sources.catalog import Catalog
from quarry.sources.workspace_fs import read_workspace


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ws"
    (root / "src").mkdir(parents=True)
    (root / "README.md").write_text("# Sample Repo\nTest corpus\n")
    (root / "src" / "main.go").write_text("package main\nfunc main(){}\n")
    (root / ".hidden").write_text("dot file\n")
    (root / "_under.txt").write_text("underscore\n")
    (root / "empty.txt").write_text("")
    (root / "emptydir").mkdir()
    (root / ".git").mkdir()
    (root / ".git" / "config").write_text("[core]\n")
    (root / "web" / "Node_Modules" / "pkg").mkdir(parents=True)
    (root / "web" / "Node_Modules" / "pkg" / "x.js").write_text("x")
    (root / "bin.dat").write_bytes(b"\x00\x01binary")
    (root / "big.txt").write_text("word " * 60000)  # a file of many chunks
    (root / "crlf.txt").write_bytes(b"first line\r\nsecond NEEDLE line\r\n")
    os.symlink(root / "README.md", root / "link.md")
    return root


def test_scan_inventory(spark, tree):
    for parts in (1, 3, 50):
        rows = read_workspace(spark, str(tree), "alpha", partitions=parts).collect()
        dirs = sorted(r.relpath for r in rows if r.kind == "dir")
        files = {r.relpath: r for r in rows if r.kind == "file"}
        assert dirs == ["", "emptydir", "src", "web"], parts
        assert sorted(files) == [".hidden", "README.md", "_under.txt", "big.txt", "bin.dat", "crlf.txt", "empty.txt",
                                 "src/main.go"], parts
    r = files["README.md"]
    assert r.size == 26 and r.lang == "markdown" and r.ws == "alpha"
    assert r.sha == hashlib.sha256(b"# Sample Repo\nTest corpus\n").hexdigest()
    assert files[".hidden"].lang == "hidden" and files["empty.txt"].size == 0
    root_dir = [x for x in rows if x.kind == "dir" and x.relpath == ""][0]
    assert root_dir.sha == hashlib.sha256(str(tree).encode()).hexdigest()  # a directory 'hash' is its path's hash
    assert all(x.content is None for x in rows)


def test_scan_content_and_skipped_root(spark, tree, tmp_path):
    rows = read_workspace(spark, str(tree), "alpha", content=True).filter("relpath = 'src/main.go'").collect()
    assert rows[0].content == b"package main\nfunc main(){}\n"
    skipped = tmp_path / "node_modules"
    skipped.mkdir()
    (skipped / "a.txt").write_text("a")
    assert read_workspace(spark, str(skipped), "x").count() == 0  # the skip rule applies to the root too


def test_index_all_end_to_end(spark, tree, tmp_path):
    const = embedder_from_function(
        lambda texts: np.tile(np.array([0.1, 0.2, 0.3, 0.4], dtype=np.float32), (len(texts), 1)), 4, "fake")
    cat = Catalog(spark, str(tmp_path / "catalog"))
    rep = J.index_all(spark, cat, str(tree), "workspace-alpha", const, "nomic-embed-text-v1.5", str(tmp_path / "runs"))
    assert rep.acceptance == "pass" and rep.finished is not None and rep.run_id.startswith("RUN-")
    assert "chunk content_sha recomputes: 84/84" in rep.notes and "files catalogued: 8/8" in rep.notes, rep.notes
    assert len(rep.artifact_paths) == 3
    files = cat.read("file")
    assert files.count() == 8
    chunks = cat.read("vector_chunk").collect()
    # embeddable: non-empty, no NUL, of any size
    assert sorted({c.relpath for c in chunks}) == [".hidden", "README.md", "_under.txt", "big.txt", "crlf.txt", "src/main.go"]
    assert all(c.model == "nomic-embed-text-v1-5" and c.native_dim == 4 for c in chunks)
    wsv = cat.read("workspace_vector").collect()
    assert len(wsv) == 1 and wsv[0].sample == len(chunks)
    assert np.allclose(wsv[0].vector, [0.1, 0.2, 0.3, 0.4], atol=1e-6)  # centroid of constants
    model = cat.read("vector_model").collect()[0]
    assert (model.id_slug, model.family, model.version, model.native_dim) == (
        "nomic-embed-text-v1-5", "nomic", "embed-text-v1.5", 4)
    rels = {r.relation for r in cat.read("edge").collect()}
    assert rels == {"ws_contains_dir", "dir_contains_dir", "dir_contains_file", "file_has_vector", "workspace_has_vector"}
    assert cat.read("run_report").count() == 1
    from quarry.schemas import SCHEMAS
    for name, ddl in SCHEMAS.items():
        if cat.exists(name):
            assert sorted(cat.read(name).columns) == sorted(spark.createDataFrame([], ddl).columns), name
    dirs_file = [p for p in rep.artifact_paths if p.endswith("dirs.ndjson")][0]
    assert all(r.mtime for r in spark.read.json(dirs_file).collect())
    # re-running adds no duplicate edges
    J.index_scan(spark, cat, str(tree), "workspace-alpha", str(tmp_path / "runs"))
    e = cat.read("edge")
    assert e.count() == e.dropDuplicates().count()

    hits = T.search_text(cat, "workspace-alpha", "needle").collect()
    assert [(h.relpath, h.line_number, h.snippet) for h in hits] == [("crlf.txt", 2, "second NEEDLE line")]
    assert T.find_file(cat, "workspace-alpha", "main", "substring").collect()[0].relpath == "src/main.go"
    out = T.read_file(cat, "workspace-alpha", "README.md", 2, 14).collect()[0]
    assert out.chunk == "Sample Repo\n" and not out.truncated
    with pytest.raises(FileNotFoundError):
        T.read_file(cat, "workspace-alpha", "missing.md", 0, 1)
    res = T.workspace_vector_search(cat, "workspace-alpha", "find the readme", const, top_k=3).collect()
    assert len(res) == 3 and all(abs(r.score - 1.0) < 1e-6 for r in res)
    fres = T.file_vector_search(cat, "workspace-alpha", "README.md", "anything", const).collect()
    assert len(fres) == 1 and fres[0].snippet == "# Sample Repo Test corpus"
    with pytest.raises(LookupError):
        T.workspace_vector_search(cat, "workspace-alpha", "q", const, model_id="vector_model:other")
    d, f = T.workspace_tree(cat, "workspace-alpha")
    assert [r.relpath for r in d.collect()][:2] == ["", "emptydir"]


def test_case_fold_collision_is_reported(spark, tmp_path):
    root = tmp_path / "cf"
    root.mkdir()
    (root / "README.md").write_text("upper\n")
    (root / "readme.md").write_text("lower\n")
    const = embedder_from_function(
        lambda texts: np.ones((len(texts), 2), dtype=np.float32), 2, "ones")
    cat = Catalog(spark, str(tmp_path / "catalog"))
    rep = J.index_all(spark, cat, str(root), "w", const, "m", str(tmp_path / "runs"), case_fold=True)
    assert rep.acceptance == "fail"
    assert any("file.unique(id)" in r for r in rep.risks), rep.risks
    ok = J.index_all(spark, Catalog(spark, str(tmp_path / "catalog2")), str(root), "w", const, "m", str(tmp_path / "runs"))
    assert ok.acceptance == "pass", ok.risks  # ids keep case by default: no collision


def _model_inventory(root):
    """What a pruned, symlink-skipping walk sees: (kind, relpath, size)."""
    from quarry.sources.workspace_fs import should_skip_dir

    out = {("dir", "", None)}
    for cur, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if not should_skip_dir(d) and not os.path.islink(os.path.join(cur, d))]
        rel = os.path.relpath(cur, root)
        rel = "" if rel == "." else rel
        for d in dirs:
            out.add(("dir", f"{rel}/{d}" if rel else d, None))
        for f in files:
            p = os.path.join(cur, f)
            if os.path.islink(p) or not os.path.isfile(p):
                continue
            out.add(("file", f"{rel}/{f}" if rel else f, os.path.getsize(p)))
    return out


def test_scan_matches_walk_model_on_random_trees(spark, tmp_path):
    import random

    rng = random.Random(9)
    names = ["a", "B", "src", ".git", "node_modules", "Lib", ".vscode", "_x", ".hidden", "docs", "e f", "ü"]
    pruned_seen = 0
    for t in range(3):
        root = tmp_path / f"r{t}"
        root.mkdir()
        dirs = [root]
        for _ in range(40):
            parent = rng.choice(dirs)
            name = rng.choice(names) + rng.choice(["", "", "1", "2"])
            path = parent / name
            if path.exists():
                continue
            kind = rng.random()
            if kind < 0.3:
                path.mkdir()
                dirs.append(path)
                pruned_seen += name in (".git", "node_modules", ".vscode")
            elif kind < 0.9:
                path.write_bytes(bytes(rng.randint(0, 255) for _ in range(rng.randint(0, 50))))
            else:
                os.symlink(root, path)  # a link to a directory is not followed
        want = _model_inventory(str(root))
        for parts in (1, 4, 64):
            rows = read_workspace(spark, str(root), "w", partitions=parts).collect()
            got = {(r.kind, r.relpath, r.size) for r in rows}
            assert got == want, (t, parts)
            assert len(rows) == len(got)  # no row emitted twice
    assert pruned_seen > 0
