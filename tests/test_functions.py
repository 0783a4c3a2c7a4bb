"""Scalar expressions: paths, ids, text, slices, snippets."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import paths as P
from quarry.functions import text as X


def test_detect_language(one_row):
    cases = {
        "main.go": "go", "a/b/Tool.PY": "python", "x.rs": "rust", "README.md": "markdown", "Makefile": "text",
        ".gitignore": "gitignore", "foo.": "", "archive.tar.gz": "gz", "dir.d/file": "text", "s.bash": "shell",
        "c.yml": "yaml", "w.ps1": "powershell", "t.TSX": "tsx",
    }
    rows = one_row([(k,) for k in cases], "p string", F.col("p"), P.detect_language("p").alias("l"))
    assert {r.p: r.l for r in rows} == cases


def test_parent_and_leaf(one_row):
    rows = one_row([("",), ("a",), ("a/b",), ("a/b/c.txt",)], "p string",
                   "p", P.parent_path("p").alias("parent"), P.leaf_name("p").alias("leaf"))
    got = {r.p: (r.parent, r.leaf) for r in rows}
    assert got == {"": ("", "/"), "a": ("", "a"), "a/b": ("a", "b"), "a/b/c.txt": ("a/b", "c.txt")}


def test_prune_and_ancestors(one_row):
    rows = one_row([("src/.GIT/x",), ("a/node_modules/b/c",), ("src/lib/f.go",), (".gitignore",)], "p string",
                   "p", P.is_pruned_file("p").alias("pr"), P.ancestors("p").alias("anc"))
    got = {r.p: (r.pr, r.anc) for r in rows}
    assert got["src/.GIT/x"][0] and got["a/node_modules/b/c"][0]
    assert not got["src/lib/f.go"][0] and got["src/lib/f.go"][1] == ["src", "src/lib"]
    assert not got[".gitignore"][0] and got[".gitignore"][1] == []


def test_hex_id_rules(one_row):
    import hashlib
    rows = one_row([(" WS ", "Src/A.go ")], "w string, p string",
                   H.file_id("w", "p").alias("folded"), H.file_id("w", "p", case_fold=False).alias("kept"),
                   H.chunk_label(F.lit(42)).alias("lab"), H.chunk_label(F.lit(1234567)).alias("big"))
    r = rows[0]
    assert r.folded == "file-" + hashlib.sha256(b"ws|src/a.go").hexdigest()[:20]
    assert r.kept == "file-" + hashlib.sha256(b"WS|Src/A.go").hexdigest()[:20]
    assert r.lab == "chunk#000042" and r.big == "chunk#1234567"


def test_run_id_deterministic_and_step_sensitive(one_row):
    # ported: same inputs -> same id; a different step -> a different id
    ts = dt.datetime(2025, 7, 10, 12, 30, 0)
    rows = one_row([("workspace-alpha", "index.scan", ts), ("workspace-alpha", "index.scan", ts),
                    ("workspace-alpha", "index.embed", ts)], "w string, s string, t timestamp",
                   H.run_id("w", "s", "t").alias("id"), H.rfc3339_nano("t").alias("r"))
    assert rows[0].id == rows[1].id != rows[2].id
    assert rows[0].id.startswith("RUN-20250710-") and len(rows[0].id) == len("RUN-20250710-") + 8
    assert rows[0].r == "2025-07-10T12:30:00Z"


def test_rfc3339_fraction(one_row):
    rows = one_row([(dt.datetime(2024, 1, 1, 0, 0, 7, 179500),)], "t timestamp", H.rfc3339_nano("t").alias("r"))
    assert rows[0].r == "2024-01-01T00:00:07.1795Z"


def test_strip_ansi_golden(one_row):
    # ported golden case
    raw = "\x1b[31mERROR\x1b[0m\r\n\x1b]0;title\x07"
    rows = one_row([(raw,), ("\u009b2Kx\x1bOAy",)], "s string", X.strip_ansi("s").alias("c"))
    assert rows[0].c == "ERROR\r\n"
    assert rows[1].c == "xy"


def test_go_trim_unicode(one_row):
    rows = one_row([(" 　 a b\t\n ",), ("x​",)], "s string", X.go_trim("s").alias("t"))
    assert rows[0].t == "a b"
    assert rows[1].t == "x​"  # zero-width space is not white space


def test_model_slug_and_split(one_row):
    rows = one_row([("Nomic Embed/Text:v1.5@Q_8",), ("plain",), ("--a--b--",)], "m string",
                   X.model_slug("m").alias("s"), X.split_model("m").alias("fv"))
    assert rows[0].s == "nomic-embed-text-v1-5-q-8"
    assert (rows[0].fv.family, rows[0].fv.version) == ("nomic-embed-text-v1-5-q-8", "base")
    assert (rows[1].fv.family, rows[1].fv.version) == ("plain", "base")
    assert rows[2].s == "a-b"
    assert (rows[2].fv.family, rows[2].fv.version) == ("", "-a--b--")


def test_read_slice_rules(one_row):
    text = "héllo wörld"
    cases = [(0, 5), (-3, 2), (4, 2), (8, 100), (11, 11), (0, 0)]
    rows = one_row([(text, a, b) for a, b in cases], "t string, a int, b int", X.read_slice("t", "a", "b").alias("r"))
    got = [(r.r.chunk, r.r.truncated) for r in rows]
    assert got == [("héllo", False), ("hé", False), ("", False), ("rld<|EOF|>", False), ("<|EOF|>", False), ("", False)]


def test_read_slice_cap(one_row):
    text = "a" * 70000
    rows = one_row([(text,)], "t string", X.read_slice("t", F.lit(10), F.lit(69000), 61440).alias("r"),
                   X.read_slice("t", F.lit(10), F.lit(69000)).alias("whole"))
    assert rows[0].r.truncated and rows[0].r.chunk == "a" * 61440 + ". . .truncated"
    assert rows[0].whole.chunk == "a" * 68990 and not rows[0].whole.truncated


def test_read_slice_hex_odd_offsets(one_row):
    data = bytes([0xAB, 0xCD, 0xEF])
    cases = [(0, 6), (1, 4), (3, 100), (5, 6), (1, 2)]
    rows = one_row([(data, a, b) for a, b in cases], "d binary, a int, b int", X.read_slice_hex("d", "a", "b").alias("r"))
    assert [r.r.chunk for r in rows] == ["abcdef<|EOF|>", "bcd", "def<|EOF|>", "f<|EOF|>", "b"]


def test_snippet_rules(one_row):
    body = ("é" * 300).encode()  # 600 bytes, a cut at 512 falls on a character boundary
    odd = ("a" + "é" * 300).encode()  # the cut at 512 splits a character
    rows = one_row([(b"  line one\nline two \n", 0, 100), (b"abc", 5, 9), (b"abc", 2, 1), (body, 0, 600),
                    (odd, 0, 601)], "d binary, s int, e int", X.snippet("d", "s", "e", 512).alias("x"))
    assert rows[0].x == "line one line two"
    assert rows[1].x == "" and rows[2].x == ""
    assert rows[3].x == "é" * 256 + "…"
    assert rows[4].x == "a" + "é" * 255 + "�…"


def test_is_binary_and_invalid_utf8(one_row):
    rows = one_row([(b"ab\x00cd",), (b"x" * 2000 + b"\x00",), (b"\xff\xfeok",)], "d binary",
                   X.is_binary("d").alias("b"), X.as_text("d").alias("t"))
    assert [r.b for r in rows] == [True, True, False]
    assert rows[2].t.endswith("ok") and "�" in rows[2].t


def test_clean_labels_and_filters(one_row):
    rows = one_row([([" a ", "", "b", "a", "  "],), ([" ", ""],)], "l array<string>",
                   X.clean_labels("l").alias("c"), X.normalize_filters("l").alias("n"))
    assert rows[0].c == ["a", "b", "a"] and rows[0].n == ["a", "b"]
    assert rows[1].c is None and rows[1].n == []
    assert X.normalize_filter_list([" x ", "", "x", "y"]) == ["x", "y"]


def test_relative_to(one_row):
    rows = one_row([("/srv/ws", "/srv/ws"), ("/srv/ws/", "/srv/ws/a/b.go"), ("/srv/ws", "/srv/wsx/a"), ("/a.b", "/a.b/c")],
                   "r string, p string", P.relative_to("r", "p").alias("rel"))
    assert [r.rel for r in rows] == ["", "a/b.go", None, "c"]
