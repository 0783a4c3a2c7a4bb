"""Chunks, lines, searches and ranges of segments of any size equal those of whole contents."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import segments as S
from quarry.operators.chunking import text_lines, with_chunks
from quarry.operators.textsearch import search_text


def texts():
    rng = random.Random(11)
    parts = ["word", "é漢", " ", "\n", "\t", "\r\n", "  ", "x" * 90, "needle", "NEEDLE", "\n\n"]
    out = ["", " ", "\n", "a", "\r", "a\r\n", "  lead", "trail \n", "one line without an end", "needle" * 40, "\n" * 50, "w " * 300]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 300))) for _ in range(25)]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"w{i % 3}", f"f{i:02}", t, len(t.encode())) for i, t in enumerate(texts())] + [("w0", "none", None, 0)]
    return spark.createDataFrame(rows, "ws string, relpath string, content string, size long")


@pytest.mark.parametrize("size", [1, 7, 60, 4 << 20])
def test_segments_of_any_size_give_the_same_rows(spark, files, size):
    seg = S.to_segments(files, segment_bytes=size).cache()
    assert seg.groupBy("ws", "relpath").agg(F.sum(F.octet_length("content")).alias("n"), F.max("size").alias("m")).where("n <> m").count() == 0
    for most in (3, 64):
        want = with_chunks(files.where("content IS NOT NULL"), "content", most)
        got = S.chunks(seg, max_tokens=most)
        cols = ["ws", "relpath", "chunk_index", "chunk_text", "start", "end", "token_count", "chunk_size", "content_sha"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    cols = ["ws", "relpath", "line_number", "line"]
    want = sorted(map(tuple, text_lines(files.where("content IS NOT NULL"), "content").select(cols).collect()))
    assert sorted(map(tuple, S.lines(seg).select(cols).collect())) == want
    for needle, exact in (("needle", False), ("NEEDLE", True), ("w w", False)):
        key = lambda r: (r.ws, r.relpath, r.line_number, r.snippet)
        assert sorted(map(key, S.search_lines(seg, needle, exact).collect())) == sorted(map(key, search_text(files.where("content IS NOT NULL"), needle, exact).collect()))
    assert [r.relpath for r in S.search_lines(seg, "needle", limit=2, ws="w0").collect()] == [r.relpath for r in search_text(files, "needle", limit=2, ws="w0").collect()]
    seg.unpersist()


@pytest.mark.parametrize("size", [1, 10, 100])
def test_byte_ranges(spark, files, size):
    seg = S.to_segments(files, segment_bytes=size)
    rng = random.Random(size)
    ask, data = [], {(r.ws, r.relpath): r.content.encode() for r in files.where("content IS NOT NULL").collect()}
    for i, key in enumerate(sorted(data)):
        a = rng.randint(0, len(data[key]) + 3)
        ask.append((i, *key, a, a + rng.randint(-2, 60)))
    ask.append((99, "w9", "unknown", 0, 5))
    req = spark.createDataFrame(ask, "id int, ws string, relpath string, start long, end long")
    got = {r.id: r.content for r in S.byte_ranges(seg, req, ["id"]).collect()}
    assert got.pop(99) is None
    assert {k: bytes(v) for k, v in got.items()} == {i: data[w, f][max(a, 0):max(b, a)] for i, w, f, a, b in ask[:-1]}


def test_character_sums(spark, files):
    seg = S.to_segments(files, segment_bytes=9)
    got = S.char_bases(seg).orderBy("ws", "relpath", "segment").collect()
    whole = {(r.ws, r.relpath): r.content for r in files.collect()}
    seen = {}
    for r in got:
        assert r.char_base == seen.get((r.ws, r.relpath), 0)
        seen[r.ws, r.relpath] = r.char_base + r.chars
    assert seen == {k: len(t) for k, t in whole.items() if t is not None}


def test_only_open_parts_are_shuffled(spark, files):
    plan = S.chunks(S.to_segments(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" in plan


@pytest.mark.parametrize("size", [1, 3, 10, 64, 5000])
def test_segments_begin_with_tokens(size):
    rng = random.Random(size)
    for _ in range(60):
        data = "".join(rng.choice(["word", "é", " ", "\n", "\t", "\r\n", "  ", "x" * 30]) for _ in range(rng.randint(0, 200))).encode()
        parts = list(S.cut_stream([data[k:k + 7] for k in range(0, len(data), 7)], size))
        assert b"".join(parts) == data
        for left, part in zip(parts, parts[1:]):
            assert left[-1:] in (b" ", b"\n", b"\t", b"\r") and part[:1] not in (b" ", b"\n", b"\t", b"\r")


def test_chunks_of_stored_segments(spark, tmp_path):
    """Texts are cut by place and segments stay where they are, whatever their bytes are."""
    body = [b"a \xff\xfe b \xe6\xbc c\n" * 9, "漢 é \U0001f600\t".encode() * 40, b"x\0y " * 20, b"", b" \n lead", b"w " * 64]
    rows = [("w", f"f{i}", b, len(b)) for i, b in enumerate(body)]
    files = spark.createDataFrame(rows, "ws string, relpath string, content binary, size long")
    S.to_segments(files, segment_bytes=30).write.parquet(str(tmp_path / "segments"))
    got = S.text_chunks(spark.read.parquet(str(tmp_path / "segments")), max_tokens=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "SortMergeJoin" not in plan
    cols = ["relpath", "chunk_index", "chunk_text", "start", "end", "token_count", "chunk_size", "content_sha"]
    want = with_chunks(files.where("relpath <> 'f2'"), "content", 8)
    # replaced bytes have other lengths, and a segment's place counts the file's own bytes
    for part, names in (("relpath <> 'f0'", cols), ("relpath = 'f0'", [c for c in cols if c not in ("start", "end")])):
        assert sorted(map(tuple, got.where(part).select(names).collect())) == sorted(map(tuple, want.where(part).select(names).collect()))


def test_cuts_are_the_last_places():
    rng = random.Random(5)
    for _ in range(300):
        data = "".join(rng.choice(["word", " ", "\n", "\t", "  ", "\n\n", "x" * 90]) for _ in range(rng.randint(0, 60))).encode()
        begin, size = rng.randint(0, len(data)), rng.randint(1, 300)
        part = data[begin:begin + size]
        ends = [i + 1 for i in range(len(part) - 1) if part[i] in b" \n\t" and part[i + 1] not in b" \n\t"]
        lines = [i for i in ends if part[i - 1] == 10]
        assert S.cut_segment(data, size, begin) == max(lines or ends or [0])


def test_files_of_one_segment_are_not_cut_twice(spark, files, monkeypatch):
    pieces = S._pieces

    def checked(width, max_tokens, cut, batches):
        def seen():
            for b in batches:
                base, last = b.column(width + 2).to_pylist(), b.column(width + 3).to_pylist()
                if cut and any(x == 0 and y for x, y in zip(base, last)):
                    raise ValueError("a whole file among the segments that share chunks")
                yield b

        yield from pieces(width, max_tokens, cut, seen())

    monkeypatch.setattr(S, "_pieces", checked)
    want = with_chunks(files.where("content IS NOT NULL"), "content", 3)
    cols = ["ws", "relpath", "chunk_index", "chunk_text", "start", "end", "token_count", "content_sha"]
    got = S.chunks(S.to_segments(files, segment_bytes=60), max_tokens=3)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
