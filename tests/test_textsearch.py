"""Text search: literal matching, line numbers, limits per workspace, size cap."""

import pytest

from quarry.operators.textsearch import search_file_text, search_text


def test_search_text_rules(spark):
    content = spark.createDataFrame([
        ("w1", "b.txt", "zero\r\n  Needle one \r\nnothing\nneedle two\n", 40),
        ("w1", "a.txt", "no match here\n", 14),
        ("w1", "c.txt", "NEEDLE% literal _x\n", 20),
        ("w2", "a.txt", "a needle\n", 9),
        ("w2", "big.txt", "needle in a big file\n", 5_000_000),
    ], "ws string, relpath string, content string, size long")
    hits = [(r.ws, r.relpath, r.line_number, r.snippet) for r in search_text(content, "needle").orderBy("ws", "relpath", "line_number").collect()]
    assert ("w2", "big.txt", 1, "needle in a big file") in hits  # no cap unless one is asked for
    hits = [(r.ws, r.relpath, r.line_number, r.snippet) for r in search_text(content, "needle", max_file_bytes=1 << 20).orderBy("ws", "relpath", "line_number").collect()]
    assert hits == [("w1", "b.txt", 2, "Needle one"), ("w1", "b.txt", 4, "needle two"), ("w1", "c.txt", 1, "NEEDLE% literal _x"),
                    ("w2", "a.txt", 1, "a needle")]  # big.txt is over the cap
    cs = search_text(content, "needle", case_sensitive=True, ws="w1").collect()
    assert [(r.relpath, r.line_number) for r in cs] == [("b.txt", 4)]
    assert [r.relpath for r in search_text(content, "E%", ws="w1").collect()] == ["c.txt"]  # % is literal
    one = search_text(content, "needle", limit=1).collect()
    assert sorted((r.ws, r.relpath, r.line_number) for r in one) == [("w1", "b.txt", 2), ("w2", "a.txt", 1)]
    with pytest.raises(ValueError):
        search_text(content, "  ")
    f = search_file_text(content, "needle", "big.txt", "w2").collect()  # no size cap for one file
    assert [r.line_number for r in f] == [1]
    with pytest.raises(FileNotFoundError):
        search_file_text(content, "needle", "missing.txt", "w2")
