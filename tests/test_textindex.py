"""Indexed search equals the plain search for many needles."""

import random

import pytest

from quarry.operators import textindex as X
from quarry.operators.textsearch import search_text

NEEDLES = ["needle", "NEEDLE", "Needle two", "ab", "a", "é", "漢字", "İ", "ΟΔΟΣ", "οδος", "σ", "ß", "SS", "%", "_x", "zzzz", "one\ttwo", "\r", "end\r", "o w", " x "]


@pytest.fixture(scope="module")
def content(spark):
    rng = random.Random(2)
    parts = ["needle", "Needle two", "NEEDLE", "abc", "é", "漢字漢", "İstanbul", "ΟΔΟΣ", "ΟΔΟΣΑ", "οδός", "straße", "%_x", "one\ttwo", "end\r", "so what x y"]
    rows = [(f"w{i % 3}", f"f{i}", "\n".join(" ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [("w0", "null", None), ("w0", "empty", ""), ("w0", "two", "ab"), ("w1", "twice", "needle"), ("w1", "twice", "a needle"), ("w1", "tail", "x\nneedle\n")]
    return spark.createDataFrame(rows, "ws string, relpath string, content string")


@pytest.mark.parametrize("exact", [False, True])
def test_same_lines_as_the_plain_search(spark, content, tmp_path, exact):
    index = X.build(content, str(tmp_path / "index"))
    needles = spark.createDataFrame(list(enumerate(NEEDLES)) + [(98, " "), (99, "")], "needle_id int, needle string")
    got = {}
    for r in X.search(index, content, needles, exact).collect():
        got.setdefault(r.needle_id, []).append((r.ws, r.relpath, r.line_number, r.snippet))
    for i, needle in enumerate(NEEDLES):
        if not needle.strip():
            assert i not in got
            continue
        want = [(r.ws, r.relpath, r.line_number, r.snippet) for r in search_text(content.where("content IS NOT NULL"), needle, exact).collect()]
        assert sorted(got.get(i, [])) == sorted(want), needle


def test_limit_and_binary_content(spark, content, tmp_path):
    from pyspark.sql import functions as F

    raw = content.withColumn("content", F.encode("content", "UTF-8"))
    index = X.build(raw, str(tmp_path / "index"))
    needles = spark.createDataFrame([(1, "needle"), (2, "a")], "needle_id int, needle string")
    got = X.search(index, raw, needles, limit=2).collect()
    want = {(n, r.ws, r.relpath, r.line_number) for n, t in ((1, "needle"), (2, "a")) for r in search_text(content.where("content IS NOT NULL"), t, limit=2).collect()}
    assert {(r.needle_id, r.ws, r.relpath, r.line_number) for r in got} == want


def test_few_files_are_candidates(spark, content, tmp_path):
    index = X.build(content, str(tmp_path / "index"))
    found = X.candidates(index, spark.createDataFrame([(1, "one\ttwo"), (2, "zzzzz"), (3, "ab")], "needle_id int, needle string"))
    per = {r.needle_id: r["count"] for r in found.groupBy("needle_id").count().collect()}
    assert 0 < per[1] < 60 and 2 not in per and 0 < per[3] < 60
    plan = index.postings.where("trigram = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trigram,5)" in plan


def test_rows_are_few_and_texts_are_read_once(spark, content, tmp_path):
    """A gram is one row per stretch of texts, stored without being reduced twice; needles do not multiply texts."""
    index = X.build(content.coalesce(1), str(tmp_path / "index"))
    per = index.postings.groupBy("trigram").count()
    assert per.where("count > 1").count() == 0 and index.postings.where("n <> size(files)").count() == 0
    needles = spark.createDataFrame([(i, "needle") for i in range(40)] + [(40, "one\ttwo")], "needle_id int, needle string")
    found = X.search(index, content, needles)
    assert "posexplode" not in found._jdf.queryExecution().executedPlan().toString()
    want = search_text(content.where("content IS NOT NULL"), "needle").count()
    assert {r.needle_id: r["count"] for r in found.groupBy("needle_id").count().collect() if r.needle_id < 40} == dict.fromkeys(range(40), want)
