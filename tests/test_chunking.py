"""Token chunker and line splitter."""

from pyspark.sql import functions as F

from quarry.operators.chunking import text_lines, with_chunks


def _chunks(spark, texts, max_tokens):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return sorted(with_chunks(df, "text", max_tokens).collect(), key=lambda r: (r.id, r.chunk_index))


def test_chunker_contiguous_and_bounded(spark):
    # ported: "hello world " x 3000, every chunk 1..768 tokens, contiguous, concatenation = input
    text = "hello world " * 3000
    rows = _chunks(spark, [text], 768)
    assert len(rows) == 8
    pos = 0
    for r in rows:
        assert 1 <= r.token_count <= 768
        assert r.start == pos and r.end > r.start
        assert text.encode()[r.start:r.end].decode() == r.chunk_text
        pos = r.end
    assert pos == len(text.encode())
    assert "".join(r.chunk_text for r in rows) == text
    assert sum(r.token_count for r in rows) == 6000


def test_chunker_edges(spark):
    rows = _chunks(spark, ["", "   ", "  lead and trail  ", "é" * 5 + " ü\r\nend"], 2)
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert 0 not in by  # empty text: no chunks
    assert [(r.chunk_text, r.token_count) for r in by[1]] == [("   ", 1)]
    assert [r.chunk_text for r in by[2]] == ["  lead ", "and trail  "]
    assert [r.token_count for r in by[2]] == [2, 2]
    last = by[3]
    assert "".join(r.chunk_text for r in last) == "é" * 5 + " ü\r\nend"
    assert last[0].start == 0 and last[0].end == 15  # "ééééé ü\r\n": 10 + 1 + 2 + 2 bytes
    assert all(r.chunk_size == r.end - r.start for r in last)


def test_chunker_binary_input_repaired(spark):
    df = spark.createDataFrame([(1, b"ab\xffcd ef")], "id long, content binary")
    rows = with_chunks(df, "content", 768).collect()
    assert len(rows) == 1 and rows[0].chunk_text == "ab�cd ef"


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nc\n"), (2, ""), (3, "x\r\r"), (4, "\n")], "id long, text string")
    rows = sorted(text_lines(df, "text").select("id", "line_number", "line").collect())
    assert [(r.id, r.line_number, r.line) for r in rows] == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (3, 1, "x\r"), (4, 1, "")]


def test_chunker_plan_stays_in_jvm(spark):
    df = spark.createDataFrame([(1, "a b c")], "id long, text string")
    plan = with_chunks(df, "text", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate" in plan


def test_long_texts_in_linear_time(spark):
    import time

    from quarry.operators.chunking import with_chunks

    took = []
    for words in (250_000, 1_000_000):
        df = spark.range(1).select(F.concat(F.repeat(F.lit("wörd one "), words // 2), F.lit(" end")).alias("text"))
        for n in (64, 768, 10_000, 100_000):
            began = time.time()
            r = with_chunks(df, "text", n).agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"), F.max("end").alias("e"),
                                               F.sum("chunk_size").alias("b")).first()
            if n == 64:
                took.append(time.time() - began)
            assert (r.n, r.t, r.e) == (-(-(words + 1) // n), words + 1, r.b) and r.b == words // 2 * 10 + 4
    assert took[1] < 12 * max(took[0], 1)
