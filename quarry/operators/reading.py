"""Slice reads and result snippets, applicable to a whole column of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.constants import EOF_MARKER, TRUNCATED_MARKER
from quarry.functions.text import as_text, go_trim, read_slice, read_slice_hex, snippet
from quarry.operators.segments import byte_ranges, char_bases


def read_slices(content: DataFrame, requests: DataFrame, hex_mode: bool = False,
                content_col: str = "content", max_chars: int | None = None) -> DataFrame:
    """Answer ``requests (ws, relpath, start, end, …)`` from the content table.

    Relative paths only; a request whose file is not catalogued gets
    ``found = false`` and no chunk (the single-file API raises instead).
    """
    req = requests.withColumn("relpath", go_trim(F.col("relpath")))
    joined = req.join(content.select("ws", "relpath", F.col(content_col).alias("_data")), ["ws", "relpath"], "left")
    data = F.col("_data")
    if hex_mode:
        if dict(content.dtypes).get(content_col) != "binary":
            data = F.encode(data, "UTF-8")
        sl = read_slice_hex(data, "start", "end", max_chars)
    else:
        if dict(content.dtypes).get(content_col) == "binary":
            data = as_text(data)
        sl = read_slice(data, "start", "end", max_chars)
    return joined.withColumn("_s", sl).select(
        *[c for c in req.columns],
        F.col("_data").isNotNull().alias("found"),
        F.col("_s.chunk").alias("chunk"),
        F.lit(hex_mode).alias("hex"),
        F.col("_s.truncated").alias("truncated"),
    )


def read_file(segments: DataFrame, ws: str, relpath: str, start: int, end: int, hex_mode: bool = False, max_chars: int | None = None) -> DataFrame:
    """Single-file slice read from ``segments`` (``operators.segments``); the path must be relative and catalogued.

    Only the segments that overlap the slice are cut, and only their cuts are put together; offsets and clamps are
    those of :func:`read_slices`.
    """
    rel = relpath.strip()
    if not rel:
        raise ValueError("relPath is required")
    if rel.startswith("/"):
        raise ValueError("only paths relative to the workspace can be read")
    # filter first: partition pruning on ws, pushed relpath filter
    one = segments.filter((F.col("ws") == ws.strip()) & (F.col("relpath") == rel))
    if one.limit(1).count() == 0:
        raise FileNotFoundError(f"file {rel} not found in workspace {ws}")
    lo = max(int(start), 0)
    hi = max(int(end), lo)
    truncated = max_chars is not None and hi - lo > max_chars
    if hex_mode:
        base, n = F.col("at") * 2, F.octet_length("content").cast("long") * 2
        parts = one.select("segment", base.alias("_base"), n.alias("_n"), F.col("content").alias("_data"))
        # whole bytes that hold the digits; an odd start drops the first digit afterwards
        first = F.greatest(F.floor((F.lit(lo) - F.col("_base")) / 2), F.lit(0))
        last = F.least(F.ceil((F.lit(hi) - F.col("_base")) / 2), F.octet_length("_data"))
        cut = F.lower(F.hex(F.substring("_data", (first + 1).cast("int"), (last - first).cast("int"))))
    else:
        parts = char_bases(one).select("segment", F.col("char_base").alias("_base"), F.col("chars").alias("_n"))
        parts = parts.join(one.select("segment", as_text("content").alias("_data")), "segment")
        first = F.greatest(F.lit(lo) - F.col("_base"), F.lit(0))
        last = F.least(F.lit(hi) - F.col("_base"), F.col("_n"))
        cut = F.substring("_data", (first + 1).cast("int"), (last - first).cast("int"))
    hit = (F.col("_base") < hi) & (F.col("_base") + F.col("_n") > lo)
    got = parts.agg(F.sum("_n").alias("total"), F.array_sort(F.collect_list(F.when(hit, F.struct("segment", cut.alias("cut"))))).alias("cuts"))
    body = F.array_join(F.transform("cuts", lambda c: c.cut), "")
    if hex_mode:
        body = F.substring(body, lo % 2 + 1, hi - lo)
    s, e = F.least(F.lit(lo), F.col("total")), F.least(F.lit(hi), F.col("total"))
    over = F.lit(truncated) & ((e - s) > (max_chars or 0))
    shown = F.when(over, F.left(body, F.lit(max_chars or 0))).otherwise(body)
    reached = F.when(over, s + (max_chars or 0)).otherwise(e)
    chunk = F.concat(shown, F.when(reached >= F.col("total"), EOF_MARKER).otherwise(""), F.when(over, TRUNCATED_MARKER).otherwise(""))
    return got.select(F.lit(rel).alias("rel_path"), chunk.alias("chunk"), F.lit(hex_mode).alias("hex"), over.alias("truncated"))


def with_snippets(results: DataFrame, segments: DataFrame, id_col: str = "id") -> DataFrame:
    """Attach ``snippet`` to ranked chunk results; their bytes are cut from the segments *after* top-k (few rows)."""
    cut = byte_ranges(segments, results, [id_col])
    data = F.col("content")
    return cut.withColumn("snippet", F.coalesce(snippet(data, F.lit(0), F.octet_length(data)), F.lit(""))).drop("content")
