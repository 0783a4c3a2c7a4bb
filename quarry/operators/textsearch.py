"""Line-level literal text search over file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import as_text, go_trim
from quarry.operators.listing import first_n


def _without_cr(line):
    """A line without the carriage return that ends it."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def _lines_matching(content: DataFrame, needle: str, case_sensitive: bool, text_col: str) -> DataFrame:
    """Matching lines ``(ws, relpath, line_number, snippet)``.

    Files without the needle are skipped before being split. Case-insensitive
    search lower-cases each file once and splits the original and the folded
    text side by side (folding never adds or removes a line break).
    """
    if not needle or not needle.strip():
        raise ValueError("query is required")
    text = F.col(text_col)
    if dict(content.dtypes).get(text_col) == "binary":
        text = as_text(text)
    files = content.select("ws", "relpath", text.alias("_t"))
    if case_sensitive:
        files = files.filter(F.contains("_t", F.lit(needle))).withColumn("_f", F.col("_t"))
        probe = F.lit(needle)
    else:
        probe = F.lower(F.lit(needle))
        files = files.withColumn("_f", F.lower("_t")).filter(F.contains("_f", probe))
    st = files.withColumn("_z", F.arrays_zip(F.split("_t", "\n", -1).alias("o"), F.split("_f", "\n", -1).alias("f")))
    z = F.col("_z")
    st = st.withColumn("_z", F.when(F.element_at(z, -1)["o"] == "", F.slice(z, 1, F.size(z) - 1)).otherwise(z))
    ex = st.select("ws", "relpath", F.posexplode("_z").alias("_pos", "_l")).filter(
        F.contains(_without_cr(F.col("_l.f")), probe))
    line = _without_cr(F.col("_l.o"))
    return ex.select("ws", "relpath", (F.col("_pos") + 1).cast("bigint").alias("line_number"),
                     go_trim(line).alias("snippet"))


def search_text(content: DataFrame, needle: str, case_sensitive: bool = False, limit: int | None = None,
                max_file_bytes: int | None = None, ws: str | None = None,
                text_col: str = "content") -> DataFrame:
    """Matching lines in (path, line) order, at most ``limit`` per workspace (or in ``ws``) when given.

    One row per matching line; when given, files larger than ``max_file_bytes``
    are skipped before any line is split.
    """
    c = content if max_file_bytes is None else content.filter(F.col("size") <= max_file_bytes)
    if ws is not None:
        c = c.filter(F.col("ws") == ws.strip())
    hits = _lines_matching(c, needle, case_sensitive, text_col)
    order = [F.col("relpath"), F.col("line_number")]
    return first_n(hits, limit, order, None if ws is not None else ["ws"])


def search_file_text(content: DataFrame, needle: str, relpath: str | None = None, ws: str | None = None,
                     case_sensitive: bool = False, limit: int | None = None,
                     text_col: str = "content") -> DataFrame:
    """Matching lines of one file (``ws``, ``relpath``), or of every file when both are None.

    A named file that is not catalogued is an error.
    """
    c = content
    if relpath is not None:
        c = c.filter((F.col("ws") == ws.strip()) & (F.col("relpath") == relpath.strip()))
        if c.limit(1).count() == 0:
            raise FileNotFoundError(f"file {relpath} not found in workspace {ws}")
    hits = _lines_matching(c, needle, case_sensitive, text_col)
    return first_n(hits, limit, [F.col("line_number")], None if relpath is not None else ["ws", "relpath"])
