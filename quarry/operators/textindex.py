"""Text search over a posting table of character n-grams.

``build`` takes the distinct grams (one to three characters) of each file's folded text and writes, for each stretch of
texts that a task reads, one row per gram with the files that hold it, sorted by gram in small row groups, so that a lookup
reads only those that hold it; beside it, how many files hold each gram. ``search`` takes the rarest trigrams of each distinct
needle (the needle itself, if it has fewer than three characters), meets their postings, and looks for all needles of a file
in one pass over its lines, if the file holds all of their grams. Candidates are a superset (texts and needles are folded
alike, the two small sigmas are one); lines are verified exactly, so results equal ``textsearch.search_text``.

NULL and empty contents have no grams; a key (``ws``, ``relpath``) that repeats is searched row by row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import as_text, go_trim
from quarry.operators.listing import first_n
from quarry.session import ship_package
from quarry.sources.staging import written

#: Trigrams of a needle that are looked up: its rarest ones.
LOOKED_UP = 3
#: Characters of the texts whose postings are put together, and bytes of a row group of the postings.
STRETCH, ROW_GROUP = 1 << 21, 8 << 20
#: Parts that the rows of one gram are dealt over.
PARTS = 8


@dataclass
class TextIndex:
    """``postings`` (trigram, n, files) sorted by trigram, a gram has one row or more; ``counts`` (trigram, files: how many).
    A file is the hash of ws and relpath."""
    postings: DataFrame
    counts: DataFrame


def _file() -> Column:
    return F.xxhash64("ws", "relpath")


def _grams(text: str | None, needle: bool = False) -> np.ndarray:
    c = np.frombuffer((text or "").replace("ς", "σ").encode("utf-32-le"), np.uint32).astype(np.int64)
    kinds = [c << 42, c[:-1] << 42 | c[1:] << 21, c[:-2] << 42 | c[1:-1] << 21 | c[2:]] if len(c) > 1 else [c << 42]
    kinds = [k for k in kinds if len(k)]
    return np.unique(np.concatenate(kinds[-1:] if needle else kinds)) if kinds else c


def grams(folded: Column, needle: bool = False) -> Column:
    """Distinct grams of a folded text as numbers (21 bits a character), ascending; NULL has none.

    A text has its grams of one to three characters, a needle only its longest ones of these.
    """
    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        out = [_grams(t, needle) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, out)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *out])))

    return run(folded)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, n, files) of (file, folded text): one row per gram of about ``STRETCH`` characters of texts."""
    def flush() -> pa.RecordBatch:
        gram = np.concatenate(found)
        file = np.repeat(np.array(files, np.int64), list(map(len, found)))
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        begin = np.flatnonzero(np.diff(gram, prepend=gram[0] - 1))
        ends = np.append(begin, len(gram)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(gram[begin]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(file[order]))],
                                          ["trigram", "n", "files"])

    found, files, held = [], [], 0
    for b in batches:
        for file, text in zip(b.column(0).to_pylist(), b.column(1)):
            t = text.as_py()
            if t:
                found.append(_grams(t))
                files.append(file)
                held += len(t)
            if held > STRETCH:
                yield flush()
                found, files, held = [], [], 0
    if found:
        yield flush()


def _text(content: DataFrame, text_col: str) -> Column:
    return as_text(text_col) if dict(content.dtypes)[text_col] == "binary" else F.col(text_col)


def build(content: DataFrame, path: str, text_col: str = "content") -> TextIndex:
    """Write the index of ``content(ws, relpath, content)`` below ``path``."""
    spark = content.sparkSession
    ship_package(spark)
    held = content.select(_file().alias("file"), F.lower(_text(content, text_col)).alias("folded"))
    rows = held.mapInArrow(_postings, "trigram bigint, n int, files array<bigint>")
    rows = rows.repartition("trigram", F.pmod(F.get("files", F.lit(0)), F.lit(PARTS))).sortWithinPartitions("trigram")
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("trigram").agg(F.sum("n").alias("files"))
    counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").parquet(f"{path}/counts")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"))


def candidates(index: TextIndex, needles: DataFrame) -> DataFrame:
    """(needle_id, file) of the files that may hold each needle."""
    each = needles.select("needle_id", F.explode(grams(F.lower("needle"), needle=True)).alias("trigram"))
    # a gram of no file comes first: its needle is in none
    rare = Window.partitionBy("needle_id").orderBy(F.coalesce("files", F.lit(0)), "trigram")
    each = each.join(index.counts, "trigram", "left").withColumn("_n", F.row_number().over(rare)).where(F.col("_n") <= LOOKED_UP)
    bit = lambda n: F.call_function("shiftleft", F.lit(1), n.cast("int"))
    of = F.count(F.lit(1)).over(Window.partitionBy("needle_id"))
    # written, so that its size is known: the postings are not shuffled to meet a few grams
    want = written(each.select("needle_id", "trigram", bit(F.col("_n") - 1).alias("_bit"), (bit(of) - 1).alias("_all")), "wanted-grams")
    hits = index.postings.join(want, "trigram").select("needle_id", F.explode("files").alias("file"), "_bit", "_all")
    # dealt by file once, for this grouping and the caller's by file
    hits = hits.repartition("file").groupBy("needle_id", "file").agg(F.bit_or("_bit").alias("_have"), F.first("_all").alias("_all"))
    return hits.where("_have = _all").select("needle_id", "file")


def _line_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ws, relpath, needle, line_number, line) of (ws, relpath, text, folded text, asked): each needle's lines, once."""
    for b in batches:
        owner, out = [], []
        for row, (text, folded, asked) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))):
            ends = [m.start() for m in re.finditer("\n", folded)] + [len(folded)]
            lines = None
            for a in asked:
                probe = a["probe"]
                at = folded.find(probe)
                while at >= 0:
                    k = bisect_left(ends, at)
                    begin, end = ends[k - 1] + 1 if k else 0, ends[k]
                    # the carriage return that ends a line is no part of it
                    if at + len(probe) <= (end - 1 if end > begin and folded[end - 1] == "\r" else end):
                        lines = text.split("\n") if lines is None else lines
                        owner.append(row)
                        out.append((a["needle"], k + 1, lines[k].removesuffix("\r")))
                        at = folded.find(probe, end + 1)
                    else:
                        at = folded.find(probe, at + 1)
        needle, number, line = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(owner, pa.int64())), b.column(1).take(pa.array(owner, pa.int64())), pa.array(needle, pa.string()),
             pa.array(number, pa.int64()), pa.array(line, pa.string())], ["ws", "relpath", "needle", "line_number", "line"])


def search(index: TextIndex, content: DataFrame, needles: DataFrame, case_sensitive: bool = False, limit: int | None = None,
           group_cols: Sequence[str] = ("needle_id", "ws"), text_col: str = "content") -> DataFrame:
    """(needle_id, ws, relpath, line_number, snippet) for ``needles(needle_id, needle)``, as ``search_text`` for each of them."""
    fold = (lambda c: c) if case_sensitive else F.lower
    ship_package(content.sparkSession)
    needles = needles.where(go_trim("needle") != "")
    text = content.select("ws", "relpath", _file().alias("file"), _text(content, text_col).alias("_t"))
    # each distinct needle is looked for once, and each text is read once for all of its needles
    found = candidates(index, needles.select(F.col("needle").alias("needle_id"), "needle").distinct())
    asked = found.groupBy("file").agg(F.collect_list(F.struct(F.col("needle_id").alias("needle"), fold(F.col("needle_id")).alias("probe"))).alias("_asked"))
    files = text.where("_t IS NOT NULL").join(asked, "file").select("ws", "relpath", "_t", fold(F.col("_t")).alias("_f"), "_asked")
    kinds = dict(content.dtypes)
    hits = files.mapInArrow(_line_hits, f"ws {kinds['ws']}, relpath {kinds['relpath']}, needle string, line_number bigint, line string")
    hits = hits.join(needles.select("needle_id", "needle"), "needle").select("needle_id", "ws", "relpath", "line_number", go_trim("line").alias("snippet"))
    return first_n(hits, limit, [F.col("relpath"), F.col("line_number")], list(group_cols))
