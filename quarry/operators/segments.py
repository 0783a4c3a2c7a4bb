"""Contents as segments: chunks, lines and ranges of files that are never one value.

A segment is a stretch of a file's bytes that begins where a token begins (the file's first one wherever it begins) and,
if possible, where a line begins. Each carries the file's sums ahead of it: bytes (``at``), tokens (``token_base``) and line
ends (``line_base``), taken in the one pass that reads the file. So a segment knows the numbers of its chunks and lines;
what it has of a chunk or line that other segments hold as well is stitched to their parts by key, everything
else is final. Only those parts are shuffled.

A token longer than a segment stays whole, as a chunk or line that is longer than one stays one value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.constants import MAX_TOKENS_PER_CHUNK
from quarry.functions.text import as_text, go_trim, is_binary
from quarry.operators.listing import first_n
from quarry.session import ship_package
from quarry.sources.staging import written

#: Bytes of a segment, about.
SEGMENT_BYTES = 4 << 20
#: The columns of a segment besides its file's key.
SEGMENT = ("segment int, at bigint, token_base bigint, line_base bigint, mid_line boolean, is_last boolean, size bigint, content binary")

#: A place where a token begins: the white space set is the token chunker's.
_BREAK = re.compile(rb"[ \t\r\n](?=[^ \t\r\n])")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


# ------------------------------------------------------------------ cutting (inside tasks)
def cut_segment(data: bytes, size: int, begin: int = 0) -> int:
    """Where the first segment of ``data[begin:]`` ends: after the last line end, else the last white space, ahead of a
    token's beginning within ``size`` bytes; 0 if no token begins there. Looks from the end, so most of it is not read."""
    end = min(begin + size, len(data))
    at = data.rfind(b"\n", begin, max(end - 1, begin))
    while at >= 0:
        if not _SPACE[data[at + 1]]:
            return at + 1 - begin
        at = data.rfind(b"\n", begin, at)
    lo, reach = end, 64
    while lo > begin:
        hi, lo = min(lo + 1, end), max(lo - reach, begin)
        for m in _BREAK.finditer(data, lo, hi):
            at = m.end()
        if at >= 0:
            return at - begin
        reach *= 4
    return 0


def cut_stream(blocks: Iterable[bytes], size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """Segments of about ``size`` bytes of a stream; a longer token stays in one segment."""
    held, begin, looked = b"", 0, 0  # held[:begin] is done; no token begins in held[begin + 1:begin + looked + 1]
    for block in blocks:
        held, begin = (held[begin:] + block if begin < len(held) else block), 0
        while len(held) - begin - looked > size:
            at = cut_segment(held, size + 1, begin + looked)
            if at:
                yield held[begin:begin + looked + at]
                begin, looked = begin + looked + at, 0
            else:
                looked += size
    if begin < len(held):
        yield held[begin:]


def _tokens(part: bytes) -> int:
    """Tokens that begin in a segment: words, and white space ahead of the first word of a file."""
    space = _SPACE[np.frombuffer(part, np.uint8)]
    return int(np.count_nonzero(space[:-1] & ~space[1:])) + 1


def segment_rows(blocks: Iterable[bytes], size: int = SEGMENT_BYTES) -> Iterator[tuple[int, int, int, int, bool, bool, bytes]]:
    """(segment, at, token_base, line_base, mid_line, is_last, content); an empty stream has one empty segment."""
    held: bytes | None = None
    n = at = tokens = lines = 0
    mid = False
    for part in cut_stream(blocks, size):
        if held is not None:
            yield n, at, tokens, lines, mid, False, held
            n, at, tokens, lines, mid = n + 1, at + len(held), tokens + _tokens(held), lines + held.count(b"\n"), not held.endswith(b"\n")
        held = part
    yield n, at, tokens, lines, mid, True, held or b""


def to_segments(df: DataFrame, keys: Sequence[str] = ("ws", "relpath"), content_col: str = "content", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of whole contents (text or bytes); rows without content have none."""
    ship_package(df.sparkSession)
    data = F.col(content_col)
    rows = df.select(*keys, (data if dict(df.dtypes)[content_col] == "binary" else F.encode(data, "UTF-8")).alias("_content"))
    rows = rows.where("_content IS NOT NULL")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part: list[tuple] = []
            owner: list[int] = []
            held = 0
            for i in range(b.num_rows):
                body = b.column(width)[i].as_py()
                for r in segment_rows([body], segment_bytes):
                    part.append((*r[:6], len(body), r[6]))
                    owner.append(i)
                    held += len(r[6])
                    if held > 4 * SEGMENT_BYTES:
                        yield _rows(b, owner, part)
                        part, owner, held = [], [], 0
            if part:
                yield _rows(b, owner, part)

    def _rows(b: pa.RecordBatch, owner: list[int], part: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        own = [b.column(k).take(pa.array(owner)) for k in range(width)]
        return pa.RecordBatch.from_arrays(own + [pa.array(c, t) for c, t in zip(zip(*part), types)], [*keys, *names])

    schema = ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", " + SEGMENT
    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ chunks
def chunks(segments: DataFrame, keys: Sequence[str] = ("ws", "relpath"), max_tokens: int = MAX_TOKENS_PER_CHUNK) -> DataFrame:
    """Token chunks, as ``operators.chunking.with_chunks`` gives them: keys, chunk_index, chunk_text, start, token_count,
    chunk_size, end, content_sha."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    ship_package(segments.sparkSession)
    rows = segments.select(*keys, "segment", "at", "token_base", "is_last", as_text("content").alias("_text")).where("_text <> ''")
    schema = ", ".join(f"`{k}` {dict(segments.dtypes)[k]}" for k in keys) + ", segment int, chunk_index int, chunk_text string, start bigint, token_count int"
    side = lambda df, cut: df.mapInArrow(partial(_pieces, len(keys), max_tokens, cut), schema)
    # a file that is one segment shares no chunk with others
    closed, open_ = side(rows, False).drop("segment"), side(rows.where("NOT (token_base = 0 AND is_last)"), True)
    parts = F.array_sort(F.collect_list(F.struct("segment", "chunk_text")))
    whole = open_.groupBy(*keys, "chunk_index").agg(F.array_join(F.transform(parts, lambda p: p.chunk_text), "").alias("chunk_text"),
                                                    F.min("start").alias("start"), F.sum("token_count").cast("int").alias("token_count"))
    return (closed.unionByName(whole).withColumn("chunk_size", F.octet_length("chunk_text").cast("bigint"))
            .withColumn("end", F.col("start") + F.col("chunk_size")).withColumn("content_sha", F.sha2("chunk_text", 256)))


def text_chunks(segments: DataFrame, keys: Sequence[str] = ("ws", "relpath"), max_tokens: int = MAX_TOKENS_PER_CHUNK) -> DataFrame:
    """:func:`chunks` of the files that have bytes and no NUL among them.

    ``segments`` is read three times, so it should be stored. The few binary files are written first: their size is known
    when they are joined, and segments are shuffled only if there are many.
    """
    binary = written(segments.where(is_binary("content")).select(*keys).distinct(), "binary-files")
    return chunks(segments.where("size > 0").join(binary, list(keys), "left_anti"), keys, max_tokens)


def _pieces(width: int, max_tokens: int, cut: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What segments (keys, segment, at, token_base, is_last, text) hold of chunks: whole chunks, or (``cut``) those that
    begin in an earlier segment or go on in a later one. A batch's texts stay one buffer; only places are computed."""
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column(width + 4).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + b.num_rows + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        space = _SPACE[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = space[:-1] & ~space[1:]
        begins[ends[:-1]] = True  # no text is empty
        token = np.flatnonzero(begins)
        first = np.searchsorted(token, ends[:-1])  # each segment's first token
        at, base = (b.column(width + i).to_numpy() for i in (1, 2))
        last = b.column(width + 3).to_numpy(zero_copy_only=False)
        size = np.diff(first, append=len(token))
        number = np.arange(len(token)) + np.repeat(base - first, size)  # in its file
        starts = number % max_tokens == 0
        starts[first] = True
        piece = np.flatnonzero(starts)
        owner = np.searchsorted(first, piece, "right") - 1
        tokens = np.diff(piece, append=len(token))
        filled = number[piece] % max_tokens + tokens  # tokens of the chunk up to the piece's end
        final = np.diff(owner, append=len(first)) > 0
        is_cut = (number[piece] % max_tokens > 0) | (final & ~last[owner] & (filled < max_tokens))
        place = np.append(token[piece], len(data))
        texts = pa.LargeStringArray.from_buffers(len(piece), pa.py_buffer(place), pa.py_buffer(data))
        out = [b.column(k).take(pa.array(owner)) for k in range(width + 1)] + [
            pa.array((number[piece] // max_tokens).astype(np.int32)), texts, pa.array(at[owner] + place[:-1] - ends[owner]), pa.array(tokens.astype(np.int32))]
        names = [*b.schema.names[:width + 1], "chunk_index", "chunk_text", "start", "token_count"]
        rows = pa.RecordBatch.from_arrays(out, names).filter(pa.array(is_cut == cut))
        yield rows.set_column(width + 2, "chunk_text", rows.column(width + 2).cast(pa.string()))


# ------------------------------------------------------------------ lines
def _line_parts(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, segment and ``_lines``: (line_number, line, open) of what each segment holds of its lines."""
    rows = segments.select(*keys, "segment", "line_base", "mid_line", "is_last", F.split(as_text("content"), "\n", -1).alias("_parts"))
    parts = F.col("_parts")
    # what follows the last line end is no line, or begins in the next segment
    rows = rows.withColumn("_cut", F.element_at(parts, -1) == "")
    rows = rows.withColumn("_parts", F.when(F.col("_cut"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    last = F.size("_parts") - 1
    lines = F.transform("_parts", lambda x, i: F.struct(
        (F.col("line_base") + i + 1).alias("line_number"), x.alias("line"),
        (((i == 0) & F.col("mid_line")) | ((i == last) & ~F.col("_cut") & ~F.col("is_last"))).alias("open")))
    return rows.select(*keys, "segment", lines.alias("_lines"))


def _stitched(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per line: parts of one line put together."""
    out = parts.select(*keys, "segment", F.explode("_lines").alias("_l")).select(*keys, "segment", "_l.*")
    held = F.array_sort(F.collect_list(F.struct("segment", "line")))
    whole = out.where("open").groupBy(*keys, "line_number").agg(F.array_join(F.transform(held, lambda p: p.line), "").alias("line"))
    lines = out.where("NOT open").select(*keys, "line_number", "line").unionByName(whole)
    return lines.withColumn("line", F.when(F.endswith("line", F.lit("\r")), F.left("line", F.length("line") - 1)).otherwise(F.col("line")))


def lines(segments: DataFrame, keys: Sequence[str] = ("ws", "relpath")) -> DataFrame:
    """Numbered lines, as ``operators.chunking.text_lines`` gives them."""
    return _stitched(_line_parts(segments, keys), keys)


def search_lines(segments: DataFrame, needle: str, case_sensitive: bool = False, limit: int | None = None, max_file_bytes: int | None = None,
                 ws: str | None = None, relpath: str | None = None) -> DataFrame:
    """Lines that hold ``needle``, as ``operators.textsearch.search_text`` gives them; lines of one segment are dropped before the explode."""
    if not needle or not needle.strip():
        raise ValueError("query is required")
    rows = segments if max_file_bytes is None else segments.where(F.col("size") <= max_file_bytes)
    rows = rows if ws is None else rows.where(F.col("ws") == ws.strip())
    rows = rows if relpath is None else rows.where(F.col("relpath") == relpath.strip())
    folded = (lambda x: x) if case_sensitive else F.lower
    probe = folded(F.lit(needle))
    keys = ("ws", "relpath")
    parts = _line_parts(rows, keys)
    parts = parts.withColumn("_lines", F.filter("_lines", lambda x: x.open | F.contains(folded(x.line), probe)))
    hits = _stitched(parts, keys).where(F.contains(folded(F.col("line")), probe))
    hits = hits.select(*keys, "line_number", go_trim("line").alias("snippet"))
    return first_n(hits, limit, [F.col("relpath"), F.col("line_number")], None if ws is not None else ["ws"])


# ------------------------------------------------------------------ ranges
def byte_ranges(segments: DataFrame, requests: DataFrame, id_cols: Sequence[str], keys: Sequence[str] = ("ws", "relpath")) -> DataFrame:
    """``requests(keys, start, end)`` with ``content``: the bytes [start, end), NULL if the file is unknown.

    Each row of ``requests`` is told by ``id_cols``. Only segments that overlap a range are cut, and only the cuts are put together.
    """
    seg = segments.select(*keys, "segment", "at", F.col("content").alias("_bytes"))
    size = F.octet_length("_bytes")
    hit = requests.select(*id_cols, *[k for k in keys if k not in id_cols], F.col("start").alias("_from"), F.col("end").alias("_to")).join(seg, list(keys))
    lo, hi = F.greatest(F.col("_from") - F.col("at"), F.lit(0)), F.least(F.col("_to") - F.col("at"), size)
    hit = hit.where(((F.col("_from") < F.col("at") + size) & (F.col("_to") > F.col("at"))) | (F.col("segment") == 0))
    cut = F.when(hi > lo, F.hex(F.substring("_bytes", (lo + 1).cast("int"), (hi - lo).cast("int")))).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("segment", cut.alias("hex"))))
    body = hit.groupBy(*id_cols).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p.hex), "")).alias("content"))
    return requests.join(body, list(id_cols), "left")


def char_bases(segments: DataFrame, keys: Sequence[str] = ("ws", "relpath")) -> DataFrame:
    """keys, segment, chars, and ``char_base``: the characters ahead of the segment (sums over one row per segment)."""
    from pyspark.sql.window import Window

    ahead = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select(*keys, "segment", F.char_length(as_text("content")).cast("long").alias("chars"))
    return sizes.withColumn("char_base", F.coalesce(F.sum("chars").over(ahead), F.lit(0)))
