"""Tree scan by frontier rounds: list folders on executors, then stat and read files spread over all tasks.

A round takes one written table of folders, the frontier. Each task lists its folders and goes on below them until
it has seen ``budget`` entries per folder; the folders it has not opened by then are the next round's frontier and
are dealt out anew. So a deep chain takes few rounds, no large subtree stays with one task, and no folder is listed
twice. The driver sees only whether a frontier is empty.

Listing needs names and kinds only. ``stat_entries`` and ``read_files`` then work on the listed paths, dealt out
by path, so the files of one wide folder are spread like any others. Contents are read in segments that end
where a token and, if possible, a line ends (see ``operators/segments.py``); a file's hash is taken as it streams by.

Roots are paths of a file system that all executors mount, or URIs that ``pyarrow.fs`` opens (``s3://``, ``hdfs://``).
Rows: see ``workspace_fs``, whose rules on pruned names, links, hidden and unreadable entries hold here too.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import re
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.operators.segments import SEGMENT, SEGMENT_BYTES, segment_rows
from quarry.session import ship_package
from quarry.sources.staging import staging_path, written
from quarry.sources.workspace_fs import detect_language, should_skip_dir

#: Entries that a task lists below one folder of the frontier before it hands the rest on.
BUDGET = 20_000
_BATCH = 10_000
_BLOCK = 1 << 20

ENTRY = "kind string, relpath string, error string"
STAT = "kind string, ws string, relpath string, size bigint, mtime timestamp, sha string, lang string, error string"
FILE = f"ws string, relpath string, sha string, error string, {SEGMENT}"


class PosixTree:
    """A mounted tree."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def full(self, rel: str) -> str:
        return os.path.join(self.root, rel) if rel else self.root

    def entries(self, rel: str) -> Iterator[tuple[str, str]]:
        """(name, "dir" / "file" / "other") of a folder, in the order the file system gives."""
        with os.scandir(self.full(rel)) as found:
            for e in found:
                yield e.name, "dir" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"

    def stat(self, rel: str) -> tuple[str, int, float]:
        s = os.lstat(self.full(rel))
        return "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other", s.st_size, s.st_mtime

    def open(self, rel: str):
        return open(self.full(rel), "rb")


class ArrowTree:
    """A tree in a store that ``pyarrow.fs`` knows, or in the given file system."""

    def __init__(self, root: str, fs=None):
        from pyarrow import fs as pafs

        self.root = root.rstrip("/")
        self.fs, self.base = pafs.FileSystem.from_uri(self.root) if fs is None else (fs, self.root)
        self._selector, self._kind = pafs.FileSelector, {pafs.FileType.Directory: "dir", pafs.FileType.File: "file"}

    def full(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def _at(self, rel: str) -> str:
        return f"{self.base}/{rel}" if rel else self.base

    def entries(self, rel: str) -> Iterator[tuple[str, str]]:
        for e in self.fs.get_file_info(self._selector(self._at(rel))):
            yield e.base_name, self._kind.get(e.type, "other")

    def stat(self, rel: str) -> tuple[str, int, float]:
        e = self.fs.get_file_info(self._at(rel))
        if e.type.name == "NotFound":
            raise FileNotFoundError(self.full(rel))
        return self._kind.get(e.type, "other"), e.size or 0, e.mtime.timestamp() if e.mtime else 0.0

    def open(self, rel: str):
        return self.fs.open_input_stream(self._at(rel))


def open_tree(root: str) -> PosixTree | ArrowTree:
    scheme = re.match(r"([a-z][a-z0-9+.-]+):", root)
    if scheme is None:
        return PosixTree(root)
    return PosixTree(re.sub(r"^file:(//)?", "", root)) if scheme[1] == "file" else ArrowTree(root)


def _batched(rows: Iterable[tuple], schema: pa.Schema, size: int = _BATCH) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _safe(name: str) -> bool:
    """Whether Arrow can hold a name (it is valid UTF-8)."""
    try:
        name.encode()
        return True
    except UnicodeEncodeError:
        return False


def _expand(tree, folder: str, budget: int) -> Iterator[tuple[str, str, str | None]]:
    """Entries below ``folder``: dir / file / reject, and todo for folders left to the next round."""
    stack, seen = [folder], 0
    while stack:
        here = stack.pop()
        if seen >= budget and here != folder:
            yield "todo", here, None
            continue
        try:
            for name, kind in tree.entries(here):
                child = f"{here}/{name}" if here else name
                seen += 1
                if not _safe(child):
                    yield "reject", child.encode("utf-8", "replace").decode(), "the name is not valid UTF-8"
                elif kind == "dir" and not should_skip_dir(name):
                    yield "dir", child, None
                    stack.append(child)
                elif kind == "file":
                    yield "file", child, None
        except OSError as e:
            yield "reject", here, str(e)


def list_tree(spark: SparkSession, root: str, budget: int = BUDGET) -> DataFrame:
    """(kind, relpath, error): every folder (the root is ``''``) and regular file below ``root``, and what could not be listed."""
    ship_package(spark)
    tree = open_tree(root)
    base = staging_path(spark, "frontier")
    schema = pa.schema([("kind", pa.string()), ("relpath", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = open_tree(root)
        yield from _batched((row for b in batches for rel in b.column(0).to_pylist() for row in _expand(here, rel, budget)), schema)

    name = os.path.basename(tree.full("").rstrip("/"))
    first = [] if should_skip_dir(name) else [("dir", "", None)]
    spark.createDataFrame(first, ENTRY).write.parquet(f"{base}/round=0")
    read = lambda n: spark.read.schema(ENTRY).parquet(f"{base}/round={n}")
    frontier, n = read(0).select("relpath"), 0
    while (size := frontier.count()) > 0:
        n += 1
        dealt = frontier.repartition(max(1, min(size, 4 * spark.sparkContext.defaultParallelism)), "relpath")
        dealt.mapInArrow(run, ENTRY).write.parquet(f"{base}/round={n}")
        frontier = read(n).where("kind = 'todo'").select("relpath")
    return spark.read.schema(f"{ENTRY}, round int").option("basePath", base).parquet(base).where("kind <> 'todo'").select("kind", "relpath", "error")


def _dealt(df: DataFrame, per_task: int = 2_000, bucket: Column | None = None) -> DataFrame:
    """``df`` dealt out by path over enough tasks; paths of one bucket meet in few of them."""
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.count() // per_task + 1)
    if bucket is None:
        return df.repartition(tasks, "relpath")
    each = max(1, tasks // max(1, df.select(bucket).distinct().count()))
    return df.repartition(tasks, bucket, F.pmod(F.xxhash64(F.lit("deal"), "relpath"), F.lit(each)))


def _utc(ts: float) -> _dt.datetime:
    return _dt.datetime.fromtimestamp(ts, tz=_dt.timezone.utc)


def stat_entries(entries: DataFrame, root: str, ws: str) -> DataFrame:
    """Listed entries with size and mtime, language of files, path hash of folders (written once)."""
    ship_package(entries.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("ws", pa.string()), ("relpath", pa.string()), ("size", pa.int64()),
                        ("mtime", pa.timestamp("us", "UTC")), ("sha", pa.string()), ("lang", pa.string()), ("error", pa.string())])

    def one(tree, kind: str, rel: str, error: str | None) -> tuple | None:
        if kind == "reject":
            return "reject", ws, rel, None, None, None, None, error
        try:
            now, size, mtime = tree.stat(rel)
        except OSError as e:
            return "reject", ws, rel, None, None, None, None, str(e)
        if now != kind:  # replaced since it was listed
            return "reject", ws, rel, None, None, None, None, f"no longer a {kind}"
        if kind == "dir":
            return "dir", ws, rel, None, _utc(mtime), hashlib.sha256(tree.full(rel).encode("utf-8", "surrogateescape")).hexdigest(), None, None
        return "file", ws, rel, size, _utc(mtime), None, detect_language(rel), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = open_tree(root)
        yield from _batched((one(tree, *(x.as_py() for x in row)) for b in batches for row in zip(*b.columns)), schema)

    return written(_dealt(entries).mapInArrow(run, STAT), "inventory")


def read_files(files: DataFrame, root: str, segment_bytes: int = SEGMENT_BYTES, content: bool = True, bucket: Column | None = None) -> DataFrame:
    """The bytes of ``files(ws, relpath, size)`` as segments, with the whole file's hash on the last one.

    An empty file has one empty segment. A file that cannot be read has one row with ``error``. Without ``content`` each
    file is one row without bytes. Files are dealt out ahead of reading, by ``bucket`` if one is given, so that a table that is
    partitioned by it needs no shuffle of contents.
    """
    ship_package(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(FILE))

    def rows(tree, ws: str, rel: str, size: int) -> Iterator[tuple]:
        h = hashlib.sha256()

        def blocks(f):
            while block := f.read(_BLOCK):
                h.update(block)
                yield block

        try:
            with tree.open(rel) as f:
                if content:
                    for *place, is_last, part in segment_rows(blocks(f), segment_bytes):
                        yield ws, rel, h.hexdigest() if is_last else None, None, *place, is_last, size, part
                else:
                    for _ in blocks(f):
                        pass
                    yield ws, rel, h.hexdigest(), None, 0, 0, 0, 0, False, True, size, None
        except OSError as e:
            yield ws, rel, None, str(e), 0, 0, 0, 0, False, True, size, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part, held = open_tree(root), [], 0
        for b in batches:
            for file in zip(*(b.column(i).to_pylist() for i in range(3))):
                for r in rows(tree, *file):
                    part.append(r)
                    held += len(r[-1] or b"") + 200
                    if held > 4 * SEGMENT_BYTES:
                        yield from _batched(part, schema)
                        part, held = [], 0
        yield from _batched(part, schema)

    return _dealt(files.select("ws", "relpath", "size"), bucket=bucket).mapInArrow(run, FILE)


def scan_tree(spark: SparkSession, root: str, ws: str, budget: int = BUDGET) -> DataFrame:
    """The inventory of ``root`` with hashes: the rows of ``workspace_fs`` without contents (those: ``read_files``)."""
    found = stat_entries(list_tree(spark, root, budget), root, ws)
    read = written(read_files(found.where("kind = 'file'"), root, content=False), "hashes")
    return with_hashes(found, read)


def with_hashes(found: DataFrame, read: DataFrame) -> DataFrame:
    """``stat_entries`` rows with the hashes of ``read_files`` rows; unreadable files become rejects."""
    done = read.where(F.col("sha").isNotNull() | F.col("error").isNotNull())  # the last segment of each file
    done = done.select("relpath", F.col("sha").alias("read_sha"), F.col("error").alias("read_error"))
    out = found.join(done, "relpath", "left")
    bad = F.col("read_error").isNotNull()
    good = lambda c: F.when(~bad, F.col(c)).alias(c)
    return out.select(F.when(bad, "reject").otherwise(F.col("kind")).alias("kind"), "ws", "relpath", good("size"), good("mtime"),
                      F.coalesce("sha", "read_sha").alias("sha"), good("lang"), F.coalesce("error", "read_error").alias("error"))
