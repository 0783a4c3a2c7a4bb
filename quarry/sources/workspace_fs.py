"""``workspace_fs``: a Python data source that inventories a tree of files.

    spark.dataSource.register(WorkspaceFsDataSource)
    df = spark.read.format("workspace_fs").option("root", "/data/ws").option("ws", "alpha").load()

One row per directory (the root is ``relpath = ''``) and per regular file,
with size, UTC mtime, SHA-256 and a language hint; ``content`` (bytes) only
with ``option("content", "true")``. Directories named ``.git .hg .svn
node_modules .idea .vscode`` (any case) are pruned with their subtree;
symlinks and devices are skipped; dot files, ``_`` files and empty files and
directories are kept. An entry that cannot be read gives a ``kind = 'reject'``
row with the error instead of failing the scan.

Work split: the driver lists only the top directory levels, breadth first,
until there are about ``partitions`` units: each unexpanded directory is one
unit (walked recursively on an executor) and the files directly inside an
expanded directory are split into name-hash buckets. Units are packed,
largest first, into at most ``partitions`` input partitions (default: twice
the cluster's default parallelism). File bytes are read,
hashed and (optionally) returned on executors only. All executors must see
the same file system path.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import os
import stat
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.constants import LANGUAGE_BY_EXTENSION, LANGUAGE_NO_EXTENSION, SKIP_DIR_NAMES

SCHEMA = ("kind string, ws string, relpath string, size bigint, mtime timestamp, sha string, "
          "lang string, content binary, error string")

FILES_PER_BUCKET = 2000
TREE_WEIGHT = 1000  # an unexpanded subtree is assumed to hold about this many files
_READ_BLOCK = 1 << 20


def should_skip_dir(name: str) -> bool:
    return name.lower() in SKIP_DIR_NAMES


def detect_language(path: str) -> str:
    """Python twin of :func:`quarry.functions.paths.detect_language` (used while walking)."""
    base = path.rsplit("/", 1)[-1]
    dot = base.rfind(".")
    if dot < 0:
        return LANGUAGE_NO_EXTENSION
    ext = base[dot:].lower()
    return LANGUAGE_BY_EXTENSION.get(ext, ext[1:])


@dataclass
class ScanUnit:
    """``mode``: ``self``/``dir`` (one directory row), ``tree`` (walk recursively),
    ``files`` (direct files of one directory, one name-hash bucket)."""
    rel: str
    mode: str
    bucket: int = 0
    buckets: int = 1
    weight: int = 1


@dataclass
class ScanPartition(InputPartition):
    units: tuple


def pack(units: list[ScanUnit], n: int) -> list[ScanPartition]:
    """Greedy longest-first packing of work units into at most ``n`` partitions."""
    n = max(1, min(n, len(units)))
    bins: list[list[ScanUnit]] = [[] for _ in range(n)]
    load = [0] * n
    for u in sorted(units, key=lambda u: -u.weight):
        i = load.index(min(load))
        bins[i].append(u)
        load[i] += u.weight
    return [ScanPartition(tuple(b)) for b in bins if b]


def _utc(ts: float) -> _dt.datetime:
    return _dt.datetime.fromtimestamp(ts, tz=_dt.timezone.utc).replace(tzinfo=None)


class WorkspaceFsReader(DataSourceReader):
    def __init__(self, options: dict):
        root = options.get("root")
        if not root:
            raise ValueError("option 'root' is required")
        self.root = os.path.abspath(root)
        self.ws = options.get("ws", "")
        self.with_content = str(options.get("content", "false")).lower() == "true"
        self.with_hash = str(options.get("hash", "true")).lower() == "true"
        self.target = int(options.get("partitions", "32"))

    # -------------------------------------------------------------- planning (driver)
    def partitions(self):
        if not os.path.isdir(self.root):
            raise ValueError(f"workspace root {self.root} is not a directory")
        if should_skip_dir(os.path.basename(self.root.rstrip("/"))):
            return [ScanPartition(())]
        units: list[ScanUnit] = [ScanUnit("", "self")]
        frontier = [""]
        trees: list[str] = []
        while frontier:
            if len(trees) + len(frontier) >= self.target:
                trees.extend(frontier)
                break
            nxt = []
            for rel in frontier:
                n_files, subdirs = self._list(rel)
                nb = max(1, -(-n_files // FILES_PER_BUCKET))
                if n_files:
                    units.extend(ScanUnit(rel, "files", b, nb, -(-n_files // nb)) for b in range(nb))
                nxt.extend(subdirs)
                units.extend(ScanUnit(d, "dir") for d in subdirs)
            frontier = nxt
        units.extend(ScanUnit(t, "tree", weight=TREE_WEIGHT) for t in trees)
        return pack(units, self.target)

    def _list(self, rel: str):
        full = os.path.join(self.root, rel) if rel else self.root
        n_files, subdirs = 0, []
        try:
            with os.scandir(full) as it:
                for e in it:
                    if e.is_dir(follow_symlinks=False):
                        if not should_skip_dir(e.name):
                            subdirs.append(f"{rel}/{e.name}" if rel else e.name)
                    else:
                        n_files += 1
        except OSError:
            pass  # reported by the executor that owns this directory
        return n_files, sorted(subdirs)

    # -------------------------------------------------------------- reading (executors)
    def read(self, partition: ScanPartition):
        for u in partition.units:
            yield from self._read_unit(u)

    def _read_unit(self, u: ScanUnit):
        if u.mode == "self":
            yield self._dir_row("")
        elif u.mode == "dir":
            yield self._dir_row(u.rel)
        elif u.mode == "files":
            yield from self._direct_files(u.rel, u.bucket, u.buckets)
        elif u.mode == "tree":
            yield from self._walk(u.rel, emit_self=False)

    def _full(self, rel: str) -> str:
        return os.path.join(self.root, rel) if rel else self.root

    def _dir_row(self, rel: str):
        full = self._full(rel)
        try:
            st = os.lstat(full)
            sha = hashlib.sha256(full.encode("utf-8", "surrogateescape")).hexdigest()
            return ("dir", self.ws, rel, None, _utc(st.st_mtime), sha, None, None, None)
        except OSError as e:
            return ("reject", self.ws, rel, None, None, None, None, None, str(e))

    def _file_row(self, rel: str, st: os.stat_result):
        full = self._full(rel)
        try:
            h = hashlib.sha256()
            keep = self.with_content
            parts = [] if keep else None
            with open(full, "rb") as f:
                while True:
                    block = f.read(_READ_BLOCK)
                    if not block:
                        break
                    if self.with_hash:
                        h.update(block)
                    if keep:
                        parts.append(block)
            return ("file", self.ws, rel, int(st.st_size), _utc(st.st_mtime), h.hexdigest() if self.with_hash else None,
                    detect_language(rel), b"".join(parts) if keep else None, None)
        except OSError as e:
            return ("reject", self.ws, rel, None, None, None, None, None, str(e))

    def _entries(self, rel: str):
        full = self._full(rel)
        with os.scandir(full) as it:
            return sorted(((e.name, e) for e in it), key=lambda x: x[0])

    def _direct_files(self, rel: str, bucket: int, buckets: int):
        try:
            entries = self._entries(rel)
        except OSError as e:
            yield ("reject", self.ws, rel, None, None, None, None, None, str(e))
            return
        for name, e in entries:
            if buckets > 1 and zlib.crc32(name.encode("utf-8", "surrogateescape")) % buckets != bucket:
                continue
            child = f"{rel}/{name}" if rel else name
            try:
                st = e.stat(follow_symlinks=False)
            except OSError as err:
                yield ("reject", self.ws, child, None, None, None, None, None, str(err))
                continue
            if stat.S_ISREG(st.st_mode):
                yield self._file_row(child, st)

    def _walk(self, rel: str, emit_self: bool):
        stack = [(rel, emit_self)]
        while stack:
            cur, emit = stack.pop()
            if emit:
                yield self._dir_row(cur)
            try:
                entries = self._entries(cur)
            except OSError as e:
                yield ("reject", self.ws, cur, None, None, None, None, None, str(e))
                continue
            subdirs = []
            for name, e in entries:
                child = f"{cur}/{name}" if cur else name
                try:
                    st = e.stat(follow_symlinks=False)
                except OSError as err:
                    yield ("reject", self.ws, child, None, None, None, None, None, str(err))
                    continue
                if stat.S_ISDIR(st.st_mode):
                    if not should_skip_dir(name):
                        subdirs.append(child)
                elif stat.S_ISREG(st.st_mode):
                    yield self._file_row(child, st)
            stack.extend((d, True) for d in reversed(subdirs))


class WorkspaceFsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace_fs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkspaceFsReader(self.options)


def register(spark) -> None:
    from quarry.session import ship_package

    ship_package(spark)  # executors unpickle the reader class from this package
    spark.dataSource.register(WorkspaceFsDataSource)


def read_workspace(spark, root: str, ws: str, content: bool = False, partitions: int | None = None):
    """The inventory of ``root`` as a DataFrame (see module docs)."""
    register(spark)
    r = spark.read.format("workspace_fs").option("root", root).option("ws", ws).option(
        "content", "true" if content else "false")
    r = r.option("partitions", str(partitions or 2 * spark.sparkContext.defaultParallelism))
    return r.load()
