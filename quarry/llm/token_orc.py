"""Token ids in ORC: encode whole texts, write sorted stripes, read them back.

Rows are range-partitioned and sorted by document id, so every file covers one id interval and its stripes
are ordered: min/max statistics of files, stripes and row groups prune id ranges, a Bloom filter on the id
prunes point reads, and any number of tasks read stripes in parallel. Integer columns use ORC's run-length
encoding. Texts (not ids) are what the one shuffle moves: they compress better than their token ids.

Encoding runs on distinct chunks: a text is cut at single spaces between two non-space characters, where the
byte-level pre-tokenizer always ends a token, and each distinct chunk is encoded once by the tokenizers
library and remembered in a bounded table per worker.

Defined results: NULL text is empty (only the end id). Rows with a NULL id come first, repeated ids follow
each other ordered by text; every row stays. An empty table gives empty results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import prepare, shared_path, tokenizer_file

#: Distinct chunks remembered per Python worker (about 200 bytes each); the table is emptied when full.
CACHE_CHUNKS = 700_000
#: Characters encoded per call, so that one Arrow batch of long texts needs no more memory than one such slice.
SLICE_CHARS = 4_000_000
_STATE: dict[str, ChunkEncoder] = {}


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class ChunkEncoder:
    """Token ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    ``seen`` numbers the words that followed a space; word ``n`` (with its space) has the ids
    ``flat[start[n]:start[n] + size[n]]``.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self._lines = partial(getattr(self.lib, "encode_batch_fast", self.lib.encode_batch), add_special_tokens=False)
        # tokens that begin with a space, which byte-level vocabularies write as U+0120
        self.leads = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)
        self.leads[[i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if t.startswith("\u0120")]] = True
        self._empty()

    def _empty(self) -> None:
        self.seen = _Numbers()
        self.flat, self.size, self.start = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)
        self.cut = np.empty(0, bool)  # whether the space ahead of the word is a cut

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._lines(texts)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size

    def _learn(self) -> None:
        """Ids of the words numbered since the last call.

        Words are encoded in long lines: every word that begins and ends with a non-space starts a token that
        holds its leading space, and no other token of it does, so the line's ids fall apart at those tokens.
        """
        known = len(self.size)
        if len(self.seen) == known:
            return
        new = list(islice(self.seen, known, None))
        cut = np.fromiter(map(str.__eq__, new, map(str.strip, new)), bool, len(new))
        cut &= np.fromiter(map(len, new), np.int64, len(new)) > 0
        good = [w for w, c in zip(new, cut.tolist()) if c]
        lines = [good[k:k + 1000] for k in range(0, len(good), 1000)]
        flat, sizes = [], []
        for line, found in zip(lines, self._lines([" " + " ".join(line) for line in lines])):
            ids = np.array(found.ids, "<u4")
            begin = np.flatnonzero(self.leads[ids])
            size = np.diff(begin, append=len(ids))
            if len(size) != len(line):
                raise ValueError("the tokenizer does not keep a leading space in a word's first token")
            flat.append(ids)
            sizes.append(size)
        size = np.zeros(len(new), np.int64)
        if sizes:
            size[cut] = np.concatenate(sizes)
        self.flat = np.concatenate([self.flat, *flat])
        self.size, self.cut = np.concatenate([self.size, size]), np.concatenate([self.cut, cut])
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text); every text ends with ``end_id``."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if len(self.seen) > CACHE_CHUNKS:
            self._empty()
        words = pc.split_pattern(texts, " ")
        ends, words = words.offsets.to_numpy(), words.flatten()
        begin, count = ends[:-1] - ends[0], np.diff(ends) - 1  # each text's first word, and the words after it
        firsts = words.take(pa.array(begin)).to_pylist()
        later = np.ones(len(words), bool)
        later[begin] = False
        # the table is asked once for each distinct word of the call
        found = words.filter(pa.array(later)).dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.seen.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
        self._learn()
        # a space that touches other white space is no cut: such texts are encoded whole
        owner = np.repeat(np.arange(len(texts)), count)
        odd = np.bincount(owner[~self.cut[number]], minlength=len(texts)) > 0
        odd |= np.fromiter((not f or f[-1].isspace() for f in firsts), bool, len(firsts)) & (count > 0)
        for k in np.flatnonzero(odd).tolist():
            firsts[k] = texts[k].as_py()
        number, count = number[~odd[owner]], np.where(odd, 0, count)
        head, head_size = self._whole(firsts)
        # pieces in order: each text's head, its words and the end id; a piece is a stretch of ``source``
        last = np.cumsum(count + 2) - 1
        first = last - count - 1
        inner = np.ones(int(last[-1]) + 1 if len(last) else 0, bool)
        inner[first] = inner[last] = False
        start, size = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
        start[first], size[first] = np.cumsum(head_size) - head_size, head_size
        start[inner], size[inner] = self.start[number] + len(head), self.size[number]
        start[last], size[last] = len(head) + len(self.flat), 1
        source = np.concatenate([head, self.flat, np.array([end_id], "<u4")])
        stop = np.cumsum(size)
        at = np.repeat(start - (stop - size), size)
        at += np.arange(len(at))
        return source[at], np.diff(stop[last], prepend=0)


def encoder(path: str) -> ChunkEncoder:
    if path not in _STATE:
        _STATE[path] = ChunkEncoder(tokenizer_file(path))
    return _STATE[path]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` characters (a single longer text is its own range)."""
    return ranges([len(t) if t else 0 for t in texts], limit)


def ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum up to at most ``limit`` (a single larger one is its own range)."""
    begin = size = 0
    for k, n in enumerate(sizes):
        if size + n > limit and k > begin:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 stripe_mb: int = 64) -> None:
    """Write ``df`` as ORC below ``path`` in ascending id order (files, stripes and rows).

    Columns: doc_id, ``part`` (the file's place in the order), ``at`` (ids of the file before the row), ``n``, ids.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = encoder(tokenizer), 0
        for b in batches:
            texts = b.column(2).fill_null("")
            for lo, hi in ranges(pc.utf8_length(texts).to_pylist(), SLICE_CHARS):
                flat, sizes = enc.encode(texts.slice(lo, hi - lo), end_id)
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(done + ends - sizes), pa.array(sizes), ids],
                    ["doc_id", "part", "at", "n", "ids"])
                done += int(ends[-1])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "text")
    (rows.mapInArrow(run, "doc_id long, part int, at long, n long, ids array<int>").write
     .option("compression", "zstd").option("orc.stripe.size", stripe_mb << 20).option("orc.row.index.stride", 1000)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on ``doc_id`` prune files, stripes and row groups."""
    return spark.read.schema("doc_id long, part int, at long, n long, ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the files.

    The files' totals (one row per file) are summed up in file order; a row starts at its file's total plus ``at``.
    """
    prepare(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = np.fromiter((zlib.crc32(flat[a:e]) for a, e in zip(offsets, offsets[1:])), np.int64, len(ids))
            n = np.diff(offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n), pa.array(crc)],
                                             ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path).groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    rows = read_tokens(spark, path).select("doc_id", "part", "at", "ids").mapInArrow(
        digest, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_index(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write to the shared folder, return the index read back from the files."""
    spark = df.sparkSession
    path = shared_path(spark, "tokens-orc")
    write_tokens(df, path, tokenizer, end_id, id_col, text_col)
    return token_index(spark, path)
