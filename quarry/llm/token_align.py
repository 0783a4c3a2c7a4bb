"""Alignment of two tokenizers' tokens by whitespace-token anchors.

A text is encoded whole by both tokenizers: A (byte-level byte-pair encoding) encodes a space and the text, B (a
SentencePiece model) the text, ahead of which it puts a space itself. Both sides' tokens stand for bytes;
only texts whose bytes come back from both sides are aligned. A token that begins with the space mark on
both sides at one byte offset is an anchor: the tokens ahead of it are checked to end together there. Anchors
cut a text into windows of token ids, and what happens inside a window depends on its ids alone. So each
distinct pair of id tuples is aligned once per worker and remembered (a bounded table, emptied when full).

Inside a window the offsets at which tokens of both sides end cut it into groups, written as
``a1,a2|b1;a3|b2,b3``. The two tokens that end a group end together: a link. ``link_counts`` counts the links of
each id pair over all texts and tells each B id's most frequent partners; ``score`` brings the counts back to
the rows.

Defined results: NULL and empty texts, and texts that a tokenizer changes (such as U+2581, which decodes to a
space), have no tokens: zeros, no groups and no links. Special tokens' strings are plain text. Repeated rows
and NULL ids stay rows of their own. An empty table gives empty results. Extra columns stay unless they are
named like a result (in any case). Memory grows with ``SLICE_CHARS`` or the longest text, if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.llm.common import prepare, tokenizer_file
from quarry.llm.shingles import mix
from quarry.llm.token_orc import ChunkEncoder, _Numbers, ranges

#: Distinct windows, and words of tokenizer A, remembered per worker; characters encoded at once.
CACHE_WINDOWS, CACHE_CHUNKS, SLICE_CHARS = 300_000, 300_000, 1_000_000
#: A table of counts of at most this many id pairs (24 bytes each) is broadcast; a larger one is joined by key.
BROADCAST_PAIRS = 1_000_000

_GAP = b"\xff\xff\xff\xff"  # no token id
_STATE: dict[tuple[str, str], Aligner] = {}


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1 characters are themselves, the
    other bytes are the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Side:
    """Bytes of a vocabulary's tokens, and which of them begin with the space mark."""

    def __init__(self, tokens: list[bytes]):
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.leads = np.array([t[:1] == b" " for t in tokens], bool)
        self.name = [str(k) for k in range(len(tokens))]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.raw[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 .. (n[0] numbers), first[1] .."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _digests(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, side: int) -> np.ndarray:
    """A 64-bit hash of each window's ids (windows follow each other without gaps and are not empty)."""
    place = np.arange(len(ids)) - np.repeat(begin, end - begin)
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(side)
    return np.add.reduceat(mix(h), begin) if len(begin) else np.empty(0, np.uint64)


def _equal(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, like: np.ndarray) -> bool:
    """Whether every window has the ids of window ``like``."""
    size = end - begin
    return bool((size == size[like]).all()) and bool((ids == ids[_spread(begin[like], size)]).all())


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ChunkEncoder(path_a)
        self.a.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        byte = _byte_of()
        vocab = self.a.lib.get_vocab(with_added_tokens=True)
        added = {str(t.content) for t in self.a.lib.get_added_tokens_decoder().values()}
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = t.encode() if t in added else bytes(byte[c] for c in t)
        self.side_a = _Side(tokens)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = _Side([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # the one token of "x", which the first side's texts are given as a first word
        self.lead = len(self.a.lib.encode("x", add_special_tokens=False).ids)
        self._forget()

    def _forget(self) -> None:
        self.seen = _Numbers()
        self.text: list[str] = []  # groups of each window
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)  # links of each window
        self.links = np.empty(0, np.int64)
        self.n_links = 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, A ids per text, B ids, B ids per text) of whole texts."""
        if len(self.a.seen) > CACHE_CHUNKS:
            self.a._empty()
        # the word "x" and an end id are encoded besides and taken off again
        flat, size = self.a.encode(["x " + t for t in texts], 0)
        flat, size = flat.astype(np.int64), size - self.lead - 1
        begin = np.cumsum(size + self.lead + 1) - size - 1
        flat = flat[_spread(begin, size)]
        found = self.b.encode(texts, num_threads=1)
        size_b = np.fromiter(map(len, found), np.int64, len(found))
        flat_b = np.fromiter((i for ids in found for i in ids), np.int64, int(size_b.sum()))
        return flat, size, flat_b, size_b

    def align(self, texts: list[str]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, link codes, times) per text; a code is ``a * (B's size) + b``."""
        if len(self.seen) > CACHE_WINDOWS:
            self._forget()
        none = np.empty(0, np.int64)
        rows: list[tuple] = [(0, 0, 0, "", none, none)] * len(texts)
        ids_a, size_a, ids_b, size_b = self._ids(texts)
        raw = [b" " + t.encode() for t in texts]
        ok = self._same(self.side_a, ids_a, size_a, raw) & self._same(self.side_b, ids_b, size_b, raw)
        ok &= np.array([bool(t) for t in texts], bool)
        use = np.flatnonzero(ok)
        if not len(use):
            return rows
        ids_a = ids_a[_spread((np.cumsum(size_a) - size_a)[use], size_a[use])]
        ids_b = ids_b[_spread((np.cumsum(size_b) - size_b)[use], size_b[use])]
        size_a, size_b = size_a[use], size_b[use]
        windows = self._windows(ids_a, ids_b, np.array([len(raw[k]) for k in use.tolist()], np.int64))
        number, per_text = self._number(ids_a, ids_b, *windows)
        ends = np.cumsum(per_text)
        for k, n_a, n_b, lo, hi in zip(use.tolist(), size_a.tolist(), size_b.tolist(), (ends - per_text).tolist(), ends.tolist()):
            mine = number[lo:hi]
            n = self.count[mine]
            codes, times = np.unique(self.links[_spread(self.first[mine], n)], return_counts=True)
            rows[k] = (n_a, n_b, int(n.sum()), ";".join([self.text[w] for w in mine.tolist()]), codes, times)
        return rows

    @staticmethod
    def _same(side: _Side, ids: np.ndarray, size: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether each text's tokens stand for its bytes."""
        have = side.bytes_of(ids)
        cut = np.concatenate([[0], np.cumsum(side.size[ids])])
        ends = cut[np.cumsum(size)].tolist()
        begins = [0, *ends[:-1]]
        return np.array([have[a:e] == r for a, e, r in zip(begins, ends, raw)], bool)

    def _windows(self, ids_a: np.ndarray, ids_b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first A token, first B token) of every window, and windows per text (``size``: bytes of each text)."""
        start_a = np.cumsum(self.side_a.size[ids_a]) - self.side_a.size[ids_a]
        start_b = np.cumsum(self.side_b.size[ids_b]) - self.side_b.size[ids_b]
        total = int(size.sum())
        text_at = np.cumsum(size) - size
        mark = np.zeros(total + 1, bool)
        mark[start_a[self.side_a.leads[ids_a]]] = True
        anchor = self.side_b.leads[ids_b] & mark[start_b]  # both sides' earlier tokens end at this byte
        mark[:] = False
        mark[text_at] = True
        anchor |= mark[start_b]
        at_b = np.flatnonzero(anchor)
        offset = start_b[at_b]
        at_a = np.searchsorted(start_a, offset)
        per_text = np.diff(np.searchsorted(offset, np.append(text_at, total)))
        return at_a, at_b, per_text

    def _number(self, ids_a: np.ndarray, ids_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered number of every window; new ones are aligned."""
        end_a, end_b = np.append(at_a[1:], len(ids_a)), np.append(at_b[1:], len(ids_b))
        # equal windows of the slice are found by hash and compared; each distinct one is looked up once
        code = _digests(ids_a, at_a, end_a, 1) + _digests(ids_b, at_b, end_b, 2)
        _, first, same = np.unique(code, return_index=True, return_inverse=True)
        if not (_equal(ids_a, at_a, end_a, first[same]) and _equal(ids_b, at_b, end_b, first[same])):
            first = same = np.arange(len(at_a))
        ask, known = self.seen.__getitem__, len(self.seen)
        raw_a, raw_b = ids_a.astype("<u4").tobytes(), ids_b.astype("<u4").tobytes()
        places = zip(*((4 * x[first]).tolist() for x in (at_a, end_a, at_b, end_b)))
        keys = [raw_a[p:q] + _GAP + raw_b[r:s] for p, q, r, s in places]
        number = np.fromiter(map(ask, keys), np.int64, len(keys))
        if len(self.seen) > known:
            _, where = np.unique(number, return_index=True)
            where = first[where[number[where] >= known]]
            self._learn(ids_a, at_a[where], end_a[where], ids_b, at_b[where], end_b[where])
        return number[same], per_text

    def _learn(self, ids_a, at_a, end_a, ids_b, at_b, end_b) -> None:
        """Align new windows: common ends of their tokens, groups and links."""
        size_a, size_b = end_a - at_a, end_b - at_b
        a, b = ids_a[_spread(at_a, size_a)], ids_b[_spread(at_b, size_b)]
        stop_a, stop_b = np.cumsum(self.side_a.size[a]), np.cumsum(self.side_b.size[b])  # every window has as many bytes on both sides
        place = np.full(int(stop_a[-1]) + 1, -1, np.int64)
        place[stop_a] = np.arange(len(a))
        last_b = np.flatnonzero(place[stop_b] >= 0)
        last_a = place[stop_b[last_b]]
        per = np.diff(np.searchsorted(last_b, np.append(0, np.cumsum(size_b))))
        name_a, name_b = self.side_a.name, self.side_b.name
        words_a, words_b = [name_a[i] for i in a.tolist()], [name_b[i] for i in b.tolist()]
        groups, p, r = [], 0, 0
        for q, s in zip((last_a + 1).tolist(), (last_b + 1).tolist()):
            groups.append(f"{words_a[p]}|{words_b[r]}" if q - p == s - r == 1 else ",".join(words_a[p:q]) + "|" + ",".join(words_b[r:s]))
            p, r = q, s
        cut = iter(groups)
        self.text += [";".join(islice(cut, n)) for n in per.tolist()]
        self.first = np.concatenate([self.first, self.n_links + np.cumsum(per) - per])
        self.count = np.concatenate([self.count, per])
        self.links = np.concatenate([self.links, a[last_a] * len(self.side_b.size) + b[last_b]])
        self.n_links = len(self.links)


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _STATE:
        _STATE[path_a, path_b] = Aligner(path_a, path_b)
    return _STATE[path_a, path_b]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")


def add_alignment(df: DataFrame, tokenizer_a: str, tokenizer_b: str, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with n_a, n_b, n_groups, n_links, groups and links (distinct id pairs and how often they are linked).

    ``tokenizer_a`` and ``tokenizer_b`` are files (see ``common.tokenizer_file``); ``pair`` is ``a << 32 | b``. ``keep`` names
    the columns to pass on (default: all). Results leave the worker slice by slice, so one batch of texts never has all
    its groups in memory.
    """
    prepare(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in NAMES]
    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, times: int>>").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(tokenizer_file(tokenizer_a), tokenizer_file(tokenizer_b))
        wide = len(tool.side_b.size)
        for b in batches:
            texts = b.column(0)
            sizes = [n or 0 for n in pc.utf8_length(texts).to_pylist()]
            for lo, hi in ranges(sizes, SLICE_CHARS):
                rows = tool.align([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                end = np.cumsum([0, *(len(r[4]) for r in rows)])
                codes, times = np.concatenate([r[4] for r in rows]), np.concatenate([r[5] for r in rows])
                items = pa.StructArray.from_arrays([pa.array((codes // wide << 32) | codes % wide), pa.array(times.astype(np.int32))], ["pair", "times"])
                links = pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), items)
                found = [*numbers, numbers[2], pa.array([r[3] for r in rows], pa.string()), links]
                cols = [c.slice(lo, hi - lo) for c in b.columns[1:]] + found
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links of the pair over all rows) and best (no pair of the same B id has more)."""
    links = aligned.select(F.explode("links").alias("link")).groupBy(F.col("link.pair").alias("pair")).agg(F.sum("link.times").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = links.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return links.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame, row_col: str) -> DataFrame:
    """``row_col``, n_best (links of a most frequent pair of their B id) and count_sum (their pairs' counts) per row with links.

    ``row_col`` tells rows apart. Both tables should be written ones, since they are read twice.
    """
    if counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select(row_col, F.explode("links").alias("link")).select(row_col, F.col("link.pair").alias("pair"), F.col("link.times").alias("times"))
    links = links.join(counts, "pair")
    return links.groupBy(row_col).agg(F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(F.lit(0))).alias("n_best"),
                                      F.sum(F.col("count") * F.col("times")).alias("count_sum"))
