"""SentencePiece encoding and decoding by suffix-array matching.

A task concatenates the distinct words of its batch that it has not met before, sorts the suffixes of that
text (to the length of the longest piece), and finds the occurrence range of every piece by binary search.
The ranges give edges (begin, end, piece), which are sorted by position and relaxed from left to right.

The models are byte-pair encodings, so relaxing uses their own rule instead of a sum of scores: an encoding is
the model's exactly when every two neighbouring pieces would be left apart by the merge rules, and every
prefix of a word has one encoding. An edge is therefore taken when its piece may follow the piece that ends
the encoding of the prefix; pairs are decided once by merging their few characters and remembered.

Words are cut ahead of a run of word marks (U+2581), which no piece holds after another character. The pieces
of several marks have the lowest priority, so runs of marks are joined last, from the left. Characters
without a piece become byte pieces. Decoding concatenates the pieces' bytes.

Defined results: NULL and empty texts have no ids and decode to the empty text. Every row gives one row; NULL
ids, repeated rows and an empty table need no special care. Extra columns are kept unless named like a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name, give_back, prepare, tokenizer_file
from quarry.llm.token_orc import _Numbers, slices

MARK = "▁"
#: Characters of the distinct words, and piece pairs, remembered per Python worker; either table is emptied when full.
CACHE_CHARS, CACHE_PAIRS, FRESH_PAIRS = 4_000_000, 4_000_000, 50_000
#: Characters whose edges are held at once (about 0.3 kB each), and characters of the texts encoded per call.
BLOCK_CHARS, SLICE_CHARS = 200_000, 1_000_000
_STATE: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        score = [lib.get_score(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word mark after another character")
        self.marks = {len(self.pieces[i]): i for i in plain if set(self.pieces[i]) == {MARK}}
        plain = [i for i in plain if len(self.pieces[i]) == 1 or set(self.pieces[i]) != {MARK}]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -score[i] for i in plain if len(self.pieces[i]) > 1}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        # characters that occur in pieces but are none themselves get numbers after the pieces
        self.symbols = dict(self.id_of)
        for ch in sorted({ch for i in plain for ch in self.pieces[i]} - set(self.id_of)):
            self.symbols[ch] = size + len(self.symbols) - len(self.id_of)
        self.text_of = {i: s for s, i in self.symbols.items()}
        self.size = size
        # only pieces that the merge rules can reach
        reach = [i for i in plain if self._merge(self.pieces[i]) == [self.pieces[i]]]
        self.reach = np.array(reach, np.int64)
        self.long = max(len(self.pieces[i]) for i in reach)
        self.length = np.array([len(self.pieces[i]) for i in reach], np.int64)
        self.codes = np.zeros((len(reach), self.long), np.int64)
        for r, i in enumerate(reach):
            self.codes[r, :len(self.pieces[i])] = [*map(ord, self.pieces[i])]
        raw = [bytes([int(self.pieces[i][1:-1], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i)
               else b" \xe2\x81\x87 " if lib.is_unknown(i) else self.pieces[i].replace(MARK, " ").encode() for i in range(size)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self._forget()
        # decided pairs: sorted arrays (the first key stands for none), and those decided last
        self.pair_keys, self.pair_apart = np.array([-1], np.int64), np.zeros(1, bool)
        self.fresh: dict[int, bool] = {}

    def _forget(self) -> None:
        self.seen = _Numbers()
        self.chars = 0
        self.flat, self.count = np.empty(0, np.int32), np.empty(0, np.int32)

    def _merge(self, s: str) -> list[str]:
        """Byte-pair encoding of a few characters by its definition."""
        parts = list(s)
        while len(parts) > 1:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merge rules leave ``left``, ``right`` apart (numbers of symbols)."""
        wide = len(self.symbols) + self.size + 1
        keys, back = np.unique(left * wide + right, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = self.pair_keys[at] == keys
        out = self.pair_apart[at]
        fresh = self.fresh
        for k in np.flatnonzero(~known).tolist():
            key = int(keys[k])
            ok = fresh.get(key)
            if ok is None:
                a, b = self.text_of.get(key // wide), self.text_of.get(key % wide)
                ok = fresh[key] = a is None or b is None or self._merge(a + b) == [a, b]
            out[k] = ok
        if len(fresh) > FRESH_PAIRS:
            self._settle()
        return out[back]

    def _settle(self) -> None:
        """Take the pairs decided last into the sorted arrays; these are emptied when full."""
        if len(self.pair_keys) > CACHE_PAIRS:
            self.pair_keys, self.pair_apart = self.pair_keys[:1], self.pair_apart[:1]
        keys = np.concatenate([self.pair_keys, np.fromiter(self.fresh.keys(), np.int64, len(self.fresh))])
        apart = np.concatenate([self.pair_apart, np.fromiter(self.fresh.values(), bool, len(self.fresh))])
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_apart = keys[order], apart[order]
        self.fresh.clear()

    def _edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, symbol) of every occurrence of a piece in ``code``, through its suffix array."""
        alphabet = np.unique(code)
        bits = int(len(alphabet) + 1).bit_length()
        per = 62 // bits
        depth = -(-self.long // per)
        local = np.searchsorted(alphabet, code) + 1
        padded = np.concatenate([local, np.zeros(depth * per, np.int64)])
        keys = []
        for d in range(depth):
            k = np.zeros(len(code), np.int64)
            for j in range(per):
                k = (k << bits) | padded[d * per + j:d * per + j + len(code)]
            keys.append(k)
        suffix = np.lexsort(keys[::-1])
        keys = [k[suffix] for k in keys]
        # pieces in the batch's alphabet; their keys end in zeros (low) or ones (high)
        at = np.searchsorted(alphabet, self.codes)
        inside = np.arange(self.long) < self.length[:, None]
        mine = np.where(inside & (alphabet[np.minimum(at, len(alphabet) - 1)] == self.codes), at + 1, 0)
        use = np.flatnonzero(((mine > 0) == inside).all(1))
        mine, length = mine[use], self.length[use]
        mine = np.concatenate([mine, np.zeros((len(use), depth * per - self.long), np.int64)], 1)
        beyond = np.arange(depth * per) >= length[:, None]
        found = []
        for fill in (0, (1 << bits) - 1):
            want = np.where(beyond, fill, mine).reshape(len(use), depth, per)
            want = [(want[:, d] << (bits * np.arange(per - 1, -1, -1))).sum(1) for d in range(depth)]
            lo, hi = np.zeros(len(use), np.int64), np.full(len(use), len(code), np.int64)
            while (open_ := lo < hi).any():  # vectorised binary search over (key 0, key 1, ...)
                mid = (lo + hi) // 2
                m = np.minimum(mid, len(code) - 1)
                less, same = np.zeros(len(use), bool), np.ones(len(use), bool)
                for k, w in zip(keys, want):
                    less |= same & (k[m] < w)
                    same &= k[m] == w
                if fill:
                    less |= same  # upper bound
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            found.append(lo)
        first, times = found[0], found[1] - found[0]
        begin = suffix[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        return begin, begin + np.repeat(length, times), np.repeat(self.reach[use], times)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of words that begin with a mark; '' has none."""
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size + 1) - size - 1
        word_start = np.repeat(start, size + 1)
        offset = np.arange(len(code)) - word_start
        begin, end, symbol = self._edges(code)
        keep = offset[begin] + (end - begin) <= np.repeat(size, size + 1)[begin]  # a separator may be a character of a piece
        begin, end, symbol = begin[keep], end[keep], symbol[keep]
        # characters that are no piece themselves
        alone = np.ones(len(code), bool)
        alone[begin[end - begin == 1]] = False
        alone &= offset < np.repeat(size, size + 1)
        lone = np.flatnonzero(alone)
        none = self.size + len(self.symbols)  # a character of no piece never merges
        begin, end = np.concatenate([begin, lone]), np.concatenate([end, lone + 1])
        symbol = np.concatenate([symbol, np.array([self.symbols.get(chr(c), none) for c in code[lone].tolist()], np.int64)])
        order = np.argsort(offset[begin], kind="stable")
        begin, end, symbol = begin[order], end[order], symbol[order]
        last, back = np.full(len(code) + 1, -1, np.int64), np.zeros(len(code) + 1, np.int64)
        cuts = np.flatnonzero(np.diff(offset[begin], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(begin)]):
            s, e, t = begin[a:b], end[a:b], symbol[a:b]
            if offset[s[0]] > 0:
                ok = self._apart(last[s], t)
                s, e, t = s[ok], e[ok], t[ok]
            last[e], back[e] = t, s
        # walk all words back from their ends at once
        at, which, step = start + size, np.arange(len(words)), 0
        tokens, owners, steps, places = [], [], [], []
        while True:
            go = at > start[which]
            at, which = at[go], which[go]
            if not len(at):
                break
            tokens.append(last[at])
            owners.append(which)
            steps.append(np.full(len(at), -step))
            places.append(back[at])
            at = back[at]
            step += 1
        if not tokens:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        tokens, owners, steps, places = map(np.concatenate, (tokens, owners, steps, places))
        order = np.lexsort((steps, owners))
        tokens, owners, places = tokens[order], owners[order], places[order]
        count = np.bincount(owners, minlength=len(words))
        odd = np.unique(np.concatenate([owners[tokens >= self.size], np.flatnonzero([w[:2] == MARK * 2 for w in words])]))
        if not len(odd):
            return tokens, count
        start = np.cumsum(count) - count
        out, done = [], 0
        for w in odd.tolist():
            lo, hi = int(start[w]), int(start[w] + count[w])
            out += [tokens[done:lo], self._finish(tokens[lo:hi].tolist(), [chr(code[p]) for p in places[lo:hi].tolist()])]
            count[w], done = len(out[-1]), hi
        return np.concatenate([*out, tokens[done:]]), count

    def _finish(self, symbols: list[int], chars: list[str]) -> np.ndarray:
        """Join the leading run of marks, turn characters without a piece into byte pieces."""
        run = 0
        while run < len(symbols) and symbols[run] == self.id_of.get(MARK):
            run += 1
        out: list[int] = []
        sizes: list[int] = []
        for _ in range(run):
            n = 1
            while sizes and sizes[-1] + n in self.marks and sizes[-1] + n > 1:
                n += sizes.pop()
            sizes.append(n)
        out = [self.marks[n] for n in sizes]
        for t, ch in zip(symbols[run:], chars[run:]):
            out += [t] if t < self.size else self.byte_ids[np.frombuffer(ch.encode("utf-8", "surrogatepass"), np.uint8)].tolist()
        return np.array(out, np.int64)

    def _cut(self, text: str) -> list[str]:
        """Keys of the words of a text: a word without its single mark, or as it is after a longer run of marks."""
        parts = text.replace(" ", MARK).split(MARK) if text else []
        if "" not in parts:
            return parts
        words, run = [], 0
        for p in parts:
            run += 1
            if p:
                words.append(p if run == 1 else MARK * run + p)
                run = 0
        return words + ([MARK * run] if run else [])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text), equal to the library's ``encode``."""
        if self.chars > CACHE_CHARS:
            self._forget()
        ask = self.seen.__getitem__
        numbers = [np.fromiter(map(ask, w), np.int64, len(w)) for w in map(self._cut, texts)]
        known = len(self.count)
        if len(self.seen) > known:
            new = [w if w[0] == MARK else MARK + w for w in islice(self.seen, known, None)]
            self.chars += sum(map(len, new)) + len(new)
            parts = [self._words(new[lo:hi]) for lo, hi in slices(new, BLOCK_CHARS)]
            self.flat = np.concatenate([self.flat, *(f.astype(np.int32) for f, _ in parts)])
            self.count = np.concatenate([self.count, *(c.astype(np.int32) for _, c in parts)])
        start = np.cumsum(self.count, dtype=np.int64) - self.count
        out, sizes = [], np.zeros(len(texts), np.int64)
        for k, n in enumerate(numbers):
            size = self.count[n].astype(np.int64)
            sizes[k] = size.sum()
            out.append(self.flat[np.repeat(start[n] - (np.cumsum(size) - size), size) + np.arange(sizes[k])])
        return (np.concatenate(out) if out else np.empty(0, np.int32)), sizes

    def decode(self, ids: np.ndarray) -> str:
        size = self.raw_size[ids]
        at = np.repeat(self.raw_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        text = self.raw[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> PieceCodec:
    if path not in _STATE:
        _STATE[path] = PieceCodec(tokenizer_file(path))
    return _STATE[path]


def _encode_batches(batches: Iterator[pd.Series], model: str) -> Iterator[pd.DataFrame]:
    """Results of the texts of ``batches`` in order, in frames of ``SLICE_CHARS`` characters."""
    c = codec(model)
    for texts in batches:
        values = [t or "" for t in texts]
        texts = None
        for lo, hi in slices(values, SLICE_CHARS):
            flat, sizes = c.encode(values[lo:hi])
            flat32 = flat.astype("<i4")
            ends = np.cumsum(sizes)
            rows = [(flat32[a:b], b - a, zlib.crc32(flat32[a:b]), c.decode(flat[a:b]) == t)
                    for t, a, b in zip(values[lo:hi], (ends - sizes).tolist(), ends.tolist())]
            yield pd.DataFrame(rows, columns=["ids", "n_tokens", "ids_crc32", "round_trip"])
            rows = flat = flat32 = None
            give_back()
    c._forget()  # idle workers keep no words
    give_back()


def encode(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids``, ``n_tokens``, ``ids_crc32`` (of little-endian 32-bit ids) and ``round_trip``.

    ``round_trip`` tells whether decoding the ids gives the text back (U+2581 in a text decodes to a space).
    """
    prepare(df.sparkSession)

    @F.pandas_udf("ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _encode_batches(batches, model)

    tmp = free_name(df, "__enc")
    names = ("ids", "n_tokens", "ids_crc32", "round_trip")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.withColumn(tmp, run(F.col(text_col))).select(*kept, *[F.col(tmp)[n].alias(n) for n in names])


def decode(df: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` decoded from ``ids_col``; NULL ids give the empty text."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.decode(np.asarray([] if x is None else x, np.int64)) for x in ids])

    return df.withColumn(text_col, run(F.col(ids_col)))
