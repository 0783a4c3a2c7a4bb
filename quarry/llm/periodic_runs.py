"""Periodic runs of words by recompression.

A task numbers the words of a slice of texts and compresses the numbers into a run-length grammar by rounds:
block compression replaces every maximal repeat ``a a .. a`` by a symbol (a, k), pair compression splits the
alphabet into a left and a right half and replaces every pair left-right by a symbol. Equal stretches are cut
alike, so the longest common extension of two places is found on the grammar by climbing while both places
begin a symbol of the next level and descending at the first difference (``Grammar.extend``): a number of
steps that grows with the levels, not with the extension, and without suffix arrays.

A run of period q that is at least ``exponent`` periods long holds a place i and its successor i + q for some
multiple i of (exponent - 1) * q. These harmonic-grid candidates, about n log n / (exponent - 1) of them, are
kept where the two words agree; their exact extensions to both sides give all runs. The smallest period
of a stretch is the smallest one that gives its bounds.

Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. Defined results: NULL, empty and blank texts have no words
and no runs. Every row gives one row, whatever its other columns hold (NULL ids, repeated rows); an empty
table gives an empty table. Extra columns stay unless they are named like a result (in any case); then the
result takes their place. Memory grows with ``SLICE_WORDS`` or the longest text, if that has more words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import free_name, prepare

#: Words compressed at once, and grid candidates looked at at once.
SLICE_WORDS, GRID = 400_000, 500_000

RUN = "struct<start long, length long, period long>"


class Grammar:
    """A run-length grammar of texts of word numbers (``texts``: arrays of numbers below ``words``).

    ``level[h]`` is the sequence of symbols after ``h`` rounds over all texts, separated by negative numbers
    that differ from each other. ``above[h][x]`` is the place in level h + 1 that covers place x of level h,
    ``begin[h][y]`` the first place below place y of level h + 1; both have one entry more for the end.
    ``rules`` lists per round ("block", symbols, bases, counts) or ("pair", symbols, lefts, rights).
    """

    def __init__(self, texts: list[np.ndarray], words: int):
        self.words = words
        size = np.array([len(t) for t in texts], np.int64)
        #: Place of the first word of each text in level 0.
        self.start = np.cumsum(size + 1) - size
        flat = np.full(int(size.sum()) + len(texts) + 1, 0, np.int64)
        gaps = np.concatenate([[0], self.start + size])
        flat[gaps] = -1 - np.arange(len(gaps))
        for a, t in zip(self.start.tolist(), texts):
            flat[a:a + len(t)] = t
        self.level, self.above, self.begin, self.kind = [flat], [], [], []
        self.rules: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
        self._next = words
        turn = 0
        while True:
            self._blocks()
            row = self.level[-1]
            if not ((row[1:] >= 0) & (row[:-1] >= 0)).any():
                break
            self._pairs(turn)
            turn += 1

    def _push(self, kind: str, first: np.ndarray, row: np.ndarray) -> None:
        n = len(self.level[-1])
        mark = np.zeros(n + 1, np.int32)
        mark[first] = 1
        above = np.cumsum(mark, dtype=np.int32) - 1
        above[n] = len(first)
        self.kind.append(kind)
        self.above.append(above)
        self.begin.append(np.append(first, n).astype(np.int32))
        self.level.append(row)

    def _name(self, kind: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """New symbols for the pairs (left, right), equal ones alike."""
        wide = int(right.max()) + 1
        keys, back = np.unique(left * wide + right, return_inverse=True)
        names = self._next + np.arange(len(keys))
        self._next += len(keys)
        self.rules.append((kind, names, keys // wide, keys % wide))
        return names[back]

    def _blocks(self) -> None:
        row = self.level[-1]
        fresh = np.ones(len(row), bool)
        np.not_equal(row[1:], row[:-1], out=fresh[1:])
        if fresh.all():
            return
        first = np.flatnonzero(fresh)
        count = np.diff(first, append=len(row))
        new = row[first]
        many = count > 1
        new[many] = self._name("block", new[many], count[many])
        self._push("block", first, new)

    def _pairs(self, turn: int) -> None:
        """Replace the pairs left-right; neighbours differ after block compression."""
        row = self.level[-1]
        h = row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn * 0xD1342543DE82EF95 + 1) % 2**64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        right = h >= np.uint64(2**63)
        both = (row[1:] >= 0) & (row[:-1] >= 0)
        one, two = both & ~right[:-1] & right[1:], both & right[:-1] & ~right[1:]
        joined = np.flatnonzero(one if np.count_nonzero(one) >= np.count_nonzero(two) else two)
        if not len(joined):  # another split next time
            return
        keep = np.ones(len(row), bool)
        keep[joined + 1] = False
        new = row.copy()
        new[joined] = self._name("pair", row[joined], row[joined + 1])
        self._push("pair", np.flatnonzero(keep), new[keep])

    def expand(self) -> list[list[int]]:
        """The texts, from the last level's symbols and the rules alone."""
        rule = {}
        for kind, names, a, b in self.rules:
            for s, x, y in zip(names.tolist(), a.tolist(), b.tolist()):
                rule[s] = [x] * y if kind == "block" else [x, y]
        out: list[list[int]] = []
        for s in self.level[-1].tolist():
            if s < 0:
                out.append([])
                continue
            stack = [s]
            while stack:
                t = stack.pop()
                if t < self.words:
                    out[-1].append(t)
                else:
                    stack.extend(reversed(rule[t]))
        return out[:-1]

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from places i and j of level 0 on (``back``: ahead of them), i < j within one text."""
        side = -1 if back else 0  # the symbol looked at lies at place + side
        x, y = i.astype(np.int64), j.astype(np.int64)
        stop = np.full(len(x), len(self.kind), np.int64)  # level at which the first difference was seen
        open_ = np.arange(len(x))
        for h in range(len(self.kind)):
            row, above, begin = self.level[h], self.above[h], self.begin[h]
            a, b = x[open_], y[open_]
            same = row[a + side] == row[b + side]
            stop[open_[~same]] = h
            open_, a, b = open_[same], a[same], b[same]
            if not len(open_):
                break
            inner = (begin[above[a]] != a) | (begin[above[b]] != b)  # one of them is inside a symbol of the next level
            ends = self._step(h, a[inner], b[inner], back)
            a[inner], b[inner] = ends[0], ends[1]
            differ = np.zeros(len(a), bool)
            differ[inner] = ends[2]
            x[open_], y[open_] = np.where(differ, a, above[a]), np.where(differ, b, above[b])
            stop[open_[differ]] = h
            open_ = open_[~differ]
        for h in range(int(stop.max(initial=0)) - 1, -1, -1):
            down = np.flatnonzero(stop > h)
            a, b = self.begin[h][x[down]].astype(np.int64), self.begin[h][y[down]].astype(np.int64)
            same = np.flatnonzero(self.level[h][a + side] == self.level[h][b + side])
            a[same], b[same], _ = self._step(h, a[same], b[same], back)
            x[down], y[down] = a, b
        return i - x if back else x - i

    def _step(self, h: int, a: np.ndarray, b: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Go past the equal symbols at a and b (a pair's one, or what both blocks share): places, and whether the blocks end apart."""
        if self.kind[h] == "pair":
            way = -1 if back else 1
            return a + way, b + way, np.zeros(len(a), bool)
        above, begin = self.above[h], self.begin[h]
        left_a, left_b = (a - begin[above[a - 1]], b - begin[above[b - 1]]) if back else (begin[above[a] + 1] - a, begin[above[b] + 1] - b)
        n = np.minimum(left_a, left_b)
        return (a - n, b - n, left_a != left_b) if back else (a + n, b + n, left_a != left_b)


def _grid(size: np.ndarray, start: np.ndarray, least: int, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the harmonic grid over texts of falling size, in parts of about ``GRID`` candidates."""
    top = int(size[0]) // exponent if len(size) and size[0] >= least else 0
    q = np.arange(1, top + 1)
    # texts are sorted by size: only those long enough for a run of period q are looked at
    fit = np.searchsorted(-size, -np.maximum(least, exponent * q), side="right")
    end = (start + size)[np.maximum(fit, 1) - 1]
    count = -(-(end - q) // ((exponent - 1) * q))
    total = np.cumsum(count)
    lo = 0
    while lo < top:
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + GRID, side="right")))
        n, p = count[lo:hi], q[lo:hi]
        if hi == lo + 1 and n[0] > GRID:  # one period over many words
            for k in range(0, int(n[0]), GRID):
                at = np.arange(k, min(k + GRID, int(n[0]))) * ((exponent - 1) * p[0])
                yield at, np.full(len(at), p[0])
        else:
            period = np.repeat(p, n)
            nth = np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)
            yield nth * ((exponent - 1) * period), period
        lo = hi


def find_runs(texts: list[np.ndarray], words: int, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= least]
    if not len(order):
        return none
    grammar = Grammar([texts[k] for k in order.tolist()], words)
    row, start, size = grammar.level[0], grammar.start, size[order]
    owner = np.repeat(np.arange(len(order) + 1), np.concatenate([[1], size + 1]))  # by place; separators end their text
    found = []
    for at, period in _grid(size, start, least, exponent):
        hit = row[at] == row[at + period]
        at, period = at[hit], period[hit]
        hit = owner[at] == owner[at + period]
        at, period = at[hit], period[hit]
        if not len(at):
            continue
        ahead, behind = grammar.extend(at, at + period), grammar.extend(at, at + period, back=True)
        length = ahead + behind + period
        good = length >= np.maximum(least, exponent * period)
        found.append(np.stack([owner[at[good]] - 1, (at - behind)[good], length[good], period[good]]))
    if not found:
        return none
    text, begin, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, length, begin))
    text, begin, length, period = text[by], begin[by], length[by], period[by]
    new = np.ones(len(by), bool)  # the smallest period of each stretch
    new[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])
    text, begin, length, period = text[new], begin[new], length[new], period[new]
    begin = begin - start[text]
    text = order[text]
    by = np.lexsort((period, begin, text))
    return text[by], begin[by], length[by], period[by]


def _stronger(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Sorts runs by falling exact length / period, then start, then period."""
    more = b[1] * a[2] - a[1] * b[2]
    return more or a[0] - b[0] or a[2] - b[2]


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def _numbered(texts: list[list[bytes]]) -> tuple[list[np.ndarray], int]:
    number: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            number.setdefault(w, len(number))
    return [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts], len(number)


def _part(texts: list[list[bytes]], least: int, exponent: int) -> list[tuple]:
    rows = [(len(words), [], None, b" ".join(words).decode()) for words in texts]
    ids, n = _numbered(texts)
    text, start, length, period = find_runs(ids, n, least, exponent)
    cuts = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(text)]):
        k = int(text[a])
        runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()))
        rows[k] = (len(texts[k]), runs, min(runs, key=cmp_to_key(_stronger)), b" ".join(_collapse(texts[k], runs)).decode())
    return rows


def add_runs(df: DataFrame, text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``df`` with the runs of its texts that have at least ``least`` words and ``exponent`` (2 or more) periods.

    ``n_words``; ``runs``: array of (start, length, period) by start and period; ``strongest``: the run of the
    greatest length / period (then the first, then the shortest period; NULL without runs); ``collapsed``: the
    words that stay when each run is cut to its first period, joined by single spaces.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    prepare(df.sparkSession)

    @F.pandas_udf(f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        part: list[list[bytes]] = []
        held = 0
        for t in texts:
            words = (t or "").encode().split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
            if held + len(words) > SLICE_WORDS and part:
                rows += _part(part, least, exponent)
                part, held = [], 0
            part.append(words)
            held += len(words)
        rows += _part(part, least, exponent)
        runs = [None if r is None else dict(zip(("start", "length", "period"), r)) for _, _, r, _ in rows]
        return pd.DataFrame({"n_words": [r[0] for r in rows],
                             "runs": [[dict(zip(("start", "length", "period"), x)) for x in r[1]] for r in rows],
                             "strongest": pd.Series(runs, dtype=object), "collapsed": [r[3] for r in rows]})

    tmp = free_name(df, "__runs")
    names = ("n_words", "runs", "strongest", "collapsed")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.withColumn(tmp, run(F.col(f"`{text_col}`"))).select(*kept, *[F.col(tmp)[n].alias(n) for n in names])
