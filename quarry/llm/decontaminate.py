"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items are built into one automaton per block of items; documents stream
through it word by word while the longest match ending at the current word is tracked. A match of at least
``window`` words marks its words and the items that contain the last ``window`` words; an item of fewer words
is one window of its own length.

Items are cut into blocks of at most ``BLOCK_WORDS`` words (an item longer than that is cut into pieces that
overlap by ``window - 1`` words, so no window is lost). Each block is one automaton of bounded size; documents
are passed over once per block and only rows with a hit are shuffled when there is more than one block.

Defined results: NULL or wordless texts have no words and no hits; a NULL or wordless item has no window; an
item with a NULL id marks words but is not listed. Repeated document rows each get a row; repeated item ids
count once. Extra columns of either side are kept by :func:`remove_spans` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import free_name, prepare

#: Words of one automaton (about 0.3 kB each as Python objects on driver and worker).
BLOCK_WORDS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` words after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    ``step[v]`` maps a word number to the next state; ``length`` and ``link`` are the usual longest length and
    suffix link. ``items_of[v]`` lists, for the state that holds a ``window``-word string, the items that
    contain it; ``short[v]`` the short items whose whole text is the longest string of the state.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], whole) for i, words, whole in items]
        for _, word, _ in coded:
            last = 0
            for c in word:
                last = self._extend(last, c)
        self.items_of: dict[int, set[str | None]] = {}
        self.short: dict[int, set[str | None]] = {}
        for item, word, whole in coded:
            if len(word) < window and whole:
                v = 0
                for c in word:
                    v = self.step[v][c]
                self.short.setdefault(v, set()).add(item)
            else:
                for v, size in self.walk(word):
                    if size >= window:
                        self.items_of.setdefault(self.shorten(v, window), set()).add(item)
        # the nearest state on the suffix path (itself included) that is a short item
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.short_at = [-1] * len(self.length)
        for v in order:
            up = self.link[v]
            self.short_at[v] = v if v in self.short else self.short_at[up] if up >= 0 else -1

    def _add(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the strings that end with ``p`` and ``c``."""
        copy = self._add(self.length[p] + 1, dict(self.step[q]), self.link[q])
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.step[last].get(c)
        if q is not None:  # the string is already known from another item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def walk(self, word: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word; unknown words have a negative number."""
        v = size = 0
        step, length, link = self.step, self.length, self.link
        for c in word:
            while v and c not in step[v]:
                v = link[v]
                size = length[v]
            u = step[v].get(c)
            if u is None:
                v = size = 0
            else:
                v, size = u, size + 1
            yield v, size

    def shorten(self, v: int, size: int) -> int:
        """The state on the suffix path of ``v`` that holds its suffix of ``size`` words."""
        while self.length[self.link[v]] >= size:
            v = self.link[v]
        return v

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit word spans [begin, end), sorted and disjoint, and the items with a window in ``words``."""
        spans: list[list[int]] = []
        found: set[str | None] = set()
        window, short_at, short, length = self.window, self.short_at, self.short, self.length
        number = [*map(self.vocabulary.get, words)]
        shortest = min([window if self.items_of else len(words) + 1, *(length[v] for v in short)])
        for begin, end in _runs(number, shortest):
            at = begin
            for v, size in self.walk(number[begin:end]):
                at += 1
                n = 0
                if size >= window:
                    n = size
                    found |= self.items_of[self.shorten(v, window)]
                u = short_at[v]
                while u >= 0 and short:
                    if size >= length[u]:
                        found |= short[u]
                        n = max(n, length[u])
                    u = short_at[self.link[u]] if self.link[u] >= 0 else -1
                if n:
                    low = at - n
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append([low, at])
        return [(a, b) for a, b in spans], found


def _runs(number: list[int | None], least: int) -> Iterator[tuple[int, int]]:
    """Maximal index ranges of at least ``least`` known words."""
    known = np.fromiter((x is not None for x in number), np.int8, len(number))
    edge = np.flatnonzero(np.diff(known, prepend=0, append=0))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            yield a, b


def item_blocks(items: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, list[bytes], bool]]]:
    """Blocks of at most ``BLOCK_WORDS`` words (one row at a time reaches the driver); long items are cut with overlap."""
    block, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(text)
        step = max(BLOCK_WORDS - window + 1, 1)
        pieces = [words] if len(words) <= BLOCK_WORDS else [words[k:k + BLOCK_WORDS] for k in range(0, len(words) - window + 1, step)]
        for piece in pieces:
            if not piece:
                continue
            if size + len(piece) > BLOCK_WORDS and block:
                yield block
                block, size = [], 0
            block.append((item, piece, len(pieces) == 1))
            size += len(piece)
    if block:
        yield block


class _Shared:
    def __init__(self, spark: SparkSession, value):
        import uuid

        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(shared: _Shared) -> SuffixAutomaton:
    """The block's automaton, built once per worker process."""
    if shared.id not in _BUILT:
        if len(_BUILT) >= 4:  # bounded worker memory, however many blocks there are
            _BUILT.clear()
        _BUILT[shared.id] = SuffixAutomaton(*shared.value)
    return _BUILT[shared.id]


HITS = "n_words long, begins array<int>, ends array<int>, items array<string>"


def match(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """``docs`` with a struct column of hits: n_words, hit spans (begins, ends; word numbers), items.

    The struct's name is the last column of the result (free of clashes with ``docs``).
    """
    spark = docs.sparkSession
    prepare(spark)
    out = free_name(docs, "__hits")
    blocks = [_Shared(spark, (b, window)) for b in item_blocks(items, window, item_id, item_text)]
    if not blocks:
        blocks = [_Shared(spark, ([], window))]

    def scan(shared):
        @F.pandas_udf(HITS)
        def hits(texts):
            import pandas as pd

            sam = _automaton(shared)
            rows = []
            for t in texts:
                words = words_of(t)
                spans, found = sam.hits(words)
                rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(x for x in found if x is not None)))
            return pd.DataFrame(rows, columns=["n_words", "begins", "ends", "items"])
        return hits

    res = docs
    each = []
    for k, shared in enumerate(blocks):
        c = free_name(docs, f"__hits{k}")
        res = res.withColumn(c, scan(shared)(F.col(text_col)))
        each.append(c)
    if len(each) == 1:
        return res.withColumnRenamed(each[0], out)
    # several blocks: spans of all automata, merged where they touch
    spans = F.array_sort(F.flatten(F.array(*[F.arrays_zip(F.col(c)["begins"].alias("b"), F.col(c)["ends"].alias("e")) for c in each])))
    merged = F.aggregate(spans, F.array().cast("array<struct<b:int,e:int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= s["b"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["b"].alias("b"), F.greatest(F.element_at(acc, -1)["e"], s["e"]).alias("e")))),
    ).otherwise(F.concat(acc, F.array(F.struct(s["b"].alias("b"), s["e"].alias("e"))))))
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(c)["items"] for c in each]))))
    res = res.withColumn(free_name(docs, "__spans"), merged)
    s = res.columns[-1]
    return res.withColumn(out, F.struct(
        F.col(each[0])["n_words"].alias("n_words"), F.transform(s, lambda x: x["b"]).alias("begins"),
        F.transform(s, lambda x: x["e"]).alias("ends"), found.alias("items"))).drop(*each, s)


def report(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 (sorted ids, comma-joined), contaminated."""
    m = match(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, window, "text", item_id, item_text)
    h = F.col(m.columns[-1])
    n_hit = F.aggregate(F.zip_with(h["ends"], h["begins"], lambda e, b: e - b), F.lit(0), lambda a, x: a + x).cast("long")
    return m.select("doc_id", h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
                    F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` (its columns) with hit words cut out of the text.

    A document whose hit words exceed ``max_coverage`` of its words is dropped. What is left after a cut is
    scanned again until no window remains, since the words around a cut become neighbours. Rows without a hit
    are returned as they are.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = [_Shared(spark, (b, window)) for b in item_blocks(items, window, item_id, item_text)]

    @F.pandas_udf("kept boolean, text string")
    def clean(texts):
        import pandas as pd

        rows = []
        for t in texts:
            total, cut, keep = None, 0, True
            while t is not None:
                again = False
                for shared in blocks:
                    # the automata of several blocks are used in turn
                    words, at = _positions(t)
                    total = len(words) if total is None else total
                    spans, _ = _automaton(shared).hits(words)
                    if spans:
                        raw = t.encode("utf-8", "surrogatepass")
                        cut += sum(b - a for a, b in spans)
                        t = _without(raw, [(at[a][0], at[b - 1][1]) for a, b in spans]).decode("utf-8", "surrogatepass")
                        again = True
                if not again:
                    break
            if total and cut > max_coverage * total:
                keep = False
            rows.append((keep, t))
        return pd.DataFrame(rows, columns=["kept", "text"])

    c = free_name(docs, "__clean")
    # a filter would be copied below the projection, and every text cleaned twice; an explode is not
    res = docs.withColumn(c, F.explode(F.filter(F.array(clean(F.col(text_col))), lambda x: x["kept"])))
    return res.select(*[F.col(c)["text"].alias(x) if x == text_col else F.col(f"`{x}`") for x in docs.columns])


def _positions(text: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words and their byte ranges."""
    flat = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    words, at, k = flat.split(), [], 0
    for w in words:
        k = flat.index(w, k)
        at.append((k, k + len(w)))
        k += len(w)
    return words, at


def _without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    out, k = [], 0
    for a, b in cuts:
        out.append(raw[k:a])
        k = b
    return b"".join([*out, raw[k:]])
