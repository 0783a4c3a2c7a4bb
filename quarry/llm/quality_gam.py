"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over quantile bins; some pairs of features have a small table of their
own. Tables are learned by cyclic boosting: in every round each feature in turn receives one shallow tree fitted to
the current residuals on its histogram, with a small step; then the pairs with the largest residual gain are boosted
the same way. Scoring adds one table entry per feature and pair, vectorised over a batch.

Features are computed over whole texts; ids, languages, sources and labels are never features. The model is fitted
on the driver from at most ``max_rows`` labelled rows (the smallest hashes of their ids), a few megabytes; those ids
are broadcast to find their texts, and everything else covers all rows.

Defined results: NULL and empty texts are scored like any other (all counts 0). Labelled ids without a text, NULL
labels and NULL ids are not used; of repeated labels the greatest counts. Without both labels the score is the
share of the known one. Repeated rows and NULL ids are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import prepare
from quarry.llm.shingles import _grams, word_hashes
from quarry.llm.token_orc import slices

FEATURES = ("log_words", "word_bytes", "upper", "symbols", "exclaims", "digits", "stops", "distinct", "next_same", "again3",
            "same_lines", "line_words", "lone", "non_ascii", "entropy")


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, features) matrix; a text without words has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in slices(texts, 2_000_000):
        part = texts[lo:hi]
        hashes, counts = word_hashes(part)
        at = 0
        for k, (t, n) in enumerate(zip(part, counts.tolist()), start=lo):
            h = hashes[at:at + n]
            at += n
            if not n:
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            c = np.bincount(raw, minlength=256)
            gap = c[32] + c[9:14].sum()
            body = max(1, len(raw) - gap)
            upper = c[65:91].sum()
            letters = max(1, upper + c[97:123].sum())
            lines = [x for x in t.split("\n") if x and not x.isspace()]
            g = _grams(h, 3)
            _, times = np.unique(g, return_counts=True)
            p = c[c > 0] / len(raw)
            size = np.array([len(w) for w in t.split()])
            out[k] = (np.log1p(n), body / n, upper / letters, c[[35, 42, 36, 37, 38, 124, 60, 62]].sum() / n, c[33] / n, c[48:58].sum() / n,
                      c[[46, 44, 59, 58, 63]].sum() / n, len(np.unique(h)) / n, (h[1:] == h[:-1]).mean() if n > 1 else 0.0,
                      times[times > 1].sum() / max(1, len(g)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
                      (size == 1).mean() if len(size) else 0.0, c[128:].sum() / body, -(p * np.log2(p)).sum())
    return out


@dataclass
class Model:
    """``cuts[f]`` are the bin borders of feature f, ``tables[f]`` its scores; ``pairs`` maps (f, g) to coarse borders and a table."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            s += table[np.searchsorted(cut, x[:, f], side="right")]
        for (f, g), (a, b, table) in self.pairs.items():
            s += table[np.searchsorted(a, x[:, f], side="right"), np.searchsorted(b, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _borders(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values of a greedy tree over one histogram of gradients and curvatures, one value per bin."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = None
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = cg[m] - cg[a], ch[m] - ch[a], cg[b] - cg[m], ch[b] - ch[m]
            gain = _gain(gl, hl) + _gain(gr, hr) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            k = int(gain.argmax())
            if best is None or gain[k] > best[0]:
                best = (gain[k], i, int(m[k]))
        if best is None or best[0] <= 1e-9:
            break
        _, i, m = best
        a, b = parts[i]
        parts[i:i + 1] = [(a, m), (m, b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts (four leaves) over a two-way histogram."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    quarters = []
    for c, t in ((cg, tg), (ch, th)):
        aa = c[:-1, :-1]
        ab, ba = c[:-1, -1:] - aa, c[-1:, :-1] - aa
        quarters.append((aa, ab, ba, t - aa - ab - ba))
    if not quarters[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(_gain(x, y) for x, y in zip(*quarters)) - _gain(tg, th)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    values = [-x[i, j] / (y[i, j] + 1.0) for x, y in zip(*quarters)]
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = values
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, step: float = 0.1, bins: int = 64, leaves: int = 4, pairs: int = 8,
        pair_bins: int = 12, pair_rounds: int = 60) -> Model:
    """Cyclic boosting of feature tables, then of the ``pairs`` most promising pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) < 10 or y.min() == y.max():
        return model
    s = np.full(len(y), model.base)
    slope = lambda: (lambda p: (p - y, p * (1 - p)))(1 / (1 + np.exp(-s)))
    model.cuts = [_borders(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    where = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    for _ in range(rounds):
        for f, (at, table) in enumerate(zip(where, model.tables)):
            g, h = slope()
            add = step * _tree(np.bincount(at, g, len(table)), np.bincount(at, h, len(table)), leaves)
            table += add
            s += add[at]
    coarse = [_borders(x[:, f], pair_bins) for f in range(x.shape[1])]
    at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]

    def histogram(f, g_, v):
        n, m = len(coarse[f]) + 1, len(coarse[g_]) + 1
        return np.bincount(at[f] * m + at[g_], v, n * m).reshape(n, m)

    g, h = slope()
    gains = sorted(((_quadrants(histogram(a, b, g), histogram(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    for _, a, b in gains[:pairs]:
        model.pairs[a, b] = (coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)))
    for _ in range(pair_rounds):
        for (a, b), (_, _, table) in model.pairs.items():
            g, h = slope()
            add = step * _quadrants(histogram(a, b, g), histogram(a, b, h))[1]
            table += add
            s += add[at[a], at[b]]
    return model


def _text_features(text_col: str):
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())))
    return run(F.col(text_col))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_rows: int = 20_000, **options) -> Model:
    """A model from at most ``max_rows`` labelled rows. An id with several texts counts once, by the smallest of them."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # at most max_rows pairs of numbers
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    one = rows.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    got = one.select("__id", "__y", _text_features("__text").alias("__x")).collect()
    got.sort(key=lambda r: r["__id"])
    x = np.array([r["__x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r["__y"]) for r in got]), **options)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; a column that is named ``out_col`` (in any case) is replaced."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few lookup tables

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(features(texts.tolist())))

    return docs.withColumn(out_col, run(F.col(text_col)))
