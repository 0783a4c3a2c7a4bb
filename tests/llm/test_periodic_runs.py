"""Runs, grammar and collapsing against brute force."""

import numpy as np
import pytest

from quarry.llm import periodic_runs
from quarry.llm.periodic_runs import Grammar, add_runs, find_runs


def brute(t, least=6, exponent=4):
    """Every stretch that keeps period q and cannot be longer, with its smallest q."""
    n, out = len(t), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and t[j] == t[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def random_texts(rng):
    texts = []
    for _ in range(rng.integers(0, 10)):
        n, letters = rng.choice([0, 1, 5, 6, 7, 30, 100, 400]), rng.choice([1, 2, 3, 8])
        t = rng.integers(0, letters, n)
        if n > 20 and rng.random() < 0.6:
            a, p = rng.integers(0, n), rng.integers(1, n // 4)
            t = np.array([t[i] if i < a else t[a + (i - a) % p] for i in range(n)])
        texts.append(t.astype(np.int64))
    return texts


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("grid", [7, 500_000])
def test_runs_equal_brute_force(monkeypatch, seed, grid):
    monkeypatch.setattr(periodic_runs, "GRID", grid)
    texts = random_texts(np.random.default_rng(seed))
    for least, exponent in ((6, 4), (2, 2), (6, 3)):
        got = list(zip(*[x.tolist() for x in find_runs(texts, 8, least, exponent)]))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t.tolist(), least, exponent)]


@pytest.mark.parametrize("seed", range(10))
def test_grammar_expands_to_the_texts_and_answers_extensions(seed):
    rng = np.random.default_rng(100 + seed)
    texts = random_texts(rng)
    g = Grammar(texts, 8)
    assert g.expand() == [t.tolist() for t in texts]
    for a, t in zip(g.start.tolist(), texts):
        if len(t) < 2:
            continue
        i, j = np.sort(rng.integers(0, len(t), (2, 50)), axis=0)
        i, j = i[i < j], j[i < j]
        ahead = [next((k for k in range(len(t) - y) if t[x + k] != t[y + k]), len(t) - y) for x, y in zip(i, j)]
        behind = [next((k for k in range(x) if t[x - 1 - k] != t[y - 1 - k]), x) for x, y in zip(i, j)]
        assert g.extend(i + a, j + a).tolist() == ahead
        assert g.extend(i + a, j + a, back=True).tolist() == behind


def test_levels_grow_with_the_logarithm():
    t = np.random.default_rng(0).integers(0, 50, 20_000)
    assert len(Grammar([t], 50).level) < 120
    assert sum(map(len, Grammar([t], 50).level)) < 10 * len(t)


def expected(text, least=6, exponent=4):
    words = (text or "").encode().split()
    runs = brute(words, least, exponent)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return len(words), runs, best, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_rows_and_odd_inputs(spark, monkeypatch):
    texts = [None, "", " \t\n ", "a", "a " * 6, "a " * 5, "x " + "a b " * 4 + "y", "é é " * 9, "p q r " * 4000 + "end",
             "a a a a a a b b b b b b", "a b " * 4 + "a " * 6, "w" * 300_000 + " z" * 7]
    rows = [(None if i == 3 else i % 9, t, "x", "y", 1) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string, n_words string, extra int").coalesce(1)
    got = add_runs(df)
    assert got.columns == ["doc_id", "text", "extra", "n_words", "runs", "strongest", "collapsed"]
    found = [(r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in got.collect()]
    assert found == [(i, t, *expected(t)) for i, t, *_ in rows]
    assert add_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        add_runs(df, exponent=1)


def test_slices_do_not_matter(spark, monkeypatch):
    from quarry.llm.periodic_runs import _part

    texts = [("a b " * k + "c").encode().split() for k in range(40)]
    whole = _part(texts, 6, 4)
    assert whole == [r for k in range(0, 40, 7) for r in _part(texts[k:k + 7], 6, 4)]
