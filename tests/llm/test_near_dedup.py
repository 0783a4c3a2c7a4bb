import random
import re

import numpy as np
import pytest

from quarry.llm import near_dedup as N
from quarry.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(t, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
    n = min(k, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i]:
                continue
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n, edits):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + r.choice("qrstuv") + r.choice("wxyz")
    bases = [[word() for _ in range(r.randrange(1, 120))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = word()
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w) if i % 9 else " ".join(w).upper()))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one two"), (1005, "ONE two"), (None, rows[0][1]), (7, rows[3][1]),
                   (8, rows[8][1]), (1006, "É x y z"), (1007, "é x y z"), (1008, "v " * 20_000), (1009, "long" * 5000)]


@pytest.mark.parametrize("seed,edits,percent", [(1, 8, 85), (2, 16, 80)])
def test_components_against_brute_force(spark, docs_df, seed, edits, percent):
    rows = corpus(seed, 150, edits)
    got = sorted((tuple(r) for r in N.near_duplicates(docs_df(rows), 3, percent).collect()), key=str)
    assert got == brute(rows, 3, percent)


def test_keep_one_and_empty_table(spark, docs_df):
    rows = corpus(3, 60, 6)
    df = docs_df(rows)
    kept = N.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({d for d, _, c in brute(rows, 5, 80) if d == c}, key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_shingle_sets_match_words():
    texts = ["", None, "a", "A b", "a b c d a b c d", "x\ty\nz  w", "é" * 9000 + " b c", "q " * 50]
    for t, s in zip(texts, shingle_sets(texts, 3)):
        assert len(s) == len(grams(t, 3))
    a, b = shingle_sets(["p q r s", "zz P q R s"], 3)
    assert len(np.intersect1d(a, b)) == 2


def test_registers_merge_and_estimate():
    r = np.random.default_rng(1)
    x = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    a, b = x[:4000], x[1000:]
    ra, rb, rx = N.registers([a, b, x], 512)
    assert (np.maximum(ra, rb) == rx).all()
    est = N.joint_similarity(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(est - 3000 / 5000) < 0.1
    small = N.registers([a[:70_000]], 8)
    assert (small == N.registers([a], 8)).all()


def test_keep_one_tells_rows_of_one_id_apart(spark, docs_df):
    r = random.Random(21)
    a, b, c = (" ".join(str(r.randrange(10**6)) for _ in range(40)) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (8, b), (9, c), (9, a + " end"), (9, c), (10, ""), (10, b)]
    kept = sorted((x.doc_id, x.text) for x in N.keep_one(docs_df(rows), 5, 80).collect())
    assert kept == sorted([(3, a), (7, b), (9, c), (10, "")])
