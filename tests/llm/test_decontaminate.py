import hashlib
import random
import re

import pytest

from quarry.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def brute(docs, items, window):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            grams = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def sample(seed, n_docs=60, n_items=25, letters="abc"):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(letters) + r.choice(["", ",", "!"]) for _ in range(n))
    items = [(k, text(r.randrange(0, 14))) for k in range(n_items)] + [(3, None), (None, "q r s"), (7, "É é x"), (8, "")]
    docs = [(k, text(r.randrange(0, 60))) for k in range(n_docs)] + [(900, None), (901, ""), (902, "É É x Q r S"), (903, "z " * 3000)]
    for k in range(0, n_docs, 3):
        i = r.randrange(n_items)
        docs[k] = (k, docs[k][1] + " " + (items[i][1] or "") + " z z")
    return docs, items


@pytest.mark.parametrize("seed,window,block", [(1, 4, 200_000), (2, 10, 200_000), (3, 4, 30), (4, 3, 8)])
def test_against_brute_force(spark, docs_df, monkeypatch, seed, window, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = sample(seed, letters="abcde" if seed % 2 else "abcdefghij")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in D.report(docs_df(docs), bench, window).collect())
    assert got == sorted(brute(docs, items, window))


def test_removed_spans_leave_no_window(spark, docs_df):
    docs, items = sample(5, letters="abcdefgh")
    items = [(i, t) for i, t in items if len(words(t)) >= 6]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cleaned = D.remove_spans(docs_df(docs), bench, 5)
    assert cleaned.columns == docs_df(docs).columns
    rows = {r.doc_id: r.text for r in cleaned.collect()}
    assert not any(x[5] for x in brute(list(rows.items()), items, 5))
    clean = {x[0] for x in brute(docs, items, 5) if not x[5]}
    assert all(rows[i] == dict(docs)[i] for i in clean)


def test_empty_tables(spark, docs_df):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = D.report(docs_df([(1, "a b"), (1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)] * 2
    assert D.report(docs_df([(1, "a")]).limit(0), none).count() == 0
