import random

import numpy as np
import pytest

from quarry.llm import quality_gam as G


def test_tables_learn_main_effects_and_pairs():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 4))
    y = ((np.abs(x[:, 0]) < 1) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)  # needs the pair (1, 2)
    m = G.fit(x[:3000], y[:3000])
    plain = G.fit(x[:3000], y[:3000], pairs=0)
    right = lambda m: ((m.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert (2, 1) in m.pairs and right(m) > right(plain) and right(m) > 0.8
    total = m.base + sum(t[np.searchsorted(c, x[:, f], side="right")] for f, (c, t) in enumerate(zip(m.cuts, m.tables)))
    for (a, b), (ca, cb, t) in m.pairs.items():
        total = total + np.array([t[(ca <= u).sum(), (cb <= v).sum()] for u, v in zip(x[:, a], x[:, b])])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark, docs_df):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(2, 9)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(r.randrange(30, 200))]
        bad = r.random() < 0.3
        if bad:
            w = [[x.upper() + "!!" for x in w], [x + "%%%" for x in w], [w[0]] * len(w)][i % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, "clash"))
    rows += [(None, "x"), (1000, None), (1001, ""), (5, rows[5][1])]
    lab = spark.createDataFrame(labels + [(None, 1, ""), (2000, 1, ""), (3, None, "")], "doc_id long, quality int, text string")
    m = G.train(docs_df(rows), lab.where("doc_id is null or doc_id % 5 <> 0"))
    got = {(x.doc_id, x.text): x.score for x in G.score(docs_df(rows), m).collect()}
    assert len(got) == len(rows) - 1 and all(0 <= s <= 1 for s in got.values())
    held = [(got[rows[i][0], rows[i][1]] >= 0.3) == (y == 1) for i, y, _ in labels if i % 5 == 0]
    assert np.mean(held) > 0.97
    assert G.score(docs_df(rows).limit(0), m).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(i, 1) for i in range(20)]])
def test_without_both_labels(spark, docs_df, labels):
    docs = docs_df([(i, f"text {i}") for i in range(20)])
    m = G.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(x.score == pytest.approx((len(labels) + 1) / (len(labels) + 2)) for x in G.score(docs, m).collect())


def test_scores_are_sums_of_table_entries_on_real_texts(spark, docs_df):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randrange(2, 9)))
    rows = [(i, " ".join(word() + ("!" if i % 3 == 0 else "") for _ in range(r.randrange(1, 120)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "w" * 200_000), (303, "word " * 40_000)]
    m = G.train(docs_df(rows), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)], "doc_id long, quality int"), rounds=20, pair_rounds=10)
    x = G.features([t for _, t in rows])
    df = docs_df(rows).withColumnRenamed("n_words", "Score")
    got = {g.doc_id: g.score for g in G.score(df, m).collect()}
    for (i, _), v in zip(rows, x.tolist()):
        total = m.base
        for f, (cuts, table) in enumerate(zip(m.cuts, m.tables)):
            total += table[sum(c <= v[f] for c in cuts)]
        for (a, b), (ca, cb, table) in m.pairs.items():
            total += table[sum(c <= v[a] for c in ca), sum(c <= v[b] for c in cb)]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_repeated_ids_give_one_model(spark, docs_df):
    r = random.Random(3)
    rows = [(i % 60, " ".join(r.choice(["good", "bad", "x", "yy"]) for _ in range(r.randrange(5, 90)))) for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [G.train(docs_df(x).repartition(n), labels, rounds=10, pair_rounds=5) for x, n in ((rows, 1), (rows[::-1], 5))]
    x = G.features([t for _, t in rows])
    assert np.array_equal(models[0].score(x), models[1].score(x))
