import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import surrogates
from quarry.llm.common import tokenizer_file
from quarry.llm.queries import SURROGATE_KEY
from test_decontaminate import brute as contaminated
from test_near_dedup import brute as components
from test_quality_rules import brute as ledger

MODEL = tokenizer_file("piece_bpe_32k.model")


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvé") for _ in range(r.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randrange(10, 25)))) for i in range(6)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(45, 160))]
        if i % 6 == 1 and rows:
            w = rows[-1][1].split()
            w[r.randrange(len(w))] = word()
        if i % 6 == 2:
            at = r.randrange(len(w))
            w[at:at] = r.choice(items)[1].split()
        if i % 6 == 3:
            w[5] = r.choice(["bob.1@mail.example.com", "10.1.2.3", "4041894974608795", "password=531ccd051a92ebcb68"])
        if i % 12 == 4:
            w = [x + "%%%" for x in w]
        if i % 12 == 10:
            w = w[:5] * 30
        rows.append((i, " ".join(w)))
    return rows + [(900, None), (901, ""), (902, " ".join(items[0][1].split() * 4) + " x" * 3)], items


def test_run_against_brute_force(spark, docs_df, tmp_path):
    import sentencepiece

    rows, items = corpus(1)
    docs_df(rows).drop("n_words").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    good = [(i, t) for i, t in rows if ledger(t)[-1] == 0]
    kept = {d for d, _, c in components(good, 5, 80) if d == c}
    one = [(i, t) for i, t in good if i in kept]
    hits = {x[0]: x for x in contaminated(one, items, 10)}
    heavy = {i for i, x in hits.items() if x[2] > 0.5 * x[1]}
    assert set(got) == {i for i, _ in one} - heavy and len(got) > 40
    assert any(x[5] for i, x in hits.items() if i in got)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in one:
        if i in got:
            x = got[i]
            if not hits[i][5]:
                assert x.text == surrogates.replace_all(SURROGATE_KEY, t, {})[0]
            assert x.n_chars == len(x.text) and list(x.ids) == lib.encode(x.text) and x.round_trip
    assert not any(x[5] for x in contaminated([(i, x.text) for i, x in got.items()], items, 10))
    assert np.mean(["@mail.example.com" in x.text for x in got.values()]) < 0.01


def test_stages_keep_the_columns(spark, docs_df, tmp_path):
    df = docs_df([(1, "one two"), (None, None)]).drop("n_words")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
