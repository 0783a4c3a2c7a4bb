import random
import re
import unicodedata

from pyspark.sql import functions as F

from quarry.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    n, chars, symbols = len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>")
    dup, upper = len(lines) - len(set(lines)), sum(unicodedata.category(c) == "Lu" for c in t)
    bad = [n < 50, 100 * len(again) > 50 * n, 10 * symbols > n, 100 * dup > 60 * len(lines), 100 * upper > 40 * chars, chars < 2 * n, chars > 20 * n]
    return n, chars, symbols, dup, len(lines), len(again), upper, sum(b << i for i, b in enumerate(bad))


def corpus():
    r = random.Random(1)
    rows = [(i, r.choice(["", " ", "\n"]).join(
        r.choice(["a", "b", "the", "É", "x%%", "UP", "wörd"]) + r.choice([" ", "\n", "  ", "\t", "\x0b", "\x0c\r"]) for _ in range(r.randrange(90)))) for i in range(150)]
    return rows + [(None, "a b c a b c"), (7, rows[7][1]), (500, None), (501, ""), (502, " \n\t"), (503, "a b c " * 400), (504, "x" * 40_000 + " y"), (505, "a\xa0b c\x85d"),
                   (506, "l\nl\nl\nm"), (507, " ".join(f"w{i}" for i in range(9000)) + " w1 w2 w3")]


def test_ledger_against_brute_force(spark, docs_df):
    rows = corpus()
    got = Q.ledger(docs_df(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert Q.ledger(docs_df(rows).limit(0)).count() == 0


def test_policies_and_ablation(spark, docs_df):
    rows = corpus()
    led = Q.ledger(docs_df(rows))
    bits = [brute(t)[-1] for _, t in rows]
    mask = Q.DEFAULT.mask(Q.RULES)
    assert led.where(Q.passes(Q.BASE)).count() == sum(b & 3 == 0 for b in bits)
    for r in Q.ablation(led, Q.DEFAULT).collect():
        bit = 1 << next(x.bit for x in Q.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (
            sum(b & bit > 0 for b in bits), sum(b & mask == bit for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_keep_good_is_native_and_keeps_columns(spark, docs_df):
    df = docs_df(corpus()).withColumn("__text", F.lit("clash"))
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(brute(t)[-1] == 0 for _, t in corpus())
    plan = kept._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    # the measurements are made once: no filter took a copy of them below
    assert kept._jdf.queryExecution().executedPlan().toString().count("xxhash64(") == 1
