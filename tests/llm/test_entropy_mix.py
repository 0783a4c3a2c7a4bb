"""Targets, dual solution, rounding and the mix against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import entropy_mix
from quarry.llm.entropy_mix import expand, plan, solve, source_targets, word_count


def python_targets(sizes, weights=(5, 2, 1), cap=3):
    """Sources in code point order, NULL last; the excess over the cap is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left, open_ = total - sum(cap * sizes[s] for s in full), [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 300, "é": 70, "Z": 0}, {"x": 7}, {"a": 1, "b": 100}, {None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in source_targets(df).collect()}
    want = python_targets(sizes)
    assert set(got) == set(sizes)
    for s, (size, target) in got.items():
        assert size == sizes[s] and target == pytest.approx(want[s])


def test_dual_solution_equals_bisection(spark):
    rng = random.Random(3)
    cells = [(sid, size, rng.randint(1, 9)) for sid in range(6) for size in rng.sample(range(1, 20_000), 60)]
    total = Counter()
    for sid, size, n in cells:
        total[sid] += size * n
    share = [0.01, 0.4, 1.0, 1.7, 2.99, 3.0]
    df = spark.createDataFrame(cells, "sid long, size long, n long")
    targets = spark.createDataFrame([(s, f * total[s]) for s, f in enumerate(share)], "sid long, target double")
    got = {r.sid: r for r in solve(df, targets).collect()}
    for s, f in enumerate(share):
        words = lambda x: sum(n * z * min(3.0, math.exp(min(x * z, 700))) for sid, z, n in cells if sid == s)  # noqa: B023, E731
        if f == 3.0:
            assert got[s].flat == 3.0
            continue
        lo, hi = -2.0, 2.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if words(mid) < f * total[s] else (lo, mid)
        assert got[s].flat is None and got[s].l == pytest.approx(lo, rel=1e-4, abs=1e-12)
        assert words(got[s].l) == pytest.approx(f * total[s], rel=1e-6)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", None])
        words = rng.choice([0, 3, 10, 10, 10, 50, rng.randint(1, 400)])
        rows.append((rng.choice([i, i, i, None, 7]), " ".join("w" * rng.randint(1, 4) for _ in range(words)), "en", source, "clash"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies string")


@pytest.mark.parametrize("bucket", [50_000, 5])
def test_mix_keeps_its_promises(spark, monkeypatch, bucket):
    monkeypatch.setattr(entropy_mix, "BUCKET", bucket)
    rows = corpus()
    got = plan(frame(spark, rows)).collect()
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((i, s, len(t.split())) for i, t, _, s, _ in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size and 0 <= r.rate <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = python_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2
    # copies follow the rates: within one source longer documents get no fewer when it grows, no more when it shrinks
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for s, mine in by.items():
        rate = sorted({(r.size, r.rate) for r in mine if r.size})
        values = [x for _, x in rate]
        assert values == sorted(values, reverse=want[s] < sizes[s])
    again = plan(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_expand_gives_the_copies(spark):
    rows = corpus(200, 2)
    df = frame(spark, rows)
    planned = plan(df)
    out = expand(df, planned)
    assert out.columns == [*df.columns, "copy"]
    want, got = Counter(), Counter()
    for r in planned.collect():
        want[r.id, r.source, r.size] += r.copies
    for r in out.collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
        assert r.copies == "clash"
    assert got == Counter({k: v for k, v in want.items() if v})


def test_odd_inputs(spark):
    rows = [(1, None, "en", "s", ""), (1, None, "en", "s", ""), (None, "", "en", None, ""), (2, "a " * 100_000, "en", "t", ""), (3, " \n ", "en", "t", "")]
    got = {(r.id, r.source): (r.size, r.copies, r.taken) for r in plan(frame(spark, rows)).collect()}
    assert got == {(1, "s"): (0, 1, 0), (None, None): (0, 1, 0), (2, "t"): (100_000, 1, 100_000), (3, "t"): (0, 1, 0)}
    assert plan(frame(spark, rows).limit(0)).collect() == []
    same = [(5, "one two", "en", "s", "")] * 40 + [(6, "x y z " * 30, "en", "r", "")]
    got = plan(frame(spark, same)).collect()
    assert len(got) == 41 and len({r.copies for r in got if r.id == 5}) <= 2


def test_no_python_in_the_plan(spark):
    out = plan(frame(spark, corpus(50)))
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_word_count(spark):
    texts = [None, "", " a\tb\x0bc\x0cd\re\nf ", "x y  z", "\x1ca \x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 6, 2, 2]
