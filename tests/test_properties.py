"""Randomised checks of text expressions and keyed upsert / merge against small Python models of their rules.

Each test evaluates a few hundred seeded random cases in one Spark job.
"""

import random

from pyspark.sql import functions as F

from quarry.constants import UNICODE_SPACE_CHARS

SLICE_CAP_CHARS = 61_440
from quarry.functions import text as X
from quarry.operators.chunking import text_lines, with_chunks

ALPHABET = ["a", "b", "Z", " ", " ", "\n", "\r", "\t", "é", "ß", "中", "😀", " ", "　", "-", "."]


def _texts(rng, n, max_len=60):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, max_len))) for _ in range(n)]


def py_slice(text, start, end, cap=SLICE_CAP_CHARS):
    n = len(text)
    s = max(start, 0)
    e = max(max(end, 0), s)
    s, e = min(s, n), min(e, n)
    trunc = e - s > cap
    if trunc:
        e = s + cap
    return text[s:e] + ("<|EOF|>" if e >= n else "") + (". . .truncated" if trunc else ""), trunc


def py_hex(data, start, end, cap=SLICE_CAP_CHARS):
    total = len(data) * 2
    s = max(start, 0)
    e = max(max(end, 0), s)
    s, e = min(s, total), min(e, total)
    trunc = e - s > cap
    if trunc:
        e = s + cap
    seg = data[s // 2:min((e + 1) // 2, len(data))].hex()
    if s % 2 == 1 and seg:
        seg = seg[1:]
    seg = seg[:e - s]
    return seg + ("<|EOF|>" if e >= total else "") + (". . .truncated" if trunc else "")


def py_trim(s):
    return s.strip(UNICODE_SPACE_CHARS)


def py_snippet(data, start, end):
    s, e = max(start, 0), min(end, len(data))
    if s >= len(data) or s >= e:
        return ""
    text = py_trim(data[s:e].decode("utf-8", "replace").replace("\n", " "))
    b = text.encode()
    return b[:512].decode("utf-8", "replace") + "…" if len(b) > 512 else text


def py_lines(text):
    if text == "":
        return []
    parts = text.split("\n")
    if parts[-1] == "":
        parts = parts[:-1]
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def test_slices_match_model(spark):
    rng = random.Random(11)
    cases = [(t, rng.randint(-5, 70), rng.randint(-5, 80)) for t in _texts(rng, 300)]
    df = spark.createDataFrame(cases, "t string, a int, b int")
    rows = df.select("t", "a", "b", X.read_slice("t", "a", "b", SLICE_CAP_CHARS).alias("c"),
                     X.read_slice_hex(F.encode("t", "UTF-8"), "a", "b", SLICE_CAP_CHARS).alias("h")).collect()
    for r in rows:
        assert (r.c.chunk, r.c.truncated) == py_slice(r.t, r.a, r.b), (r.t, r.a, r.b)
        assert r.h.chunk == py_hex(r.t.encode(), r.a, r.b), (r.t, r.a, r.b)


def test_slice_cap_model(spark):
    t = "é" * 70000
    rows = spark.createDataFrame([(t, 5, 69000), (t, -1, 200000)], "t string, a int, b int").select(
        X.read_slice("t", "a", "b", SLICE_CAP_CHARS).alias("c"), X.read_slice_hex(F.encode("t", "UTF-8"), "a", "b", SLICE_CAP_CHARS).alias("h")).collect()
    assert (rows[0].c.chunk, rows[0].c.truncated) == py_slice(t, 5, 69000)
    assert rows[1].h.chunk == py_hex(t.encode(), -1, 200000)


def test_snippets_match_model(spark):
    rng = random.Random(5)
    texts = _texts(rng, 200, 900)
    cases = []
    for t in texts:
        data = t.encode()
        # chunk-like windows start and end on character boundaries, as the chunker produces
        cuts = sorted({0, len(data)} | {len(t[:i].encode()) for i in (rng.randint(0, len(t)), rng.randint(0, len(t)))})
        cases.append((data, cuts[0], cuts[-1]))
        if len(cuts) > 2:
            cases.append((data, cuts[1], cuts[-1] + 3))
    rows = spark.createDataFrame(cases, "d binary, s int, e int").select(
        "d", "s", "e", X.snippet("d", "s", "e", 512).alias("x")).collect()
    for r in rows:
        assert r.x == py_snippet(bytes(r.d), r.s, r.e), (bytes(r.d), r.s, r.e)


def test_lines_and_trim_match_model(spark):
    rng = random.Random(7)
    texts = _texts(rng, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in text_lines(df, "text").collect():
        got.setdefault(r.id, []).append((r.line_number, r.line))
    for i, t in enumerate(texts):
        assert [l for _, l in sorted(got.get(i, []))] == py_lines(t), repr(t)
    trimmed = df.select("id", X.go_trim("text").alias("x")).collect()
    assert all(r.x == py_trim(texts[r.id]) for r in trimmed)


def test_chunks_tile_the_text(spark):
    rng = random.Random(3)
    texts = _texts(rng, 200, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by = {}
    for r in with_chunks(df, "text", 5).collect():
        by.setdefault(r.id, []).append(r)
    for i, t in enumerate(texts):
        rs = sorted(by.get(i, []), key=lambda r: r.chunk_index)
        assert "".join(r.chunk_text for r in rs) == t
        data, pos = t.encode(), 0
        for r in rs:
            assert r.start == pos and data[r.start:r.end].decode() == r.chunk_text and 1 <= r.token_count <= 5
            pos = r.end
        assert all(r.token_count == 5 for r in rs[:-1])


def test_upsert_and_merge_match_model(spark):
    from quarry.operators.upsert import latest_per_key, merge_table, merged_per_key, upsert_table

    rng = random.Random(21)
    rows = []
    for i in range(400):
        k = rng.choice([0, 0, 0, 1, 2, 3, 4])  # key 0 is hot
        rows.append((k, rng.randint(0, 30), i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.5, 2.5])))
    df = spark.createDataFrame(rows, "k int, ts int, eid int, f string, v double")

    def order(r):
        return (r[1], r[2])

    want_rep, want_mer = {}, {}
    for r in sorted(rows, key=order):
        want_rep[r[0]] = (r[3], r[4])
        old = want_mer.get(r[0], (None, None))
        want_mer[r[0]] = (r[3] if r[3] is not None else old[0], r[4] if r[4] is not None else old[1])
    got_rep = {r.k: (r.f, r.v) for r in latest_per_key(df, ["k"], ["ts", "eid"], ["f", "v"]).collect()}
    got_mer = {r.k: (r.f, r.v) for r in merged_per_key(df, ["k"], ["ts", "eid"], ["f", "v"]).collect()}
    assert got_rep == want_rep and got_mer == want_mer

    # against a stored table: the first half is the table, the second half the incoming batch
    first, second = df.filter("eid < 200"), df.filter("eid >= 200")
    base_rep = latest_per_key(first, ["k"], ["ts", "eid"], ["f", "v"])
    base_mer = merged_per_key(first, ["k"], ["ts", "eid"], ["f", "v"])
    rep2 = {r.k: (r.f, r.v) for r in upsert_table(base_rep, second.select("k", "ts", "eid", "f", "v"), ["k"], ["ts", "eid"]).collect()}
    mer2 = {r.k: (r.f, r.v) for r in merge_table(base_mer, second, ["k"], ["ts", "eid"], ["f", "v"]).collect()}
    last_first = {}
    for r in sorted([r for r in rows if r[2] < 200], key=order):
        last_first[r[0]] = (r[3], r[4])
    want_rep2 = dict(last_first)
    for r in sorted([r for r in rows if r[2] >= 200], key=order):
        want_rep2[r[0]] = (r[3], r[4])
    mer_first = {}
    for r in sorted([r for r in rows if r[2] < 200], key=order):
        old = mer_first.get(r[0], (None, None))
        mer_first[r[0]] = (r[3] if r[3] is not None else old[0], r[4] if r[4] is not None else old[1])
    want_mer2 = dict(mer_first)
    for r in sorted([r for r in rows if r[2] >= 200], key=order):
        old = want_mer2.get(r[0], (None, None))
        want_mer2[r[0]] = (r[3] if r[3] is not None else old[0], r[4] if r[4] is not None else old[1])
    assert rep2 == want_rep2 and mer2 == want_mer2


def test_text_search_matches_model(spark):
    from quarry.operators.textsearch import search_text

    rng = random.Random(31)
    words = ["alpha", "Beta", "GAMMA", "needle", "Needle", "x", "  ", "\t", "é"]
    files = []
    for i in range(120):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        text = "\n".join(lines) + rng.choice(["", "\n", "\r\n"])
        files.append((f"w{i % 4}", f"d{i % 3}/f{i:03d}.txt", text, len(text.encode())))
    content = spark.createDataFrame(files, "ws string, relpath string, content string, size long")

    def model(needle, cs, limit, cap):
        hits = {}
        for ws, rel, text, size in sorted(files, key=lambda f: (f[0], f[1])):
            if size > cap:
                continue
            for n, line in enumerate(py_lines(text), 1):
                if (needle in line) if cs else (needle.lower() in line.lower()):
                    hits.setdefault(ws, []).append((ws, rel, n, py_trim(line)))
        return sorted(h for v in hits.values() for h in v[:limit])

    for needle, cs, limit, cap in (("needle", False, 100, 1 << 20), ("Needle", True, 3, 1 << 20), ("a", False, 5, 40)):
        got = sorted((r.ws, r.relpath, r.line_number, r.snippet)
                     for r in search_text(content, needle, cs, limit, cap).collect())
        assert got == model(needle, cs, limit, cap), (needle, cs, limit, cap)
