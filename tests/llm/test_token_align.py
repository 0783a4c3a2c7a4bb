"""Groups, links and counts against a plain alignment of the two libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quarry.llm import token_align
from quarry.llm.common import materialise
from quarry.llm.token_align import Aligner, add_alignment, link_counts, score

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [None, "", " ", "\n", "a", " a", "a ", "a  b", "▁", "x ▁ y", "<|endoftext|> x", "<s> </s> <unk> <0x41>", "é漢字🙂 x  ü", "don't we'll", "\x00 a",
       "tabs\tand\r\nlines \n\n end", "１２ ﬁ ½", "a" * 5000, "ab " * 3000, "​ x y", "é x", "word", "word"]


@pytest.fixture(scope="module")
def plain():
    """(n_a, n_b, groups, links) of a text, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    from quarry.llm.common import tokenizer_file

    a = Tokenizer.from_file(tokenizer_file(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}

    def align(text):
        if not text:
            return 0, 0, "", []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            return 0, 0, "", []
        ends = []
        for raw in (raw_a, raw_b):
            at, out = 0, []
            for r in raw:
                at += len(r)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links, last = [], [], 0
        for c in cuts:
            x = [i for i, e in zip(ids_a, ends[0]) if last < e <= c]
            y = [i for i, e in zip(ids_b, ends[1]) if last < e <= c]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            last = c
        links = [(i, j) for i, e in zip(ids_a, ends[0]) for j, f in zip(ids_b, ends[1]) if e == f] if len(ids_a) < 300 else [
            (dict(zip(ends[0], ids_a))[c], dict(zip(ends[1], ids_b))[c]) for c in cuts]
        return len(ids_a), len(ids_b), ";".join(groups), links

    return align


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "quick", "Zebra", "naïve", "x", "1234", "don't", "日本", "🙂", "foo_bar", "http://a.b/c?d", "  ", "\n", "\t", "ﬁ", "▁"]
    return [" ".join(rng.choice(words) + rng.choice(["", ",", "s", "."]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_groups_equal_the_plain_alignment(plain, monkeypatch):
    from quarry.llm.common import tokenizer_file

    tool = Aligner(tokenizer_file(A), tokenizer_file(B))
    rows = [t or "" for t in ODD] + texts(1)
    for cache in (250_000, 20):
        monkeypatch.setattr(token_align, "CACHE_WINDOWS", cache)
        monkeypatch.setattr(token_align, "CACHE_CHUNKS", cache)
        got = [r for k in range(0, len(rows), 7) for r in tool.align(rows[k:k + 7])]
        for t, (n_a, n_b, n_groups, groups, codes, times) in zip(rows, got):
            want = plain(t)
            assert (n_a, n_b, groups) == want[:3], t
            assert n_groups == len(want[3])
            assert dict(zip(codes.tolist(), times.tolist())) == Counter(a * len(tool.side_b.size) + b for a, b in want[3])


@pytest.mark.parametrize("pairs", [1_000_000, 3])
def test_counts_and_rows(spark, plain, monkeypatch, pairs):
    monkeypatch.setattr(token_align, "BROADCAST_PAIRS", pairs)
    rows = [(k, None if k % 9 == 0 else k % 40, t, "clash") for k, t in enumerate(ODD + texts(2))]
    df = spark.createDataFrame(rows, "row long, doc_id long, text string, N_A string").repartition(3)
    found = materialise(add_alignment(df, A, B), "t")
    assert found.columns == ["row", "doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    links = {k: plain(t)[3] for k, _, t, _ in rows}
    count = Counter(x for v in links.values() for x in v)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    counts = materialise(link_counts(found), "c")
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): (r["count"], r.best) for r in counts.collect()} == {x: (n, n == most[x[1]]) for x, n in count.items()}
    got = {r.row: (r.n_best, r.count_sum) for r in score(found, counts, "row").collect()}
    assert got == {k: (sum(count[x] == most[x[1]] for x in v), sum(count[x] for x in v)) for k, v in links.items() if v}


def test_query_on_odd_rows(spark, plain, tmp_path):
    from quarry.llm.queries import queries

    rows = [(k % 15 or None, t, "x") for k, t in enumerate(ODD + texts(3))]
    spark.createDataFrame(rows, "doc_id long, text string, n_best string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op11_token_align"](spark, str(tmp_path)).collect()
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = [(i, *plain(t)[:2], len(plain(t)[3]), len(plain(t)[3]), sha(plain(t)[2])) for i, t, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in got))) == sorted(map(str, want))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries()["op11_token_align"](spark, f"{tmp_path}/none").collect() == []
