import zlib

import numpy as np

from quarry.llm import token_orc
from quarry.llm.common import tokenizer_file

BPE = tokenizer_file("byte_bpe_50k.json")
TEXTS = ["", None, "a", " a", "a ", "a  b", "a \n b", "x\ty  z\n\n w", " ", "\n", "it's we'll  don't", "é漢字🙂 x",
         "a  b  c", "word " * 5000, "<|endoftext|> x", "a b c", "a b c"]


def expected(rows):
    from tokenizers import Tokenizer

    lib, out, start = Tokenizer.from_file(BPE), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_the_library(spark, docs_df):
    rows = [((7 * i) % 31, t) for i, t in enumerate(TEXTS)]
    got = token_orc.write_and_index(docs_df(rows), BPE, 2).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected(rows))


def test_nulls_ties_and_empty_table(spark, docs_df):
    rows = [(None, "n"), (3, "same"), (3, "same"), (1, "x y")]
    got = sorted((tuple(r) for r in token_orc.write_and_index(docs_df(rows), BPE, 2).collect()), key=lambda r: r[1])
    assert got == sorted(expected(rows), key=lambda r: r[1])
    assert token_orc.write_and_index(docs_df(rows).limit(0), BPE, 2).count() == 0


def test_bounded_cache_gives_the_same_ids(monkeypatch):
    enc = token_orc.ChunkEncoder(BPE)
    a = enc.encode([t or "" for t in TEXTS], 2)
    monkeypatch.setattr(token_orc, "CACHE_CHUNKS", 3)
    for t in TEXTS:
        enc.encode([t or ""], 2)
    b = enc.encode([t or "" for t in TEXTS], 2)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_id_filter_is_pushed_to_the_files(spark, docs_df):
    from quarry.llm.common import shared_path

    path = shared_path(spark, "t")
    token_orc.write_tokens(docs_df([(i, f"text {i}") for i in range(100)]), path, BPE, 2)
    df = token_orc.read_tokens(spark, path).where("doc_id = 17")
    assert "EqualTo(doc_id,17)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1


def test_the_table_is_asked_once_for_each_distinct_word():
    class Counted(token_orc._Numbers):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

    enc = token_orc.ChunkEncoder(BPE)
    enc.seen = Counted()
    got = enc.encode(["w a b a b"] * 100 + ["", "a", " a"], 2)
    assert Counted.asked == 2
    one = [*enc.lib.encode("w a b a b", add_special_tokens=False).ids, 2]
    rest = [2, *enc.lib.encode("a", add_special_tokens=False).ids, 2, *enc.lib.encode(" a", add_special_tokens=False).ids, 2]
    assert got[0].tolist() == one * 100 + rest and got[1].tolist()[:101] == [len(one)] * 100 + [1]
