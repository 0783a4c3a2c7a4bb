import os
import random
import subprocess
import sys

import numpy as np
import pytest

from quarry.llm import piece_codec as C
from quarry.llm.common import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    chars = "abcdeghilnorstu éñßçя漢字🙂  ▁.,0123\n"
    return ["", "a  b", " a", "a ", "\n", "a\tb", "é漢字🙂x", "<s> </s>", "▁x", " " * 27, " " * 100 + "the" + " " * 37, "​", "x" * 300,
            "\0 a\0b", "the " * 4000, *["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(400)]]


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library(lib, monkeypatch):
    c, rows = C.PieceCodec(MODEL), texts()
    want = lib.encode(rows)
    for cache, block in ((C.CACHE_CHARS, C.BLOCK_CHARS), (30, 40)):
        monkeypatch.setattr(C, "CACHE_CHARS", cache)
        monkeypatch.setattr(C, "BLOCK_CHARS", block)
        for lo in range(0, len(rows), 100):
            flat, sizes = c.encode(rows[lo:lo + 100])
            got = np.split(flat, np.cumsum(sizes)[:-1])
            assert [g.tolist() for g in got] == want[lo:lo + 100]
    assert [c.decode(np.array(w, int)) for w in want] == [lib.decode(w) for w in want]


def test_table(spark, docs_df, lib):
    rows = [(i % 90, t) for i, t in enumerate(texts()[:100])] + [(None, None), (None, "x y")]
    out = C.encode(docs_df(rows).withColumnRenamed("n_words", "IDS"), MODEL)
    got = out.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), lib.encode(t or "")) for i, t in rows)
    assert all(r.round_trip == ("▁" not in (r.text or "")) for r in got)
    back = C.decode(out.select("doc_id", "ids", "text"), MODEL, "ids", "back").collect()
    assert all(r.back == (r.text or "").replace("▁", " ") for r in back)
    assert C.encode(docs_df(rows).limit(0), MODEL).count() == 0


KEPT = """
import random, re, string, sys
import pandas as pd
from quarry.llm import piece_codec as C

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

C.codec(sys.argv[1])
r = random.Random(3)
word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randrange(2, 12)))
before = held()
for out in C._encode_batches(iter([pd.Series([" ".join(word() for _ in range(250)) for _ in range(600)]) for _ in range(2)]), sys.argv[1]):
    assert len(out)
out = None
print(held() - before)
"""


def test_a_finished_task_keeps_little_memory():
    """A worker is reused by the stages after the encoding, so it must not keep what the encoding needed."""
    got = subprocess.run([sys.executable, "-c", KEPT, MODEL], capture_output=True, text=True, check=True, timeout=300,
                         env={**os.environ, "PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(C.__file__))), *sys.path])})
    assert float(got.stdout.split()[-1]) < 40
