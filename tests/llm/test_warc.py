import hashlib
import heapq
import random

from quarry.llm import warc

BIG = "<p>é" + "x\r\n\r\n" * 400


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, seq int")


def test_revisits_digests_and_order(spark):
    rows = [(i, f"http://{'ab'[i % 2]}.example.org/p{i % 5}?x", BIG) for i in range(40)]  # one hot payload
    rows += [(100, "http://a.org/", "small"), (101, "http://a.org/", "small"), (102, None, None), (103, "", ""), (104, "http://a.org/\nWARC/1.1", "y" * 999),
             (105, "http://a.org/", "y" * 999), (106, "nohost", "z" * 1000), (107, "http://É.org/ü", "z" * 1000), (None, "http://n.org/", "z" * 1000),
             (108, "http://long.org/", "w " * 200_000), (109, "http://a.org/", "q" * 1000), (109, "http://a.org/", "q" * 1000)]
    out = warc.archive(pages(spark, rows).repartition(5))
    got = out.collect()
    order = [(r.url_key, r.capture_ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)
    last = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            last[b] = max(last.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and (i is None or i < last[b])
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", last[b] if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert warc.archive(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def test_loser_tree_against_heapq():
    r = random.Random(1)
    for k in range(0, 12):
        runs = [sorted((r.randrange(9),) for _ in range(r.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_a_record_is_found_by_its_place(spark, tmp_path):
    import gzip
    import re

    from quarry.llm.common import shared_path

    rows = [(i, f"http://a{i % 7}.org/{i}", f"<p>{i} \r\n\r\n" + "é" * i * 7) for i in range(300)]
    path = shared_path(spark, "w")
    warc.write_archives(pages(spark, rows).repartition(3), path)
    index = warc.read_index(spark, path)
    for r in warc.read_records(index).collect():
        record = bytes(r.record)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{r.page_id}>".encode() in record
        assert rows[r.page_id][2].encode() in record
    one = index.orderBy("page_id").first()
    whole = gzip.decompress(open(re.sub("^file:(//)?", "", one.file), "rb").read())  # an archive is a sequence of gzip members
    assert sum(1 for _ in warc.parse_records(whole)) == index.where(index.file == one.file).count()
