"""WARC archives with payload revisits, and a capture index merged from sorted runs.

Writing: every record is a gzip member of its own, so that it can be read alone from its place in the archive. Tasks
compress their records, sorted by URL key and timestamp, and Spark's text sink writes the members with its commit
protocol on any file system; its line separator is an empty gzip member, which leaves the archive a valid sequence of
members. A member's header carries its place in its archive. Of equal payloads of at least ``least`` bytes the
capture with the largest id is the response and the others are revisit records that refer to it. The decision
joins ids and digests only; the payloads are shuffled once, by id, so neither a hot payload nor a hot URL gathers in
one task.

Reading: Spark's text source splits archives at the separators, so that they stream member by member and large ones
are read by several tasks. Records are parsed by their lengths, payload digests verified, and small index rows with
place and length written. Each archive is one sorted run. Index rows are range-partitioned by (URL key, timestamp, id),
and every range merges its pieces of the runs with a loser tree, which yields globally ordered capture histories.
``read_records`` fetches one record by its index row.

Defined results: a NULL payload is empty; a NULL URL has an empty key and no target header; rows with a NULL
id are never the response of others unless no id is known, and have no record id. Rows that repeat the largest
id are all responses. Control characters in a URL are written percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialise, prepare, shared_path
from quarry.llm.url_rules import host_of

CRLF = "\r\n"
#: Seconds of the first capture (2020-01-01T00:00:00Z) where the table has no time column.
FIRST_CAPTURE = 1_577_836_800
INDEX = ("url_key string, capture_ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, file string, position long, length long")
#: An empty gzip member stands between records: bytes that no UTF-8 text holds.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Header of a member with one extra field ("QP", 8 bytes): the member's place in its archive.
_HEAD = "<2sBBIBBH2sHQ"


def url_key(url: Column) -> Column:
    """Sort-friendly key: reversed host labels, then everything after the host (``org,example)/en?q``)."""
    u = F.coalesce(url, F.lit(""))
    host = host_of(u)
    rest = F.substring(u, F.instr(u, "://") + 3 + F.char_length(host), F.char_length(u))
    return F.when(F.instr(u, "://") > 0, F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)).otherwise(u)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   time_col: str | None = None, least: int = 1000) -> None:
    """Write one archive per task below ``path``, a gzip member per record."""
    when = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    clean = F.regexp_replace(F.col(url_col), "[\\x00-\\x1F\\x7F]", "%20")
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), clean.alias("url"), body.alias("html"),
        F.date_format(F.to_utc_timestamp(when, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    # ids and digests only: which payloads repeat, and which rows therefore revisit another
    small = rows.where(F.col("size") >= least).select("id", "digest")
    repeated = small.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialise(repeated.select("digest", "response"), "warc-repeated")
    revisits = small.join(repeated, "digest").where("id IS NULL OR id < response").select("id", "digest", "response").distinct()
    revisits = revisits.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "response")
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    revisit = F.col("response").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")), line("WARC-Date", F.col("ts")), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Refers-To", urn("response")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Url-Key", F.col("key")), line("X-Payload-Length", F.col("size").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block, F.lit(CRLF * 2))
    rows = rows.withColumn("key", url_key(F.col("url"))).sortWithinPartitions("key", "ts", "id")
    members = rows.select(record.alias("record")).mapInArrow(_members, "value binary")
    (members.select(F.col("value").cast("string").alias("value")).write  # bytes as they are
     .option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("iso-8859-1")).text(path))


def member(record: bytes, position: int) -> bytes:
    """``record`` as a gzip member that tells its place."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    head = struct.pack(_HEAD, b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"QP", 8, position)
    return head + z.compress(record) + z.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for b in batches:
        out, held = [], 0
        for r in b.column(0):
            out.append(member(r.as_py().encode(), at))
            at += len(out[-1]) + len(SEPARATOR)
            held += len(out[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, data[end + 4:end + 4 + n]
        at = end + 4 + n + 4


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, verified against its payload, in the order of its file."""
    prepare(spark)
    schema = pa.schema([("url_key", pa.string()), ("capture_ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64())])

    def number(urn: str | None) -> int | None:
        return None if urn is None else int(urn.removeprefix("<urn:page:").removesuffix(">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if not raw:  # behind the last separator
                    continue
                position = struct.unpack_from(_HEAD, raw)[-1]
                for _, head, block in parse_records(zlib.decompress(raw, 31)):
                    payload = block[block.index(b"\r\n\r\n") + 4:]
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs at byte {position} of {file}")
                    rows.append((head["X-Url-Key"], head["WARC-Date"], number(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"),
                                 head["WARC-Type"], number(head.get("WARC-Refers-To")), size, digest, file, position, len(raw)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _members_of(spark, path).mapInArrow(run, INDEX)


def _members_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the members of archives, as bytes."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("iso-8859-1")).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def read_records(found: DataFrame) -> DataFrame:
    """``found(file, position, length)`` with ``record``: each fetched alone, by its place, on executors that mount its archive."""
    prepare(found.sparkSession)

    @F.pandas_udf("binary")
    def fetch(file, position, length):
        import pandas as pd

        out = []
        for name, at, n in zip(file, position, length):
            with open(re.sub("^file:(//)?", "", name), "rb") as f:
                f.seek(at)
                out.append(zlib.decompress(f.read(n), 31))
        return pd.Series(out)

    return found.withColumn("record", fetch("file", "position", "length"))


class LoserTree:
    """k-way merge of sorted lists: each step replays one leaf-to-root path of lost matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [r for r in runs if r]
        self.at = [0] * len(self.runs)
        k = len(self.runs)
        self.tree = [-1] * max(k, 1)
        for leaf in range(k):
            self._replay(leaf, building=True)

    def _key(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _less(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + len(self.runs)) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0 and building:
                self.tree[node] = winner
                return
            if rival >= 0 and self._less(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and (key := self._key(run := self.tree[0])) is not None:
            yield key
            self.at[run] += 1
            self._replay(run)


def merge_runs(index: DataFrame) -> DataFrame:
    """Index rows in global (url_key, capture_ts, page_id) order across partitions and within them.

    A task merges the pieces of its key range, one per run, so its memory is that of one range. NULL ids come first.
    """
    names = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        keys = zip(t["url_key"].to_pylist(), t["capture_ts"].to_pylist(), ((x is not None, x or 0) for x in t["page_id"].to_pylist()))
        runs: dict[str, list[tuple]] = {}
        for row, (key, file, at) in enumerate(zip(keys, t["file"].to_pylist(), t["position"].to_pylist())):
            runs.setdefault(file, []).append((*key, at, row))
        for r in runs.values():  # a shuffle may hand over the blocks of a run in another order
            if any(a[3] > b[3] for a, b in zip(r, r[1:])):
                r.sort(key=lambda x: x[3])
        order = [x[4] for x in LoserTree([runs[f] for f in sorted(runs)])]
        for lo in range(0, len(order), 10_000):
            yield from t.take(order[lo:lo + 10_000]).combine_chunks().to_batches()

    ranged = index.repartitionByRange("url_key", "capture_ts", "page_id")
    return ranged.mapInArrow(run, index.schema).select(*names)


def archive(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as archives in the shared folder; return the merged index read back from them."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, **columns)
    return merge_runs(materialise(read_index(spark, path), "warc-index"))
