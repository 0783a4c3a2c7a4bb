"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Its sketch has one register per hash function: the truncated,
logarithmically scaled minimum of exponentially spaced hash values, so sketches of parts merge by maximum and
registers of similar sets agree with a probability close to their Jaccard similarity. Bands of registers give
candidate pairs, a joint maximum-likelihood estimate from the registers of a pair drops the hopeless ones, and
the others are confirmed on their full shingle sets.

How it stays linear in large groups:

* equal sets are one node (the row with the smallest row number); copies never meet each other;
* in a band bucket every member is compared with one pivot (a star), not with every other: the member that shares
  most buckets with others, so that the copies of one text meet at the text nearest to all of them;
* after the stars are confirmed and components labelled, members x, y of one pivot can only be an open link if they
  carry different labels. Their shingles are put in one order: first those that the pivot lacks, rare ones ahead,
  then the pivot's. Linked sets must meet within a short prefix of that order, at places that leave enough
  shingles for the required common part; copies of the pivot's text with changes of their own fill that prefix
  with shingles nobody shares. Only members that do meet are compared, so no link is lost;
* a pivot's comparisons are dealt in portions of ``PORTION`` members, each a sorted stream against one set;
* hot classes, buckets and hubs are joined to small written tables, where Spark can split them.

With ``rows=4`` and ``bands=28`` a pair of similarity 0.85 shares no bucket with probability 1e-9 (0.80: 4e-7).

Defined results: NULL, empty or wordless texts have the empty set and are linked with nothing. Rows with a
NULL id are not compared and stay (component NULL). Rows that repeat an id are compared by their texts; a
component's id is the smallest id of its rows. Extra columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import free_name, materialise, prepare
from quarry.llm.shingles import mix, shingle_sets
from quarry.llm.token_orc import slices

#: SetSketch parameters: base, rate and largest register value (16-bit registers).
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: Members compared with one copy of a pivot's set.
PORTION = 500
#: Hash values handled at once (keeps the register loop inside the processor cache).
_BLOCK = 1 << 15
#: A pair is confirmed on full sets unless its estimate is this many standard errors too low.
_SIGMAS = 6.0


def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return (r.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, m, dtype=np.uint64))


def registers(sets: list[np.ndarray], m: int) -> np.ndarray:
    """(sets, m) uint16 registers; an empty set has registers 0."""
    odd, salt = _functions(m)
    low = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    k = 0
    while k < len(sets):
        end, size = k, 0
        while end < len(sets) and (end == k or size + len(sets[end]) <= _BLOCK):
            size += len(sets[end])
            end += 1
        rows = [i for i in range(k, end) if len(sets[i])]
        if rows:
            whole = np.concatenate([sets[i] for i in rows])
            cuts = np.arange(0, len(whole), _BLOCK) if len(rows) == 1 else [0]
            for c in cuts:  # a very long set goes through in pieces: registers of pieces merge
                h = whole[c:c + _BLOCK] if len(rows) == 1 else whole
                starts = np.cumsum([0, *[len(sets[i]) for i in rows[:-1]]]) if len(rows) > 1 else np.zeros(1, int)
                x = np.empty_like(h)
                for j in range(m):
                    np.bitwise_xor(h, salt[j], out=x)
                    np.multiply(x, odd[j], out=x)
                    low[rows, j] = np.minimum(low[rows, j], np.minimum.reduceat(x, starts))
        k = end
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    with np.errstate(divide="ignore"):
        spaced = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE  # exponential with rate RATE
    reg = np.clip(np.floor(1.0 - np.log(spaced) / np.log(BASE)), 0, TOP)
    reg[[i for i, s in enumerate(sets) if not len(s)]] = 0
    return reg.astype(np.uint16)


def joint_similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers ``a``, ``b`` for known set sizes."""
    above, below = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - above - below
    u = size_a / (size_a + size_b)
    v = 1.0 - u

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in j: ternary search
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = likelihood(x) < likelihood(y)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def _set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(df: DataFrame, k: int, m: int) -> DataFrame:
    """(row, doc_id, n, k1, k2, regs) per row of ``df(row, doc_id, text)``; k1, k2 digest the set."""
    schema = "row long, doc_id long, n long, k1 long, k2 long, regs binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                sets = shingle_sets(texts[lo:hi], k)
                regs = registers(sets, m)
                keys = [_set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()),
                     pa.array([r.tobytes() for r in regs], pa.binary())], ["row", "doc_id", "n", "k1", "k2", "regs"])

    return df.mapInArrow(run, schema)


def _buckets(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, node, n): one row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _functions(rows + 1)[0]
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(b.num_rows, bands, rows).astype(np.uint64)
            key = np.repeat(np.arange(bands, dtype=np.uint64)[None, :] * weight[rows], b.num_rows, axis=0)
            for r in range(rows):
                key = mix(key + (regs[:, :, r] + np.uint64(1)) * weight[r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), bands)),
                 pa.array(np.repeat(b.column(1).to_numpy(), bands))], ["bucket", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(run, "bucket long, node long, n long")


def _promising(pairs: DataFrame, nodes: DataFrame, percent: int, m: int) -> DataFrame:
    """Pairs (a, b, portion) whose estimate does not rule them out."""
    least = max(0.0, percent / 100 - _SIGMAS * np.sqrt(percent / 100 * (1 - percent / 100) / m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, m) for i in (5, 6))
            sim = joint_similarity(x, y, b.column(3).to_numpy().astype(float), b.column(4).to_numpy().astype(float))
            good = pa.array(sim >= least)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(good) for i in range(3)], ["a", "b", "portion"])

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "portion", "na", "nb", "ra", "rb")
    rows = rows.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return rows.mapInArrow(run, "a long, b long, portion int")


def _streams(pairs: DataFrame, texts: DataFrame, k: int) -> tuple[DataFrame, Callable]:
    """Rows (a, portion, b, k1, k2, text), the pivot (b NULL) ahead of its members, and their reader.

    The reader yields (pivot, its set, member, its set); a text counts for a node only if its set has the
    node's digest (another text may carry the same id).
    """
    ask = pairs.select(F.col("b").alias("node"), "a", "portion", "b").union(
        pairs.select("a", "portion").distinct().select(F.col("a").alias("node"), "a", "portion", F.lit(None).cast("long").alias("b")))
    rows = ask.join(texts, "node").select("a", "portion", "b", "k1", "k2", "text")
    rows = rows.repartition("a", "portion").sortWithinPartitions("a", "portion", F.col("b").asc_nulls_first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        at, held = None, None
        for batch in batches:
            texts = batch.column(5).to_pylist()
            for lo, hi in slices(texts, 2_000_000):
                sets = shingle_sets(texts[lo:hi], k)
                cols = [batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(5)]
                for a, portion, b, k1, k2, s in zip(*cols, sets):
                    if (k1, k2) != _set_key(s):
                        continue
                    if b is None:
                        at, held = (a, portion), s
                    elif at == (a, portion):
                        yield a, held, b, s

    return rows, read


def _portion(size) -> Column:
    return F.pmod(F.hash("b"), (F.lit(1) + F.floor(size / PORTION)).cast("int")).cast("int").alias("portion")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b): pairs whose full sets have ``100 * intersection >= percent * union``."""
    rows, read = _streams(pairs, texts, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for a, held, b, s in read(batches):
            common = len(np.intersect1d(held, s, assume_unique=True))
            if 100 * common >= percent * (len(held) + len(s) - common):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _prefixes(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, shingle, lacks, place, out, n): for every member b of pivot a the ``out`` shingles that a lacks (``place``
    not known yet), and as many of a's, in hash order, as the prefix of b still needs."""
    rows, read = _streams(pairs, texts, k)
    schema = "a long, b long, shingle long, lacks boolean, place int, out int, n int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, held, b, s in read(batches):
            e = np.setdiff1d(s, held, assume_unique=True)
            prefix = len(s) - -(-percent * len(s) // 100) + 1
            more = np.intersect1d(s, held, assume_unique=True)[:max(0, prefix - len(e))]
            size = len(e) + len(more)
            place = np.concatenate([np.zeros(len(e), np.int32), len(e) + 1 + np.arange(len(more), dtype=np.int32)]).astype(np.int32)
            fill = lambda v, t: pa.array(np.full(size, v, t))
            yield pa.RecordBatch.from_arrays(
                [fill(a, np.int64), fill(b, np.int64), pa.array(np.concatenate([e, more]).view(np.int64)), pa.array(place == 0), pa.array(place),
                 fill(len(e), np.int32), fill(len(s), np.int32)], ["a", "b", "shingle", "lacks", "place", "out", "n"])

    return rows.mapInArrow(run, schema)


def _open_pairs(members: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): members of one pivot with different labels whose prefixes meet."""
    tagged = members.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    tagged = materialise(tagged.select("a", "b", "portion", "label"), "near-tagged")
    split = tagged.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("a")
    still = materialise(tagged.join(split, "a"), "near-open")
    seen = _prefixes(still.select("a", "b", "portion"), texts, k, percent).join(still.select("a", "b", "label"), ["a", "b"])
    seen = materialise(seen, "near-prefixes")
    shared = seen.groupBy("a", "shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("times"))
    seen = seen.join(shared.where("lo < hi").select("a", "shingle", "times"), ["a", "shingle"])
    # shingles that meet no other label come first in the order: they are gone already but keep their places
    mine = Window.partitionBy("a", "b", "lacks")
    rank = F.row_number().over(mine.orderBy("times", "shingle")) + F.col("out") - F.count(F.lit(1)).over(mine)
    seen = seen.withColumn("place", F.when(F.col("lacks"), rank).otherwise(F.col("place")))
    seen = seen.withColumn("rest", F.col("n") - F.col("place") + 1).where(F.col("rest") * 100 >= F.col("n") * percent)
    seen = materialise(seen.select("a", "b", "label", "shingle", "rest", "n"), "near-shared")
    # a common part needs percent / (100 + percent) of both sizes, and has at most ``rest`` shingles from here on
    enough = lambda r, x, y: F.col(r) * (100 + percent) >= (F.col(x) + F.col(y)) * percent
    groups = seen.groupBy("a", "shingle", "label").agg(F.max("rest").alias("rest"), F.min("n").alias("n"))
    other = groups.select("a", "shingle", F.col("label").alias("label2"), F.col("rest").alias("rest2"), F.col("n").alias("n2"))
    meet = groups.join(other, ["a", "shingle"]).where((F.col("label") < F.col("label2")) & enough("rest", "n", "n2") & enough("rest2", "n", "n2"))
    meet = meet.select("a", "shingle", "label", "label2")
    right = seen.select("a", "shingle", F.col("label").alias("label2"), F.col("b").alias("c"), F.col("rest").alias("rest2"), F.col("n").alias("n2"))
    both = meet.join(seen, ["a", "shingle", "label"]).join(right, ["a", "shingle", "label2"]).where(enough("rest", "n", "n2") & enough("rest2", "n", "n2"))
    return both.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the smallest node that is reachable.

    Minimum labels spread along links and then jump to their label's label; every round is a written table,
    and both joins are against tables with one row per key, where Spark splits hot hubs.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = near.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        least = materialise(least, "near-labels")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = materialise(least.join(up, "label").select("node", F.least("label", "up").alias("label")), "near-labels")
        # labels only ever fall, so equal sums mean that nothing changed
        if labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first() == new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first():
            return new
        labels = new


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, rows: int = 4, bands: int = 28, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``df``."""
    return _labelled(df, k, percent, rows, bands, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _labelled(df: DataFrame, k: int, percent: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the digest of the row's set (k1, k2) and its component's own label (NULL if alone)."""
    prepare(df.sparkSession)
    m = rows * bands
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = materialise(sketches(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), k, m), "near-sketches")
    # one node per distinct set
    some = sk.where("n > 0 AND doc_id IS NOT NULL")
    nodes = materialise(some.groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.min_by("doc_id", "row").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "near-nodes")
    buckets = _buckets(nodes, bands, rows)
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = materialise(buckets.join(materialise(sizes, "near-sizes"), "bucket"), "near-buckets")
    weight = materialise(crowded.groupBy("node").agg(F.sum("size").alias("weight")), "near-weights")
    stars = crowded.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("node"))).alias("p"))
    stars = materialise(stars.select("bucket", (-F.col("p.col2")).alias("a")), "near-stars")
    members = crowded.join(stars, "bucket").where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.max("size").alias("size"))
    members = materialise(members.select("a", "b", _portion(F.col("size"))), "near-members")
    wanted = members.select(F.col("a").alias("node")).union(members.select("b")).distinct().join(nodes.select("node", "doc_id", "k1", "k2"), "node")
    texts = materialise(wanted.join(docs, "doc_id").select("node", "k1", "k2", "text"), "near-texts")
    pairs = materialise(_promising(members, nodes, percent, m), "near-pairs")
    links = materialise(_confirm(pairs, texts, k, percent), "near-confirmed")
    labels = components(links)
    rest = _open_pairs(members, labels, texts, k, percent).withColumn("portion", _portion(F.lit(8 * PORTION)))
    rest = materialise(_promising(rest, nodes, percent, m), "near-pairs")
    more = materialise(_confirm(rest, texts, k, percent), "near-confirmed")
    if not more.isEmpty():
        labels = components(links.union(more))
    # rows -> nodes -> labels -> smallest id
    classes = nodes.select("k1", "k2", "node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_set = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"))
    classes = materialise(classes.drop("doc_id").join(per_set, ["k1", "k2"]), "near-classes")
    smallest = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    named = materialise(classes.join(smallest, "label").select("k1", "k2", "label", "component_id"), "near-named")
    out = sk.select("doc_id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      "k1", "k2", F.when(~alone, F.col("label")).alias("label"))


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of ``df``, with the group's smallest id. Rows that share an id are told apart by their
    texts' shingle sets: each stays if it stands for a group of its own; of equal ones, wordless ones too, one stays."""
    found = materialise(_labelled(df, k, percent, 4, 28, id_col, text_col).where("doc_id IS NOT NULL"), "near-found")
    one = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("o")).select("o.*")
    one = one.union(found.where("label IS NULL").select("doc_id", "k1", "k2"))
    several = materialise(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "near-repeated")
    name, want, mine = free_name(df, "__keep"), free_name(df, "__want"), free_name(df, "__mine")
    key = F.col(id_col).cast("long") == F.col(name)
    # ids that go, and ids of several rows, are fewer than those that stay: texts meet the smaller tables
    gone = found.select("doc_id").join(one.select("doc_id"), "doc_id", "left_anti").union(several).distinct()
    gone = materialise(gone.select(F.col("doc_id").alias(name)), "near-gone")
    plain = df.where(F.col(id_col).isNotNull()).join(gone, key, "left_anti")
    sets = one.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set(F.concat_ws(",", "k1", "k2")).alias("sets"))
    sets = materialise(sets.select(F.col("doc_id").alias(name), F.col("sets").alias(want)), "near-keep")

    @F.pandas_udf("string")
    def digest(texts):
        import pandas as pd

        return pd.Series([",".join(map(str, _set_key(shingle_sets([t], k)[0]))) for t in texts], dtype=object)

    # only rows that share an id need their sets again
    some = df.join(sets, key).withColumn(mine, digest(F.col(text_col)))
    some = some.where(F.array_contains(want, F.col(mine))).drop(name, want).dropDuplicates([id_col, mine]).drop(mine)
    return plain.unionByName(some).unionByName(df.where(F.col(id_col).isNull()))
