"""Constraint and acceptance checks, reported as DataFrames (no driver loops over data)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_COLS = ("table_name", "check_name", "violations")


def unique_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Number of rows beyond the first for each duplicated key (0 when the key is unique)."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return dup.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique(" + ",".join(keys) + ")").alias("check_name"), "violations"
    )


def assert_violations(df: DataFrame, table: str, name: str, predicate: Column) -> DataFrame:
    """Rows for which ``predicate`` is not true (NULL counts as a violation)."""
    return df.agg(
        F.sum(F.when(F.coalesce(predicate, F.lit(False)), 0).otherwise(1)).cast("bigint").alias("violations")
    ).select(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"),
             F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))


def union_reports(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def catalog_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Every UNIQUE key and ASSERT rule of :mod:`quarry.schemas` as one violation report
    over the given tables (any subset of the catalogue)."""
    from quarry.schemas import ASSERTS, UNIQUE_KEYS

    reps = []
    for name, df in tables.items():
        for keys in UNIQUE_KEYS.get(name, []):
            reps.append(unique_violations(df, name, keys))
        for rule in ASSERTS.get(name, []):
            reps.append(assert_violations(df, name, rule, F.expr(rule)))
    return union_reports(*reps)


def measures(df: DataFrame, items: list[tuple[str, str, Column]]) -> DataFrame:
    """Aggregates over ``df`` (one pass) as rows ``(check_name, side, value)``; side is expected/actual."""
    one = df.agg(*[v.cast("bigint").alias(f"m{i}") for i, (_, _, v) in enumerate(items)])
    rows = F.array(*[F.struct(F.lit(c).alias("check_name"), F.lit(sd).alias("side"), F.col(f"m{i}").alias("value"))
                     for i, (c, sd, _) in enumerate(items)])
    return one.select(F.inline(rows))


def acceptance_report(*measures: DataFrame) -> DataFrame:
    """``(check_name, expected, actual, ok)`` from measure rows (no joins between the sources)."""
    m = union_reports(*measures)
    return m.groupBy("check_name").agg(
        F.max(F.when(F.col("side") == "expected", F.col("value"))).alias("expected"),
        F.max(F.when(F.col("side") == "actual", F.col("value"))).alias("actual"),
    ).withColumn("ok", F.col("expected") == F.col("actual"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """One row (link, rows, nulls, orphans, orphan_keys) about a link: rows whose filled ``column`` names no ``parent``.

    Links are counted per value before they meet the parent's keys, so a value that many rows share is one row there.
    """
    counts = child.groupBy(F.col(column).cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    there = parent.select(F.col(key).cast("string").alias("_k"), F.lit(True).alias("_there")).distinct()
    lost = F.col("_k").isNotNull() & F.col("_there").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counts.join(there, "_k", "left").agg(
        total("_n").alias("rows"), total(F.when(F.col("_k").isNull(), F.col("_n"))).alias("nulls"),
        total(F.when(lost, F.col("_n"))).alias("orphans"), total(F.when(lost, 1)).alias("orphan_keys")).select(
        F.lit(name).alias("link"), "rows", "nulls", "orphans", "orphan_keys")


def link_report(tables: dict[str, DataFrame]) -> DataFrame:
    """:func:`orphans` of every declared link and edge relation whose tables are given."""
    from quarry.schemas import EDGE_LINKS, LINKS

    reports = [orphans(tables[t], c, tables[p], k, f"{t}.{c} -> {p}.{k}") for t, c, p, k in LINKS if t in tables and p in tables]
    if "edge" in tables:
        for relation, ends in EDGE_LINKS.items():
            rows = tables["edge"].where(F.col("relation") == relation)
            reports += [orphans(rows, side, tables[t], k, f"{relation}.{side} -> {t}.{k}")
                        for side, (t, k) in zip(("in_id", "out_id"), ends) if t in tables]
    return union_reports(*reports)


def span_faults(chunks: DataFrame, files: DataFrame, keys: Sequence[str] = ("ws", "relpath")) -> DataFrame:
    """Per file with chunks: (keys, n_chunks, gaps, overlaps, bad_end): whether its chunks' spans tile its bytes.

    A sweep over the spans in byte order: a span that begins after the end of all before it leaves a gap, one
    that begins before that end overlaps; the last end is the file's size. Spans only, no contents.
    """
    from pyspark.sql.window import Window

    before = Window.partitionBy(*keys).orderBy("start", "end", "chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    spans = chunks.select(*keys, "chunk_index", "start", "end")
    spans = spans.withColumn("_to", F.coalesce(F.max("end").over(before), F.lit(0)))
    per = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count(F.when(F.col("start") > F.col("_to"), 1)).alias("gaps"),
        F.count(F.when(F.col("start") < F.col("_to"), 1)).alias("overlaps"), F.max("end").alias("_last"))
    return per.join(files.select(*keys, "size"), list(keys), "left").select(
        *keys, "n_chunks", "gaps", "overlaps", (~F.col("_last").eqNullSafe(F.col("size"))).alias("bad_end"))


def recut_faults(stored: DataFrame, cut: DataFrame, keys: Sequence[str] = ("ws", "relpath")) -> DataFrame:
    """One row (chunks, missing, surplus, differing): stored chunks against those that a new pass over the contents cuts.

    Both sides are spans and hashes by (keys, chunk_index); the hashes were taken where the contents were cut.
    """
    side = lambda df, name: df.select(*keys, "chunk_index", F.struct("start", "end", "content_sha").alias(name))
    both = side(stored, "_old").join(side(cut, "_new"), [*keys, "chunk_index"], "full_outer")
    old, new = F.col("_old"), F.col("_new")
    return both.agg(F.count(old).alias("chunks"), F.count(F.when(old.isNull(), 1)).alias("missing"), F.count(F.when(new.isNull(), 1)).alias("surplus"),
                    F.count(F.when(old.isNotNull() & new.isNotNull() & (old != new), 1)).alias("differing"))


def workspace_acceptance(catalog, ws: str, discovered_files: int | None = None) -> DataFrame:
    """Acceptance checks of one indexed workspace, as ``(check_name, expected, actual, ok)``.

    * files discovered by the scan = files in the catalogue (when ``discovered_files`` is given);
    * the root directory has a ``ws_contains_dir`` edge;
    * every chunk vector has the model's native width;
    * every chunk's span and ``content_sha`` recompute in a new pass over the stored contents;
    * the chunks of every file tile its bytes;
    * every centroid has a positive sample.
    """
    from quarry.operators.segments import text_chunks

    mine = lambda table: catalog.read(table).filter(F.col("ws") == ws)
    files, chunks, wsv, embedded = mine("file"), mine("vector_chunk"), mine("workspace_vector"), mine("embedded_file")
    edges = mine("edge").filter(F.col("relation") == "ws_contains_dir")
    root_edges = mine("directory").filter(F.col("relpath") == "").join(edges, F.col("id") == F.col("out_id"), "left_semi")
    cut = None
    for s in embedded.select("model", "max_tokens").distinct().collect():  # a row per model and chunk size
        sources = embedded.where((F.col("model") == s.model) & (F.col("max_tokens") == s.max_tokens))
        part = text_chunks(mine("content").join(sources.select("relpath"), "relpath", "left_semi"), ("relpath",), s.max_tokens)
        part = part.select(F.lit(s.model).alias("model"), "relpath", "chunk_index", "start", "end", "content_sha")
        cut = part if cut is None else cut.unionByName(part)
    again = recut_faults(chunks, cut if cut is not None else chunks.limit(0), ("model", "relpath"))
    good = lambda c: F.sum(F.when(c, 1).otherwise(0))
    n = F.count(F.lit(1))
    one = lambda name, actual, expected=n: [(name, "expected", expected), (name, "actual", actual)]
    sizes = chunks.select("model", "relpath").distinct().join(files.select("relpath", "size"), "relpath")
    tiled = span_faults(chunks, sizes, ("model", "relpath"))
    parts = [
        measures(files, [("files catalogued", "actual", n)]),
        measures(root_edges, [("root edge present", "actual", n)]),
        measures(chunks, one("vector width = native dim", good(F.size("vector") == F.col("native_dim")))),
        measures(again, one("chunk content_sha recomputes", F.sum(F.col("chunks") - F.col("surplus") - F.col("differing")), F.sum(F.col("chunks") + F.col("missing")))),
        measures(tiled, one("chunks tile their file", good((F.col("gaps") == 0) & (F.col("overlaps") == 0) & ~F.col("bad_end")))),
        measures(wsv, one("centroid sample > 0", good(F.col("sample") > 0))),
    ]
    spark = files.sparkSession
    fixed = [("root edge present", "expected", 1)]
    if discovered_files is not None:
        fixed.append(("files catalogued", "expected", int(discovered_files)))
    parts.append(spark.createDataFrame(fixed, "check_name string, side string, value bigint"))
    report = acceptance_report(*parts)
    if discovered_files is None:
        report = report.filter(F.col("check_name") != "files catalogued")
    return report
