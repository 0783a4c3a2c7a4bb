"""Registered queries of the index jobs, the segmented contents and the search structures, with their DuckDB oracles.

They write what the operator writes (files of a tree, tables, artefacts) to the shared folder, whole, and read it back.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.paths import is_pruned_file
from quarry.operators import cells, delta, pca, quality, segments, textindex
from quarry.operators.centroid import centroids, centroids_of, explode_vector, part_of, vector_sums
from quarry.operators.embedding import HashEmbedder, embed
from quarry.operators.knn import vector_search
from quarry.plans import fixtures as V
from quarry.plans.fixtures import (
    FIXTURE_CHUNK_TOKENS, FIXTURE_DIM, FIXTURE_MODEL, SQL_PRUNED, SQL_V_DIR, SQL_V_FILE, SQL_V_NODE, SQL_V_VEC, SQL_V_WORKSPACE,
    sql_hash_embed, sql_lang, sql_lines, sql_normalise, sql_v_chunk,
)
from quarry.plans.registry import ORACLES, TOPK, TOPK_FILE, _query_vector, _r6, register
from quarry.sources import tree_scan
from quarry.sources.staging import staging_path, written

#: Bytes of a segment in the queries: small, so that most texts have several.
SEGMENT = 700


# ============================================================================ tree scan
def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def write_tree(spark: SparkSession, rows: DataFrame) -> str:
    """``rows(relpath, content, link)`` as files below a new shared folder (``link``: a symbolic link instead)."""
    root = _plain(staging_path(spark, "tree"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, content, link in zip(*(b.column(i).to_pylist() for i in range(3))):
                path = os.path.join(root, rel)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if link:
                    if not os.path.islink(path):
                        os.symlink(root, path)
                    continue
                with open(path, "w", encoding="utf-8", newline="") as f:
                    f.write(content or "")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    written(rows.select("relpath", "content", "link").mapInArrow(run, "n long"), "tree-files")
    os.makedirs(root, exist_ok=True)
    return root


def _tree_rows(s: SparkSession, d: str) -> DataFrame:
    """The fixture tree below one root, a folder per workspace, with a symbolic link beside every 50th document."""
    tree = V.v_tree(s, d).select(F.concat_ws("/", "ws", "relpath").alias("relpath"), "content", "doc_id")
    links = tree.where("doc_id % 50 = 0").select(F.concat(F.col("relpath"), F.lit(".link")).alias("relpath"), F.lit(None).cast("string").alias("content"))
    return tree.select("relpath", "content", F.lit(False).alias("link")).unionByName(links.withColumn("link", F.lit(True)))


@register("tree_scan", f"""WITH {SQL_V_DIR}
SELECT 'file' AS kind, ws || '/' || relpath AS relpath, size, {sql_lang("ws || '/' || relpath")} AS lang, sha FROM v_file
UNION ALL SELECT DISTINCT 'dir', CASE WHEN relpath = '' THEN ws ELSE ws || '/' || relpath END, NULL, NULL, NULL FROM v_dir
UNION ALL SELECT 'dir', '', NULL, NULL, NULL""")
def _tree_scan(s: SparkSession, d: str) -> DataFrame:
    root = write_tree(s, _tree_rows(s, d))
    found = tree_scan.scan_tree(s, root, "all")
    return found.select("kind", "relpath", "size", "lang", F.when(F.col("kind") == "file", F.col("sha")).alias("sha"))


@register("tree_contents", f"""WITH {SQL_V_FILE}
SELECT ws || '/' || relpath AS relpath, sha, size FROM v_file""")
def _tree_contents(s: SparkSession, d: str) -> DataFrame:
    """Files read as segments, put together again and hashed: the hash that was taken while they streamed by holds."""
    root = write_tree(s, _tree_rows(s, d))
    files = tree_scan.stat_entries(tree_scan.list_tree(s, root), root, "all").where("kind = 'file'")
    read = tree_scan.read_files(files, root, SEGMENT)
    parts = F.array_sort(F.collect_list(F.struct("segment", "at", F.hex("content").alias("hex"))))
    whole = read.groupBy("relpath", "size").agg(F.max("sha").alias("streamed"), F.unhex(F.array_join(F.transform(parts, lambda p: p.hex), "")).alias("content"))
    good = (F.sha2("content", 256) == F.col("streamed")) & (F.octet_length("content") == F.col("size"))
    return whole.select("relpath", F.when(good, F.col("streamed")).alias("sha"), "size")


# ============================================================================ segmented contents
@register("segment_chunks", ORACLES["token_chunks"])
def _segment_chunks(s: SparkSession, d: str) -> DataFrame:
    seg = written(segments.to_segments(V.v_file(s, d), segment_bytes=SEGMENT), "segments")
    return segments.text_chunks(seg, max_tokens=FIXTURE_CHUNK_TOKENS).drop("chunk_text")


@register("segment_lines", f"WITH {SQL_V_FILE} {sql_lines('v_file')}")
def _segment_lines(s: SparkSession, d: str) -> DataFrame:
    return segments.lines(segments.to_segments(V.v_file(s, d), segment_bytes=SEGMENT))


@register("snippets_after_topk", ORACLES["vector_search_file"])
def _snippets_after_topk(s: SparkSession, d: str) -> DataFrame:
    """The file search with its snippets cut from segments, once the top k are known."""
    from quarry.operators.reading import with_snippets

    ranked = vector_search(V.v_chunk_vectors(s, d), _query_vector(), TOPK_FILE, group_cols=["ws", "relpath"], rank_col="rank")
    best = written(ranked.select("id", "ws", "relpath", "chunk_index", "start", "end", "token_count", _r6("score").alias("score"),
                                 F.col("rank").cast("bigint").alias("rank")), "ranked")
    return with_snippets(best, segments.to_segments(V.v_file(s, d), segment_bytes=SEGMENT)).drop("id")


# ============================================================================ incremental index
_SQL_SNAPSHOTS = f"""{SQL_V_FILE},
old AS (SELECT ws, relpath, CASE WHEN doc_id % 10 = 5 THEN 'old ' || content ELSE content END AS content FROM v_file WHERE doc_id % 10 <> 3),
new AS (SELECT ws, relpath, content FROM v_file WHERE doc_id % 10 <> 7),
st AS (SELECT ws, relpath, CASE WHEN old.content IS NULL THEN 'added' WHEN new.content IS NULL THEN 'removed'
              WHEN old.content = new.content THEN 'same' ELSE 'changed' END AS status
       FROM old FULL JOIN new USING (ws, relpath)),
both_ AS (SELECT 0 AS side, ws, relpath, content FROM old UNION ALL SELECT 1, ws, relpath, content FROM new),
tok AS (SELECT side, ws, relpath, regexp_extract_all(content, '{V.TOKEN_SQL}') AS t FROM both_ WHERE strlen(content) > 0 AND strpos(content, chr(0)) = 0),
ch AS (SELECT side, ws, relpath, sha256(array_to_string(list_slice(t, i * {FIXTURE_CHUNK_TOKENS} + 1, (i + 1) * {FIXTURE_CHUNK_TOKENS}), '')) AS sha
       FROM tok, LATERAL (SELECT unnest(range(0, CAST(ceil(len(t) / {FIXTURE_CHUNK_TOKENS}) AS BIGINT))) AS i) r),
cut AS (SELECT ch.* FROM ch JOIN st USING (ws, relpath) WHERE side = 1 AND status IN ('added', 'changed')),
emb AS (SELECT sha, min(ws) AS ws FROM cut WHERE sha NOT IN (SELECT sha FROM ch WHERE side = 0) GROUP BY sha)"""


@register("reindex_delta", f"""WITH {_SQL_SNAPSHOTS},
f AS (SELECT ws, count(*) FILTER (WHERE status = 'same') AS same, count(*) FILTER (WHERE status = 'changed') AS changed,
             count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed FROM st GROUP BY ws),
c AS (SELECT ws, count(*) AS n FROM cut GROUP BY ws), e AS (SELECT ws, count(*) AS n FROM emb GROUP BY ws)
SELECT ws, same, changed, added, removed, coalesce(c.n, 0) AS chunks_cut, coalesce(e.n, 0) AS contents_embedded
FROM f LEFT JOIN c USING (ws) LEFT JOIN e USING (ws)""")
def _reindex_delta(s: SparkSession, d: str) -> DataFrame:
    """Documents as two states of a tree: what changed, how many chunks are cut again, how many distinct ones embedded."""
    from quarry.operators.chunking import with_chunks

    files = V.v_file(s, d).select("ws", "relpath", "doc_id", "content")
    old = files.where("doc_id % 10 <> 3").withColumn("content", F.when(F.col("doc_id") % 10 == 5, F.concat(F.lit("old "), "content")).otherwise(F.col("content")))
    new = files.where("doc_id % 10 <> 7")
    state = lambda df: df.select("ws", "relpath", F.sha2("content", 256).alias("sha"))
    change = written(delta.capture(state(old), state(new), ["ws", "relpath"], ["sha"]), "delta")
    text = lambda df: with_chunks(df.where((F.octet_length("content") > 0) & ~X.is_binary(F.encode("content", "UTF-8"))), "content", FIXTURE_CHUNK_TOKENS)
    fresh = change.where(F.col("status").isin(delta.ADDED, delta.CHANGED)).select("ws", "relpath")
    cut = written(text(new.join(fresh, ["ws", "relpath"], "left_semi")).select("ws", "content_sha", "chunk_text"), "cut")
    known = text(old).select("content_sha").distinct()
    todo = delta.distinct_new(cut, known)
    sent = written(embed(todo, HashEmbedder(FIXTURE_DIM), "chunk_text").select("content_sha", F.size("vector").alias("dim")), "embedded")
    first = cut.groupBy("content_sha").agg(F.min("ws").alias("ws")).join(sent.where(F.col("dim") == FIXTURE_DIM), "content_sha")
    count = lambda st: F.count(F.when(F.col("status") == st, 1)).alias(st)
    out = change.groupBy("ws").agg(*[count(st) for st in (delta.SAME, delta.CHANGED, delta.ADDED, delta.REMOVED)])
    out = out.join(cut.groupBy("ws").agg(F.count(F.lit(1)).alias("c")), "ws", "left").join(first.groupBy("ws").agg(F.count(F.lit(1)).alias("e")), "ws", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("ws", "same", "changed", "added", "removed", zero("c").alias("chunks_cut"), zero("e").alias("contents_embedded"))


@register("index_job", f"""WITH {sql_v_chunk()}{SQL_V_DIR[len(SQL_V_FILE):]},
n AS (SELECT (SELECT count(*) FROM v_file) AS files, (SELECT 1 + count(*) FROM v_dir) AS dirs, (SELECT count(*) FROM v_chunk) AS chunks)
SELECT * FROM (SELECT 'directory' AS item, dirs AS n FROM n UNION ALL SELECT 'file', files FROM n UNION ALL SELECT 'vector_chunk', chunks FROM n
  UNION ALL SELECT 'ws_contains_dir', dirs FROM n UNION ALL SELECT 'dir_contains_dir', dirs - 1 FROM n UNION ALL SELECT 'dir_contains_file', files FROM n
  UNION ALL SELECT 'file_has_vector', chunks FROM n UNION ALL SELECT 'workspace_has_vector', 1 UNION ALL SELECT 'centroid sample', chunks FROM n
  UNION ALL SELECT 'report pass', 1) t""")
def _index_job(s: SparkSession, d: str) -> DataFrame:
    """Scan, chunk, embed and check a real tree into a catalogue; the rows that it ends up with."""
    from quarry.plans.index_jobs import index_all
    from quarry.sources.catalog import Catalog

    base = staging_path(s, "index-job")
    cat = Catalog(s, f"{base}/catalog", buckets=4)
    index_all(s, cat, write_tree(s, _tree_rows(s, d)), "all", HashEmbedder(FIXTURE_DIM), FIXTURE_MODEL, f"{base}/runs", max_tokens=FIXTURE_CHUNK_TOKENS)
    one = lambda df, item, n=F.count(F.lit(1)): df.agg(n.cast("bigint").alias("n")).select(F.lit(item).alias("item"), "n")
    parts = [one(cat.read(t), t) for t in ("directory", "file", "vector_chunk")]
    parts += [cat.read("edge").groupBy(F.col("relation").alias("item")).agg(F.count(F.lit(1)).alias("n")),
              one(cat.read("workspace_vector"), "centroid sample", F.sum("sample")),
              one(cat.read("run_report").where("acceptance = 'pass' AND finished IS NOT NULL"), "report pass")]
    return quality.union_reports(*parts)


@register("workspace_register", """
SELECT id, r.path AS path, r.node AS node_id, n.n_name AS node_name, CAST(NULL AS VARCHAR) AS den_id, CAST(NULL AS VARCHAR) AS den_name, 1 AS on_node
FROM (SELECT id, arg_max({'path': path, 'node': node}, seq) AS r
      FROM (SELECT 'ws' || CAST(s_suppkey % 17 AS VARCHAR) AS id, '/srv/' || s_name AS path, CAST(s_nationkey AS VARCHAR) AS node, s_suppkey AS seq FROM supplier) t
      GROUP BY id) g JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = r.node""")
def _workspace_register(s: SparkSession, d: str) -> DataFrame:
    """Registrations in two loads through the tool: the newest per id stays, with one edge to its node."""
    from quarry.plans import tools
    from quarry.sources.catalog import Catalog

    cat = Catalog(s, f"{staging_path(s, 'registered')}/catalog", buckets=4)
    reg = V.table(s, d, "supplier").select(
        F.concat(F.lit(" ws"), (F.col("s_suppkey") % 17).cast("string")).alias("id"), F.concat(F.lit("/srv/"), "s_name").alias("path"),
        F.col("s_nationkey").cast("string").alias("node"), F.col("s_suppkey").alias("seq"))
    half = V.table(s, d, "supplier").agg(F.percentile("s_suppkey", 0.5)).first()[0]
    cat.write("node", V.v_node(s, d))
    cat.write("den", V.v_den(s, d))
    tools.register_workspaces(cat, reg.where(F.col("seq") <= half))
    tools.register_workspaces(cat, reg.where(F.col("seq") > half))
    edges = cat.read("edge").where("relation = 'on_node'").select(F.col("in_id").alias("id"), F.col("out_id").alias("node_id"))
    count = edges.groupBy("id", "node_id").agg(F.count(F.lit(1)).cast("int").alias("on_node"))
    return tools.list_workspaces(cat).join(count, ["id", "node_id"])


@register("workspace_list_semi", ORACLES["workspace_list_den"].replace("SELECT m.filter_den, l.*", "SELECT l.*") + " WHERE m.filter_den = '2'")
def _workspace_list_semi(s: SparkSession, d: str) -> DataFrame:
    from quarry.operators.listing import workspace_list

    return workspace_list(V.v_workspace(s, d), V.v_node(s, d), V.v_den(s, d), V.v_den_ws(s, d), den_id=" 2 ")


# ============================================================================ checks with planted faults
_BAD_FILE = "doc_id % 41 = 7"


@register("check_unique_planted", f"""WITH {SQL_V_FILE},
p AS (SELECT ws, relpath, id FROM v_file UNION ALL SELECT ws, relpath, id FROM v_file WHERE doc_id % 50 = 7
      UNION ALL SELECT ws, relpath || 'X', id FROM v_file WHERE doc_id % 50 = 8)
SELECT 'file' AS table_name, 'unique(ws,relpath)' AS check_name, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS n FROM p GROUP BY ws, relpath)
UNION ALL SELECT 'file', 'unique(id)', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM p GROUP BY id)""")
def _check_unique_planted(s: SparkSession, d: str) -> DataFrame:
    """Rows that are there twice, and other paths under a stored id."""
    f = V.v_file(s, d).select("ws", "relpath", "id", "doc_id")
    rows = f.unionByName(f.where("doc_id % 50 = 7")).unionByName(f.where("doc_id % 50 = 8").withColumn("relpath", F.concat("relpath", F.lit("X"))))
    return quality.union_reports(*[quality.unique_violations(rows, "file", k) for k in (["ws", "relpath"], ["id"])])


@register("check_asserts_planted", """
SELECT 'workspace' AS table_name, 'path <> ''''' AS check_name, CAST(count(*) FILTER (WHERE s_suppkey % 6 IN (0, 1)) AS BIGINT) AS violations FROM supplier
UNION ALL SELECT 'workspace', 'node IS NOT NULL', CAST(count(*) FILTER (WHERE s_acctbal < 0) AS BIGINT) FROM supplier""")
def _check_asserts_planted(s: SparkSession, d: str) -> DataFrame:
    """Workspaces with an empty or a NULL path, or without a node, through the declared rules."""
    from quarry.schemas import ASSERTS

    rows = V.table(s, d, "supplier").select(
        F.when(F.col("s_suppkey") % 6 == 0, "").when(F.col("s_suppkey") % 6 != 1, F.col("s_name")).alias("path"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("string")).alias("node"))
    return quality.union_reports(*[quality.assert_violations(rows, "workspace", rule, F.expr(rule)) for rule in ASSERTS["workspace"]])


@register("check_links", f"""WITH {SQL_V_VEC},{SQL_V_WORKSPACE},{SQL_V_NODE},
w AS (SELECT id, CASE WHEN CAST(substr(id, 3) AS INTEGER) % 4 <> 0 THEN node END AS node FROM v_workspace), n AS (SELECT id FROM v_node WHERE CAST(id AS INTEGER) % 5 <> 1),
f AS (SELECT DISTINCT file AS id FROM v_vec WHERE relpath NOT IN ('f3', 'f4')),
l AS (SELECT 'workspace.node -> node.id' AS link, node AS k, node IN (SELECT id FROM n) AS there FROM w
  UNION ALL SELECT 'vector_chunk.file -> file.id', file, file IN (SELECT id FROM f) FROM v_vec
  UNION ALL SELECT 'file_has_vector.in_id -> file.id', file, file IN (SELECT id FROM f) FROM v_vec
  UNION ALL SELECT 'file_has_vector.out_id -> vector_chunk.id', id, TRUE FROM v_vec)
SELECT link, count(*) AS rows, count(*) - count(k) AS nulls, count(*) FILTER (WHERE k IS NOT NULL AND NOT there) AS orphans,
       count(DISTINCT k) FILTER (WHERE k IS NOT NULL AND NOT there) AS orphan_keys FROM l GROUP BY link""")
def _check_links(s: SparkSession, d: str) -> DataFrame:
    """Declared links over tables that lack some of the rows they name."""
    ws, vec = V.v_workspace(s, d), V.v_vec(s, d)
    tables = {
        "workspace": ws.withColumn("node", F.when(F.substring("id", 3, 20).cast("int") % 4 != 0, F.col("node"))),
        "node": V.v_node(s, d).where(F.col("id").cast("int") % 5 != 1),
        "file": vec.where(~F.col("relpath").isin("f3", "f4")).select(F.col("file").alias("id"), F.lit(None).cast("string").alias("ws")).distinct(),
        "vector_chunk": vec.select("id", "file", F.lit(None).cast("string").alias("ws")),
        "edge": vec.select(F.lit("file_has_vector").alias("relation"), F.col("file").alias("in_id"), F.col("id").alias("out_id"))}
    return quality.link_report(tables).where("rows > 0 AND link NOT LIKE '%.ws -> %'")


_SQL_FAULTS = f"""{sql_v_chunk()},
bad AS (SELECT ws, relpath, doc_id, chunk_index, CASE WHEN doc_id % 37 = 3 AND chunk_index > 0 THEN start - 1 ELSE start END AS start, "end",
               CASE WHEN doc_id % 31 = 4 THEN upper(content_sha) ELSE content_sha END AS content_sha
        FROM v_chunk WHERE NOT ({_BAD_FILE} AND chunk_index = 1)),
sw AS (SELECT *, coalesce(max("end") OVER (PARTITION BY ws, relpath ORDER BY start, "end", chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM bad),
tiles AS (SELECT ws, relpath, count(*) AS n_chunks, count(*) FILTER (WHERE start > upto) AS gaps, count(*) FILTER (WHERE start < upto) AS "overlaps", max("end") AS upper
          FROM sw GROUP BY ws, relpath)"""


def _faulty_chunks(s: SparkSession, d: str) -> DataFrame:
    c = V.v_chunk(s, d, keep_text=False).where(f"NOT ({_BAD_FILE} AND chunk_index = 1)")
    c = c.withColumn("start", F.when((F.col("doc_id") % 37 == 3) & (F.col("chunk_index") > 0), F.col("start") - 1).otherwise(F.col("start")))
    return c.withColumn("content_sha", F.when(F.col("doc_id") % 31 == 4, F.upper("content_sha")).otherwise(F.col("content_sha")))


@register("span_tiling", f"""WITH {_SQL_FAULTS}
SELECT ws, relpath, n_chunks, gaps, "overlaps", upper <> size AS bad_end FROM tiles JOIN v_file USING (ws, relpath)""")
def _span_tiling(s: SparkSession, d: str) -> DataFrame:
    """Chunks of which some are missing and some begin a byte early, swept file by file."""
    return quality.span_faults(_faulty_chunks(s, d), V.v_file(s, d))


@register("acceptance_faults", f"""WITH {_SQL_FAULTS},
j AS (SELECT b.content_sha AS old, b.start AS s0, c.content_sha AS new, c.start AS s1 FROM bad b FULL JOIN v_chunk c USING (ws, relpath, chunk_index)),
t AS (SELECT (SELECT count(*) FROM v_tree WHERE NOT {SQL_PRUNED}) AS discovered, (SELECT count(*) FROM v_file WHERE NOT ({_BAD_FILE})) AS inserted,
  (SELECT count(DISTINCT ws) FROM v_file) AS n_ws, (SELECT count(*) FROM j) AS n_all,
  (SELECT count(*) FROM j WHERE old = new AND s0 = s1) AS same, (SELECT count(*) FROM tiles) AS n_files,
  (SELECT count(*) FROM tiles JOIN v_file USING (ws, relpath) WHERE gaps = 0 AND "overlaps" = 0 AND upper = size) AS tiled,
  (SELECT count(*) FROM embeddings) AS vecs, (SELECT count(*) FROM embeddings WHERE vec_id % 11 <> 0) AS wide,
  (SELECT count(*) FROM (SELECT DISTINCT label, vec_id % 7 = 0 FROM embeddings)) AS cents)
SELECT check_name, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual, expected = actual AS ok FROM (
  SELECT 'files discovered = inserted' AS check_name, discovered AS expected, inserted AS actual FROM t
  UNION ALL SELECT 'root edges', n_ws, n_ws - (CASE WHEN EXISTS (SELECT 1 FROM v_file WHERE ws = 'src3') THEN 1 ELSE 0 END) FROM t
  UNION ALL SELECT 'chunk content_sha recomputes', n_all, same FROM t
  UNION ALL SELECT 'chunks tile their file', n_files, tiled FROM t
  UNION ALL SELECT 'vector width = native dim', vecs, wide FROM t
  UNION ALL SELECT 'centroid sample > 0', cents, cents FROM t) r""")
def _acceptance_faults(s: SparkSession, d: str) -> DataFrame:
    """All checks over an index in which files, an edge, chunks and vectors are spoilt; hashes are taken where contents are cut."""
    from quarry.operators.edges import ws_contains_dir

    files, chunks = V.v_file(s, d), written(_faulty_chunks(s, d).select("ws", "relpath", "chunk_index", "start", "end", "content_sha"), "faulty-chunks")
    roots = ws_contains_dir(V.v_dir(s, d).where("relpath = '' AND ws <> 'src3'"))
    cut = segments.text_chunks(written(segments.to_segments(files, segment_bytes=SEGMENT), "segments"), max_tokens=FIXTURE_CHUNK_TOKENS)
    again, tiled = quality.recut_faults(chunks, cut), quality.span_faults(chunks, files)
    vec, cents = _mixed(s, d), centroids(V.v_vec(s, d))
    n = F.count(F.lit(1))
    good = lambda c: F.sum(F.when(c, 1).otherwise(0))
    M = quality.measures
    one = lambda name, actual, expected=n: [(name, "expected", expected), (name, "actual", actual)]
    return quality.acceptance_report(
        M(V.v_tree(s, d), [("files discovered = inserted", "expected", good(~is_pruned_file("relpath")))]),
        M(files, [("files discovered = inserted", "actual", good(~F.expr(_BAD_FILE))), ("root edges", "expected", F.countDistinct("ws"))]),
        M(roots, [("root edges", "actual", n)]),
        M(again, one("chunk content_sha recomputes", F.sum(F.col("chunks") - F.col("surplus") - F.col("differing")), F.sum(F.col("chunks") + F.col("missing")))),
        M(tiled, one("chunks tile their file", good((F.col("gaps") == 0) & (F.col("overlaps") == 0) & ~F.col("bad_end")))),
        M(vec, one("vector width = native dim", good(F.size("vector") == FIXTURE_DIM))),
        M(cents, one("centroid sample > 0", good(F.col("sample") > 0))))


# ============================================================================ search structures
@register("vector_search_pruned", ORACLES["vector_search_batch"])
def _vector_search_pruned(s: SparkSession, d: str) -> DataFrame:
    """The batch search over a cell-partitioned table: cells that cannot hold one of the best are not looked into."""
    q = embed(V.table(s, d, "benchmark"), HashEmbedder(FIXTURE_DIM), "text", "query_vector").select("item_id", "query_vector")
    index = cells.build(V.v_vec(s, d), staging_path(s, "cells"), carry_cols=["ws", "relpath", "chunk_index"])
    found, _ = cells.search(index, written(q, "queries"), TOPK, qid_col="item_id")
    return found.select("item_id", "ws", "relpath", "chunk_index", _r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("text_search_indexed", f"""WITH {SQL_V_FILE},
q AS (SELECT item_id, string_split(text, ' ')[-1] AS needle FROM benchmark WHERE string_split(text, ' ')[-1] <> ''),
l AS ({sql_lines('v_file')})
SELECT item_id, ws, count(*) AS n_lines, CAST(sum(line_number) AS BIGINT) AS line_numbers, count(DISTINCT relpath) AS n_files
FROM q JOIN l ON contains(lower(line), lower(needle)) GROUP BY item_id, ws""")
def _text_search_indexed(s: SparkSession, d: str) -> DataFrame:
    """The last word of every test item, looked for in all files through the trigram postings."""
    content = V.v_file(s, d).select("ws", "relpath", "content")
    index = textindex.build(content, staging_path(s, "trigrams"))
    needles = V.table(s, d, "benchmark").select(F.col("item_id").alias("needle_id"), F.element_at(F.split("text", " "), -1).alias("needle"))
    hits = textindex.search(index, content, needles)
    return hits.groupBy(F.col("needle_id").alias("item_id"), "ws").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("line_number").alias("line_numbers"), F.countDistinct("relpath").alias("n_files"))


# ============================================================================ statistics that add up
def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Chunk vectors of which every eleventh has half the width."""
    v = V.v_vec(s, d)
    return v.withColumn("vector", F.when(F.col("vec_id") % 11 == 0, F.slice("vector", 1, FIXTURE_DIM // 2)).otherwise(F.col("vector")))


@register("centroid_mixed_width", f"""WITH {SQL_V_VEC},
m AS (SELECT *, CASE WHEN vec_id % 11 = 0 THEN list_slice(vector, 1, {FIXTURE_DIM // 2}) ELSE vector END AS v FROM v_vec),
d AS (SELECT ws, model, len(arg_min(v, row(relpath, chunk_index))) AS native_dim FROM m GROUP BY ws, model),
k AS (SELECT m.* FROM m JOIN d USING (ws, model) WHERE len(v) = native_dim)
SELECT ws, model, CAST(len(any_value(v)) AS INTEGER) AS native_dim, count(*) AS sample, CAST(i - 1 AS BIGINT) AS dim_index, (round(avg(v[i]), 6) + 0.0) AS value
FROM k, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) r GROUP BY ws, model, i""")
def _centroid_mixed_width(s: SparkSession, d: str) -> DataFrame:
    """Vectors of two widths: a group's first chunk in walk order sets the width that counts."""
    return explode_vector(centroids(_mixed(s, d)), "centroid", ["ws", "model", "native_dim", "sample"])


@register("centroid_merged", ORACLES["centroid_mixed_width"])
def _centroid_merged(s: SparkSession, d: str) -> DataFrame:
    """The same from sums that are kept by part of a workspace, one part written anew."""
    rows = _mixed(s, d).withColumn("part", part_of("relpath"))
    keep = written(vector_sums(rows.where("part <> 5"), ("ws", "model", "part")), "sums")
    sums = keep.unionByName(written(vector_sums(rows.where("part = 5"), ("ws", "model", "part")), "sums"))
    return explode_vector(centroids_of(sums), "centroid", ["ws", "model", "native_dim", "sample"])


@register("covariance_merged", """
WITH v AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT range AS i FROM range(1, (SELECT max(len(e)) + 1 FROM v)))
SELECT CAST(a.i - 1 AS BIGINT) AS a, CAST(b.i - 1 AS BIGINT) AS b, (round(covar_samp(e[a.i], e[b.i]), 6) + 0.0) AS covariance
FROM v, r a, r b WHERE a.i <= b.i GROUP BY a.i, b.i""")
def _covariance_merged(s: SparkSession, d: str) -> DataFrame:
    """Covariances from Gram matrices that were kept per label and added up."""
    parts = written(pca.gram_parts(V.table(s, d, "embeddings"), "label", "embedding"), "gram")
    one = pca.covariance_of(parts).select("dim", F.posexplode("covariance").alias("k", "c"))
    a, b = F.floor(F.col("k") / F.col("dim")), F.col("k") % F.col("dim")
    return one.select(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), _r6("c").alias("covariance")).where("a <= b")


# ============================================================================ artefacts
def _ndjson(s: SparkSession, d: str) -> str:
    """Documents as an NDJSON artefact, beside lines that are no such objects."""
    from quarry.sources.ndjson import write_artifact

    base = staging_path(s, "corpus")
    docs = V.table(s, d, "documents")
    write_artifact(docs.where("doc_id % 5 > 1").select("doc_id", "text"), base, "texts.ndjson")
    number = F.format_string('{"text": %d, "doc_id": 1}', "doc_id")
    broken = F.concat(F.lit('{"text": "cut off '), F.left(F.regexp_replace("text", "[^a-z ]", ""), F.lit(20)))
    docs.where("doc_id % 5 < 2").select(F.when(F.col("doc_id") % 5 == 0, number).otherwise(broken).alias("value")).write.text(f"{base}/odd.ndjson")
    return f"{base}/*.ndjson"


@register("ndjson_texts", "SELECT sha256(text) AS sha, count(*) AS n FROM documents WHERE text <> '' AND doc_id % 5 > 1 GROUP BY 1")
def _ndjson_texts(s: SparkSession, d: str) -> DataFrame:
    from quarry.sources.ndjson import read_texts

    return read_texts(s, _ndjson(s, d)).groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"))


@register("ndjson_sample", "SELECT least(50, count(*)) AS n, 0 AS strangers FROM documents WHERE text <> '' AND doc_id % 5 > 1")
def _ndjson_sample(s: SparkSession, d: str) -> DataFrame:
    """A cap on the texts read: that many, all from the table."""
    from quarry.sources.ndjson import read_texts

    some = written(read_texts(s, _ndjson(s, d), 50), "sample")
    mine = V.table(s, d, "documents").select("text", F.lit(1).alias("known")).distinct()
    return some.join(mine, "text", "left").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).cast("int").alias("strangers"))


@register("pca_model_mean", f"""
WITH e AS (SELECT {sql_normalise(sql_hash_embed('text', 16))} AS v FROM benchmark WHERE text <> '')
SELECT CAST(i - 1 AS BIGINT) AS dim_index, (round(avg(v[i]), 6) + 0.0) AS value, 1024 AS width, TRUE AS id_holds
FROM e, LATERAL (SELECT unnest(range(1, 17)) AS i) r GROUP BY i""")
def _pca_model_mean(s: SparkSession, d: str) -> DataFrame:
    """A PCA fitted on an NDJSON corpus of the test items, its model document written and read back."""
    from quarry.functions.hashing import transform_id
    from quarry.plans.pca_job import fit_pca_on_corpus
    from quarry.sources.ndjson import write_artifact

    base = staging_path(s, "pca")
    corpus = write_artifact(V.table(s, d, "benchmark").select("text"), base, "texts.ndjson")
    _, found = fit_pca_on_corpus(s, corpus, HashEmbedder(16), f"{base}/model", "m", k=4)
    doc = s.read.text(f"{base}/model")
    model = F.from_json("value", "mean array<double>, components array<array<double>>")
    rows = doc.select(model.alias("m"), (transform_id("value", "m") == found).alias("id_holds"))
    out = rows.select(F.posexplode("m.mean").alias("dim_index", "value"), F.size(F.get("m.components", F.lit(0))).alias("width"), "id_holds")
    return out.select(F.col("dim_index").cast("bigint").alias("dim_index"), _r6("value").alias("value"), "width", "id_holds")
