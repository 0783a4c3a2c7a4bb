"""Catalog views derived from the driver tables (whole tables, no sampling).

Each view has a Spark builder (used by the registered queries) and a DuckDB
CTE (used by the oracle SQL). The mapping is a fixed rule over the row ids:

* ``documents`` -> files: workspace = ``source``; directory and extension are
  picked from fixed lists by ``doc_id``; content = ``text``. Every document is
  catalogued.
* ``pages`` -> vendored HTML inside pruned directories (``.git``,
  ``node_modules`` ...) of the same workspaces: present in the tree, skipped
  by the scan (their unpruned ancestors, e.g. ``web``, are still directories).
* ``embeddings`` -> vector chunks: workspace = ``'ws' || label``, file
  ``'f' || vec_id % 50``, chunk ``vec_id div 50``, model ``m1`` for every 7th id.
* ``nation`` / ``region`` / ``supplier`` -> node / den / workspace.
* ``events`` -> a stream of keyed registrations for upsert and merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.constants import UNICODE_SPACE_CLASS
from quarry.functions.hashing import chunk_id, content_sha, dir_id, file_id, path_sha
from quarry.functions.paths import ancestors, detect_language, has_skipped_dir, is_pruned_file
from quarry.functions.text import is_binary
from quarry.operators.chunking import with_chunks
from quarry.operators.embedding import HashEmbedder, embed

# --- fixed values: fixture layout ----------------------------------------------------------
FIXTURE_DIRS = ["", "src", "src/lib", "Docs"]
FIXTURE_PRUNED_DIRS = [".git/objects", "web/Node_Modules/pkg", "src/.svn", ".IDEA/cache"]
FIXTURE_WORKSPACES = 20
FIXTURE_EXTS = [".go", ".PY", ".md", "", ".tar.gz", ".", ".Rs"]
FIXTURE_CHUNK_TOKENS = 64
FIXTURE_DIM = 64
FIXTURE_MODEL = "hash-embed-64"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def v_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file tree before directory pruning: every document, plus pages under pruned directories."""
    d = table(spark, sf_dir, "documents")
    dirname = _pick(FIXTURE_DIRS, F.col("doc_id"))
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), _pick(FIXTURE_EXTS, F.col("doc_id")))
    docs = d.select(
        F.col("source").alias("ws"),
        F.concat(F.lit("/ws/"), F.col("source")).alias("root"),
        "doc_id",
        F.when(dirname == "", name).otherwise(F.concat(dirname, F.lit("/"), name)).alias("relpath"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    p = table(spark, sf_dir, "pages")
    ws = F.concat(F.lit("src"), (F.col("page_id") % FIXTURE_WORKSPACES).cast("string"))
    pages = p.select(
        ws.alias("ws"), F.concat(F.lit("/ws/"), ws).alias("root"), F.lit(None).cast("bigint").alias("doc_id"),
        F.concat(_pick(FIXTURE_PRUNED_DIRS, F.col("page_id")), F.lit("/p"), F.col("page_id").cast("string"),
                 F.lit(".html")).alias("relpath"),
        F.col("html").alias("content"), F.octet_length("html").cast("bigint").alias("size"),
    )
    return docs.unionByName(pages)


def v_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file catalogue a scan produces: pruned directories removed."""
    t = v_tree(spark, sf_dir).filter(~is_pruned_file("relpath"))
    return t.select(
        file_id("ws", "relpath").alias("id"), "ws", "root", "doc_id", "relpath",
        detect_language("relpath").alias("lang"), "size", content_sha("content").alias("sha"), "content",
    )


def v_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories a scan visits: every unpruned ancestor of a file, plus each root."""
    t = v_tree(spark, sf_dir)
    anc = t.select("ws", "root", F.explode(ancestors("relpath")).alias("relpath")).filter(
        ~has_skipped_dir(F.split("relpath", "/"))
    )
    roots = t.select("ws", "root", F.lit("").alias("relpath"))
    d = anc.unionByName(roots).distinct()
    full = F.when(F.col("relpath") == "", F.col("root")).otherwise(F.concat(F.col("root"), F.lit("/"), F.col("relpath")))
    return d.select(dir_id("ws", "relpath").alias("id"), "ws", "relpath", path_sha(full).alias("sha"))


def v_embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v_file(spark, sf_dir)
    return f.filter(F.col("size") > 0).filter(
        ~is_binary(F.encode("content", "UTF-8")))


def v_chunk(spark: SparkSession, sf_dir: str, keep_text: bool = True) -> DataFrame:
    """Token chunks of the embeddable files; the scan's splits set the parallelism, no text is shuffled."""
    f = v_embeddable(spark, sf_dir).drop("sha")
    return with_chunks(f, "content", FIXTURE_CHUNK_TOKENS, keep_text=keep_text).drop("content")


def v_chunk_vectors(spark: SparkSession, sf_dir: str, keep_text: bool = False) -> DataFrame:
    """Chunks embedded with the hash embedder: the ``vector_chunk`` table of the pipeline."""
    c = v_chunk(spark, sf_dir)
    e = embed(c, HashEmbedder(FIXTURE_DIM, FIXTURE_MODEL), "chunk_text")
    return e.select(
        chunk_id("ws", F.col("id"), "chunk_index").alias("chunk_id"),
        "ws", F.col("id").alias("file"), "relpath", "chunk_index", "start", "end", "token_count",
        "content_sha", "chunk_size", F.lit(FIXTURE_MODEL).alias("model"), "native_dim", "vector",
        *(["chunk_text"] if keep_text else []),
    ).withColumnRenamed("chunk_id", "id")


def v_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    ws = F.concat(F.lit("ws"), F.col("label").cast("string"))
    rel = F.concat(F.lit("f"), (F.col("vec_id") % 50).cast("string"))
    base = e.select(
        "vec_id", ws.alias("ws"), rel.alias("relpath"),
        F.floor(F.col("vec_id") / 50).cast("int").alias("chunk_index"),
        F.when(F.col("vec_id") % 7 == 0, F.lit("m1")).otherwise(F.lit("m0")).alias("model"),
        F.col("embedding").alias("vector"),
    )
    return base.withColumn("file", file_id("ws", "relpath")).withColumn("id", chunk_id("ws", F.col("file"), "chunk_index"))


def v_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("pc")).otherwise(F.lit("vm")).alias("kind"),
        F.lit("linux").alias("os"), F.lit(None).cast("string").alias("cpu"),
        (F.col("n_regionkey") * 8 + 8).cast("int").alias("ram_gb"),
        F.array(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))).alias("labels"),
    )


def v_den(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("code"),
                    F.col("r_name").alias("name"))


def v_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("ws"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("/srv/"), F.col("s_name")).alias("path"),
        F.col("s_nationkey").cast("string").alias("node"),
        F.lit("").alias("vcs"), F.lit("").alias("rev"), F.lit("").alias("content_sha"),
    )


def v_den_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """den -> workspace edges: a supplier in credit belongs to its nation's region;
    one above 5000 also to the next region; one in debt to none."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    ws = F.concat(F.lit("ws"), F.col("s_suppkey").cast("string"))
    first = j.filter(F.col("s_acctbal") >= 0).select(F.col("n_regionkey").cast("string").alias("in_id"), ws.alias("out_id"))
    second = j.filter(F.col("s_acctbal") > 5000).select(
        ((F.col("n_regionkey") + 1) % 5).cast("string").alias("in_id"), ws.alias("out_id"))
    return first.unionByName(second).select(F.lit("den_has_workspace").alias("relation"), "in_id", "out_id")


def v_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", "ts", "event_id", "event_type",
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        "props",
    )


def v_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("ws"),
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("relpath"),
        F.col("html").alias("content"), F.octet_length("html").cast("bigint").alias("size"),
    )


# ------------------------------------------------------------------------------------------
# DuckDB forms of the same views (used inside oracle SQL strings)
# ------------------------------------------------------------------------------------------

def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL_SPACE = UNICODE_SPACE_CLASS


def sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_hex_id(prefix: str, *parts: str) -> str:
    joined = " || '|' || ".join(f"lower({sql_trim(p)})" for p in parts)
    return f"('{prefix}-' || substr(sha256({joined}), 1, 20))"


def sql_chunk_label(idx: str) -> str:
    return f"('chunk#' || CASE WHEN {idx} < 1000000 THEN lpad(CAST({idx} AS VARCHAR), 6, '0') ELSE CAST({idx} AS VARCHAR) END)"


def sql_lang(path: str) -> str:
    from quarry.constants import LANGUAGE_BY_EXTENSION
    ext = f"lower(regexp_extract({path}, '(\\.[^./]*)$', 1))"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_BY_EXTENSION.items())
    return f"(CASE WHEN {ext} = '' THEN 'text' ELSE CASE {ext} {whens} ELSE substr({ext}, 2) END END)"


SQL_PRUNED = "regexp_matches(lower(relpath), '(^|/)(\\.git|\\.hg|\\.svn|node_modules|\\.idea|\\.vscode)/')"

SQL_V_TREE = f"""
v_tree AS (
  SELECT source AS ws, '/ws/' || source AS root, doc_id,
         CASE WHEN d = '' THEN n ELSE d || '/' || n END AS relpath,
         text AS content, CAST(strlen(text) AS BIGINT) AS size
  FROM (SELECT *, {_sql_list(FIXTURE_DIRS)}[doc_id % {len(FIXTURE_DIRS)} + 1] AS d,
               'f' || CAST(doc_id AS VARCHAR) || {_sql_list(FIXTURE_EXTS)}[doc_id % {len(FIXTURE_EXTS)} + 1] AS n
        FROM documents) t
  UNION ALL
  SELECT 'src' || CAST(page_id % {FIXTURE_WORKSPACES} AS VARCHAR), '/ws/src' || CAST(page_id % {FIXTURE_WORKSPACES} AS VARCHAR),
         CAST(NULL AS BIGINT),
         {_sql_list(FIXTURE_PRUNED_DIRS)}[page_id % {len(FIXTURE_PRUNED_DIRS)} + 1] || '/p' || CAST(page_id AS VARCHAR) || '.html',
         html, CAST(strlen(html) AS BIGINT)
  FROM pages)"""

SQL_V_FILE = SQL_V_TREE + f""",
v_file AS (
  SELECT {sql_hex_id('file', 'ws', 'relpath')} AS id, ws, root, doc_id, relpath,
         {sql_lang('relpath')} AS lang, size, sha256(content) AS sha, content
  FROM v_tree WHERE NOT {SQL_PRUNED})"""

SQL_V_DIR = SQL_V_FILE + f""",
v_anc AS (
  SELECT DISTINCT ws, root, array_to_string(list_slice(p, 1, i), '/') AS relpath
  FROM (SELECT ws, root, string_split(relpath, '/') AS p FROM v_tree) s,
       LATERAL (SELECT unnest(range(1, len(p))) AS i) r
  UNION
  SELECT DISTINCT ws, root, '' AS relpath FROM v_tree),
v_dir AS (
  SELECT {sql_hex_id('dir', 'ws', 'relpath')} AS id, ws, relpath,
         sha256(CASE WHEN relpath = '' THEN root ELSE root || '/' || relpath END) AS sha
  FROM v_anc WHERE NOT regexp_matches(lower(relpath || '/'), '(^|/)(\\.git|\\.hg|\\.svn|node_modules|\\.idea|\\.vscode)/'))"""

TOKEN_SQL = "[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+"


def sql_v_chunk(max_tokens: int = FIXTURE_CHUNK_TOKENS) -> str:
    """Token-array chunking (an independent formulation of the Spark chunker)."""
    return SQL_V_FILE + f""",
v_emb AS (
  SELECT * FROM v_file
  WHERE size > 0 AND strpos(content, chr(0)) = 0),
v_tok AS (
  SELECT id, ws, relpath, doc_id, regexp_extract_all(content, '{TOKEN_SQL}') AS toks FROM v_emb),
v_chunk0 AS (
  SELECT id, ws, relpath, doc_id, i AS chunk_index,
         array_to_string(list_slice(toks, i * {max_tokens} + 1, (i + 1) * {max_tokens}), '') AS chunk_text,
         CAST(strlen(array_to_string(list_slice(toks, 1, i * {max_tokens}), '')) AS BIGINT) AS start,
         CAST(len(list_slice(toks, i * {max_tokens} + 1, (i + 1) * {max_tokens})) AS INTEGER) AS token_count
  FROM v_tok, LATERAL (SELECT unnest(range(0, CAST(ceil(len(toks) / {max_tokens}) AS BIGINT))) AS i) r),
v_chunk AS (
  SELECT id, ws, relpath, doc_id, chunk_index, chunk_text, start, token_count,
         CAST(strlen(chunk_text) AS BIGINT) AS chunk_size,
         start + CAST(strlen(chunk_text) AS BIGINT) AS "end",
         sha256(chunk_text) AS content_sha
  FROM v_chunk0)"""


def sql_hash_embed(text_expr: str, dim: int = FIXTURE_DIM) -> str:
    """Hash embedding of a text as DOUBLE[] (float32-rounded, like the stored vectors)."""
    words = f"regexp_extract_all({text_expr}, '[^ \t\r\n]+')"
    feats = (f"list_transform({words}, lambda w: {{'b': CAST(('0x' || substr(sha256(w), 1, 8))::BIGINT % {dim} AS INTEGER), "
             f"'s': CASE WHEN substr(sha256(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END}})")
    counts = (f"list_transform(range({dim}), lambda i: "
              f"coalesce(list_sum(list_transform({feats}, lambda x: CASE WHEN x.b = i THEN x.s ELSE 0.0 END)), 0.0))")
    return counts


def sql_normalise(counts_expr: str) -> str:
    return (f"list_transform({counts_expr}, lambda x: CAST(CAST(CASE WHEN sqrt(list_sum(list_transform({counts_expr}, lambda y: y * y))) > 0 "
            f"THEN x / sqrt(list_sum(list_transform({counts_expr}, lambda y: y * y))) ELSE 0.0 END AS FLOAT) AS DOUBLE))")


SQL_V_VEC = f"""
v_vec0 AS (
  SELECT vec_id, 'ws' || CAST(label AS VARCHAR) AS ws, 'f' || CAST(vec_id % 50 AS VARCHAR) AS relpath,
         CAST(floor(vec_id / 50) AS INTEGER) AS chunk_index,
         CASE WHEN vec_id % 7 = 0 THEN 'm1' ELSE 'm0' END AS model,
         CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings),
v_vec1 AS (SELECT *, {sql_hex_id('file', 'ws', 'relpath')} AS file FROM v_vec0),
v_vec AS (SELECT *, {sql_hex_id('vec', 'ws', 'file', sql_chunk_label('chunk_index'))} AS id FROM v_vec1)"""

SQL_V_NODE = """
v_node AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name,
         CASE WHEN n_nationkey % 2 = 0 THEN 'pc' ELSE 'vm' END AS kind,
         CAST(n_regionkey * 8 + 8 AS INTEGER) AS ram_gb
  FROM nation)"""

SQL_V_DEN = """
v_den AS (SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name FROM region)"""

SQL_V_WORKSPACE = """
v_workspace AS (
  SELECT 'ws' || CAST(s_suppkey AS VARCHAR) AS id, '/srv/' || s_name AS path, CAST(s_nationkey AS VARCHAR) AS node
  FROM supplier)"""

SQL_V_DEN_WS = """
v_den_ws AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS in_id, 'ws' || CAST(s_suppkey AS VARCHAR) AS out_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
  UNION ALL
  SELECT CAST((n_regionkey + 1) % 5 AS VARCHAR), 'ws' || CAST(s_suppkey AS VARCHAR)
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)"""

SQL_V_UPSERT = """
v_upsert AS (
  SELECT user_id, ts, event_id, event_type,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, props
  FROM events)"""

SQL_V_PAGES = """
v_pages AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS ws, 'p' || CAST(page_id AS VARCHAR) || '.html' AS relpath,
         html AS content, CAST(strlen(html) AS BIGINT) AS size
  FROM pages)"""


def sql_lines(src: str) -> str:
    """Lines of ``src(ws, relpath, content)`` as ``(ws, relpath, line_number, line)``."""
    return f"""
SELECT ws, relpath, line_number,
       CASE WHEN suffix(raw, chr(13)) THEN substr(raw, 1, length(raw) - 1) ELSE raw END AS line
FROM (
  SELECT ws, relpath, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_number, unnest(parts) AS raw, len(parts) AS n
  FROM (SELECT ws, relpath, string_split(content, chr(10)) AS parts FROM {src}) s) u
WHERE NOT (line_number = n AND raw = '')"""
