"""Registered queries (Spark) and their DuckDB oracles.

Every query reads whole driver tables (through the views in
:mod:`quarry.plans.fixtures`); limits appear only where they are the operator
(top-k, first-n). Per-workspace / per-file tools are evaluated for every
workspace / file at once. Floating results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import paths as P
from quarry.functions import text as X
from quarry.functions.vectors import cosine_to_query
from quarry.operators import edges, listing, quality, textsearch, upsert
from quarry.operators.centroid import centroids, column_mean, explode_vector
from quarry.operators.chunking import text_lines
from quarry.operators.edges import dir_contains_dir, dir_contains_file, ws_contains_dir
from quarry.operators.embedding import HashEmbedder, embed
from quarry.operators.knn import batch_knn, vector_search
from quarry.operators.pca import fit_pca
from quarry.operators.reading import read_slices
from quarry.plans import fixtures as V
from quarry.plans.fixtures import (
    FIXTURE_DIM, FIXTURE_MODEL, SQL_SPACE, SQL_V_DEN, SQL_V_DEN_WS, SQL_V_DIR, SQL_V_FILE, SQL_V_NODE, SQL_V_PAGES,
    SQL_V_TREE, SQL_V_UPSERT, SQL_V_VEC, SQL_V_WORKSPACE, SQL_PRUNED, sql_hash_embed, sql_hex_id, sql_lines,
    sql_normalise, sql_trim, sql_v_chunk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- fixed values: search parameters of the registered queries ------------------------------
QUERY_TEXT = "workspace vector search over indexed files"
TOPK = 5
TOPK_FILE = 3
SLICE_CHARS = 61_440  # longest slice that the slice queries ask for
SNIPPET_BYTES = 512


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _r6(c) -> F.Column:
    """Round to 6 digits; ``+ 0.0`` turns a negative zero into zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _query_vector() -> list[float]:
    return [float(x) for x in HashEmbedder(FIXTURE_DIM)([QUERY_TEXT])[0]]


def _sql_vec(values: list[float]) -> str:
    return "([" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[])"


def _sql_cos(vec: str, q: list[float]) -> str:
    qn = sum(x * x for x in q) ** 0.5
    return (f"(CASE WHEN len({vec}) = {len(q)} AND list_dot_product({vec}, {vec}) > 0 THEN "
            f"list_dot_product({vec}, {_sql_vec(q)}) / (sqrt(list_dot_product({vec}, {vec})) * {qn!r}) END)")


# ============================================================================ paths / hashes
register("detect_language", f"WITH {SQL_V_FILE} SELECT ws, relpath, lang FROM v_file")(
    lambda s, d: V.v_file(s, d).select("ws", "relpath", "lang"))

register("content_hash", f"WITH {SQL_V_FILE} SELECT ws, relpath, size, sha FROM v_file")(
    lambda s, d: V.v_file(s, d).select("ws", "relpath", "size", "sha"))

register("record_ids", f"""WITH {SQL_V_FILE}
SELECT ws, relpath, id AS file_id,
       {sql_hex_id('dir', 'ws', "regexp_extract(relpath, '^(.*)/[^/]*$', 1)")} AS parent_dir_id
FROM v_file""")(
    lambda s, d: V.v_file(s, d).select("ws", "relpath", F.col("id").alias("file_id"),
                                       H.dir_id("ws", P.parent_path("relpath")).alias("parent_dir_id")))

register("scan_prune", f"WITH {SQL_V_TREE} SELECT ws, relpath, NOT {SQL_PRUNED} AS kept FROM v_tree")(
    lambda s, d: V.v_tree(s, d).select("ws", "relpath", (~P.is_pruned_file("relpath")).alias("kept")))

register("workspace_tree_dirs", f"""WITH {SQL_V_DIR}
SELECT ws, relpath,
       CASE WHEN relpath = '' THEN '/' ELSE string_split(relpath, '/')[-1] END AS name,
       regexp_extract(relpath, '^(.*)/[^/]*$', 1) AS parent, sha
FROM v_dir""")(lambda s, d: listing.tree_directories(V.v_dir(s, d)))

register("workspace_tree_files", f"""WITH {SQL_V_FILE}
SELECT ws, relpath, string_split(relpath, '/')[-1] AS name,
       regexp_extract(relpath, '^(.*)/[^/]*$', 1) AS directory, lang, size, sha
FROM v_file""")(lambda s, d: listing.tree_files(V.v_file(s, d).withColumn("mtime", F.lit(None).cast("timestamp"))).drop("mtime"))

register("model_slug", """
SELECT page_id, slug,
       CASE WHEN strpos(url, '-') = 0 THEN slug ELSE split_part(url, '-', 1) END AS family,
       CASE WHEN strpos(url, '-') = 0 THEN 'base' ELSE substr(url, strpos(url, '-') + 1) END AS version
FROM (SELECT page_id, url,
             regexp_replace(regexp_replace(translate(lower(url), ' /:@._', '------'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug
      FROM pages) t""")(
    lambda s, d: V.table(s, d, "pages").select(
        "page_id", X.model_slug("url").alias("slug"), X.split_model("url").alias("m")
    ).select("page_id", "slug", "m.family", "m.version"))


def _rfc3339_sql(ts: str) -> str:
    frac = f"regexp_replace(strftime({ts}, '%f'), '0+$', '')"
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END || 'Z')")


register("run_ids", f"""
SELECT event_id,
       'RUN-' || strftime(ts, '%Y%m%d') || '-' ||
       substr(sha256('ws' || CAST(user_id AS VARCHAR) || '|' || event_type || '|' || {_rfc3339_sql('ts')}), 1, 8) AS run_id
FROM events""")(
    lambda s, d: V.table(s, d, "events").select(
        "event_id", H.run_id(F.concat(F.lit("ws"), F.col("user_id").cast("string")), F.col("event_type"), F.col("ts")).alias("run_id")))


# ============================================================================ text functions
def _ansi_raw_spark(df: DataFrame) -> F.Column:
    return F.concat(
        F.lit("\x1b[1;31m"), F.col("role"), F.lit("\x1b[0m: "), F.col("text"), F.lit("\u009b2K"),
        F.lit("\x1b]0;turn "), F.col("turn").cast("string"), F.lit("\x07"), F.lit("\x1bOA"),
        F.lit("\x1b]2;t\x1b\\"),
    )


_ANSI_RAW_SQL = ("chr(27) || '[1;31m' || role || chr(27) || '[0m: ' || text || chr(155) || '2K' || "
                 "chr(27) || ']0;turn ' || CAST(turn AS VARCHAR) || chr(7) || chr(27) || 'OA' || chr(27) || ']2;t' || chr(27) || '\\'")

register("strip_ansi", f"""
SELECT conv_id, turn, clean, clean = role || ': ' || text AS restored
FROM (SELECT conv_id, turn, role, text,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace({_ANSI_RAW_SQL},
          '\\x1b\\][^\\x07]*(\\x07|\\x1b\\\\)', '', 'g'),
          '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'),
          '\\x{{9b}}[0-9;?]*[ -/]*[@-~]', '', 'g'),
          '\\x1bO[^\\n]', '', 'g') AS clean
      FROM conversations) t""")(
    lambda s, d: (lambda c: c.select(
        "conv_id", "turn", X.strip_ansi(_ansi_raw_spark(c)).alias("clean"), "role", "text"
    ).select("conv_id", "turn", "clean", (F.col("clean") == F.concat("role", F.lit(": "), "text")).alias("restored")))(
        V.table(s, d, "conversations")))

register("clean_labels", f"""
SELECT conv_id, turn, CAST(len(l) AS BIGINT) AS n_labels, sha256(array_to_string(l, '|')) AS labels_sha
FROM (SELECT conv_id, turn,
             list_filter(list_transform(string_split(text, ','), lambda x: {sql_trim('x')}), lambda x: x <> '') AS l
      FROM conversations) t""")(
    lambda s, d: V.table(s, d, "conversations").select(
        "conv_id", "turn", X.clean_labels(F.split("text", ",", -1)).alias("l")
    ).select("conv_id", "turn", F.coalesce(F.size("l"), F.lit(0)).cast("bigint").alias("n_labels"),
             F.sha2(F.coalesce(F.array_join("l", "|"), F.lit("")), 256).alias("labels_sha")))

register("text_lines", f"WITH {SQL_V_FILE} {sql_lines('v_file')}")(
    lambda s, d: text_lines(V.v_file(s, d).select("ws", "relpath", "content"), "content").select(
        "ws", "relpath", "line_number", "line"))


# ============================================================================ path search
def _find_sql(pred: str, limit: int | str = "rn") -> str:
    return f"""WITH {SQL_V_FILE}
SELECT ws, relpath, lang, size, sha FROM (
  SELECT *, row_number() OVER (PARTITION BY ws ORDER BY relpath) AS rn FROM v_file WHERE {pred}) t
WHERE rn <= {limit}"""


register("find_file_exact", _find_sql("relpath = 'src/f121.md'"))(
    lambda s, d: listing.find_file(V.v_file(s, d), " src/f121.md ", "exact"))
register("find_file_prefix", _find_sql("starts_with(relpath, 'src/lib/')"))(
    lambda s, d: listing.find_file(V.v_file(s, d), "src/lib/", "Prefix"))
register("find_file_suffix", _find_sql("suffix(relpath, '.md')", 3))(  # ordered limit, as asked
    lambda s, d: listing.find_file(V.v_file(s, d), ".md", "suffix", limit=3))
register("find_file_substring", _find_sql("contains(relpath, 'f1')"))(
    lambda s, d: listing.find_file(V.v_file(s, d), "f1", None))


# ============================================================================ text search
def _search_sql(src_cte: str, src: str, pred: str, size_cap: int | str = "size", limit: int | str = "rn", per: str = "ws", order: str = "relpath, line_number") -> str:
    return f"""WITH {src_cte},
lines AS ({sql_lines(f"(SELECT * FROM {src} WHERE size <= {size_cap})")})
SELECT ws, relpath, line_number, {sql_trim('line')} AS snippet FROM (
  SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY {order}) AS rn FROM lines WHERE {pred}) t
WHERE rn <= {limit}"""


register("text_search_ci", _search_sql(SQL_V_FILE, "v_file", "contains(lower(line), lower('The'))"))(
    lambda s, d: textsearch.search_text(V.v_file(s, d), "The", case_sensitive=False))
register("text_search_cs", _search_sql(SQL_V_FILE, "v_file", "contains(line, 'the')", limit=7))(
    lambda s, d: textsearch.search_text(V.v_file(s, d), "the", case_sensitive=True, limit=7))
register("text_search_maxbytes", _search_sql(SQL_V_FILE, "v_file", "contains(lower(line), lower('É'))", 4096, 500))(
    lambda s, d: textsearch.search_text(V.v_file(s, d), "É", case_sensitive=False, limit=500, max_file_bytes=4096))
register("text_search_file", _search_sql(SQL_V_FILE, "v_file", "contains(lower(line), lower('Ou'))",
                                         per="ws, relpath", order="line_number"))(
    lambda s, d: textsearch.search_file_text(V.v_file(s, d), "Ou"))
register("html_text_search", _search_sql(SQL_V_PAGES, "v_pages", "contains(lower(line), lower('<LI>'))"))(
    lambda s, d: textsearch.search_text(V.v_pages(s, d), "<LI>"))


# ============================================================================ chunks, embeddings
register("embeddable_files", f"""WITH {sql_v_chunk()} SELECT ws, relpath, size FROM v_emb""")(
    lambda s, d: V.v_embeddable(s, d).select("ws", "relpath", "size"))

register("token_chunks", f"""WITH {sql_v_chunk()}
SELECT ws, relpath, CAST(chunk_index AS INTEGER) AS chunk_index, start, "end", token_count, content_sha, chunk_size
FROM v_chunk""")(
    lambda s, d: V.v_chunk(s, d, keep_text=False).select(
        "ws", "relpath", "chunk_index", "start", "end", "token_count", "content_sha", "chunk_size"))


def _snippet_sql(content: str, start: str, end: str, most: int | None = None) -> str:
    window = f"{content}[({start}) + 1:{end}]"
    text = sql_trim(f"replace(decode({window}), chr(10), ' ')")
    b = f"encode({text})"
    if most is None:
        return text
    cut = (f"coalesce(try(decode({b}[1:512])), try(decode({b}[1:511])) || chr(65533), "
           f"try(decode({b}[1:510])) || chr(65533), try(decode({b}[1:509])) || chr(65533))")
    return f"(CASE WHEN strlen({text}) > {most} THEN {cut} || '…' ELSE {text} END)"


def _chunk_snippets(s: SparkSession, d: str) -> DataFrame:
    """Snippets cut from the chunks' own bytes in the pass that makes the chunks: no join with the files."""
    data = F.encode("chunk_text", "UTF-8")
    return V.v_chunk(s, d).select("ws", "relpath", "chunk_index",
                                  X.snippet(data, F.lit(0), F.octet_length(data), SNIPPET_BYTES).alias("snippet"))


register("chunk_snippet", f"""WITH {sql_v_chunk()}
SELECT c.ws, c.relpath, CAST(c.chunk_index AS INTEGER) AS chunk_index,
       {_snippet_sql('encode(f.content)', 'c.start', 'c."end"', SNIPPET_BYTES)} AS snippet
FROM v_chunk c JOIN v_file f ON c.ws = f.ws AND c.relpath = f.relpath""")(_chunk_snippets)

register("hash_embed", f"""
SELECT item_id, CAST(i - 1 AS BIGINT) AS dim_index, (round(v[i], 6) + 0.0) AS value
FROM (SELECT item_id, {sql_normalise(sql_hash_embed('text'))} AS v FROM benchmark) t,
     LATERAL (SELECT unnest(range(1, {FIXTURE_DIM} + 1)) AS i) r""")(
    lambda s, d: explode_vector(embed(V.table(s, d, "benchmark"), HashEmbedder(FIXTURE_DIM), "text"), "vector", ["item_id"]))


def _sql_chunk_vectors() -> str:
    """Per chunk, the float32-rounded normalised hash vector as sparse (bucket, value) rows."""
    return f""",
v_words AS (
  SELECT id AS file, ws, relpath, chunk_index, unnest(regexp_extract_all(chunk_text, '[^ \t\r\n]+')) AS w FROM v_chunk),
v_feat AS (
  SELECT file, ws, relpath, chunk_index, CAST(('0x' || substr(sha256(w), 1, 8))::BIGINT % {FIXTURE_DIM} AS INTEGER) AS b,
         CASE WHEN substr(sha256(w), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM v_words),
v_cnt AS (SELECT file, ws, relpath, chunk_index, b, sum(s) AS c FROM v_feat GROUP BY ALL),
v_norm AS (SELECT *, sqrt(sum(c * c) OVER (PARTITION BY file, chunk_index)) AS nrm FROM v_cnt),
v_sparse AS (SELECT file, ws, relpath, chunk_index, b,
                    CAST(CAST(CASE WHEN nrm > 0 THEN c / nrm ELSE 0 END AS FLOAT) AS DOUBLE) AS v FROM v_norm)"""


register("embed_pipeline", f"""WITH {sql_v_chunk()}{_sql_chunk_vectors()},
n_chunks AS (SELECT ws, count(*) AS sample FROM v_chunk GROUP BY ws),
dims AS (SELECT DISTINCT ws, CAST(unnest(range({FIXTURE_DIM})) AS INTEGER) AS b FROM v_chunk),
sums AS (SELECT ws, b, sum(v) AS sv FROM v_sparse GROUP BY ALL)
SELECT d.ws, '{FIXTURE_MODEL}' AS model, {FIXTURE_DIM} AS native_dim, n.sample, CAST(d.b AS BIGINT) AS dim_index,
       (round(coalesce(s.sv, 0) / n.sample, 6) + 0.0) AS value
FROM dims d JOIN n_chunks n ON d.ws = n.ws LEFT JOIN sums s ON s.ws = d.ws AND s.b = d.b""")(
    lambda s, d: explode_vector(centroids(V.v_chunk_vectors(s, d)), "centroid", ["ws", "model", "native_dim", "sample"]))

register("workspace_centroid", f"""WITH {SQL_V_VEC}
SELECT ws, model, CAST(len(any_value(vector)) AS INTEGER) AS native_dim, count(*) AS sample, CAST(i - 1 AS BIGINT) AS dim_index,
       (round(avg(vector[i]), 6) + 0.0) AS value
FROM v_vec, LATERAL (SELECT unnest(range(1, len(vector) + 1)) AS i) r
GROUP BY ws, model, i""")(
    lambda s, d: explode_vector(centroids(V.v_vec(s, d)), "centroid", ["ws", "model", "native_dim", "sample"]))

register("embedding_mean", """
SELECT CAST(i - 1 AS BIGINT) AS dim_index, (round(avg(CAST(embedding[i] AS DOUBLE)), 6) + 0.0) AS value
FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) r GROUP BY i""")(
    lambda s, d: explode_vector(column_mean(V.table(s, d, "embeddings"), "embedding"), "mean", []))


@register("pca_explained")
def _pca_explained(s: SparkSession, d: str) -> DataFrame:
    res = fit_pca(V.table(s, d, "embeddings"), "embedding", k=8)
    rows = [(i, float(v)) for i, v in enumerate(res.explained_variance)]
    return s.createDataFrame(rows, "component bigint, explained_variance double")


@register("pca_project")  # rows-only: fitted on the table, then every vector is projected
def _pca_project(s: SparkSession, d: str) -> DataFrame:
    from quarry.operators.pca import project

    emb = V.table(s, d, "embeddings")
    res = fit_pca(emb, "embedding", k=8)  # only the d x k model reaches the driver
    out = project(emb, res, "embedding", "projected")
    return out.select("vec_id", F.posexplode("projected").alias("component", "value")).select(
        "vec_id", F.col("component").cast("bigint").alias("component"), _r6("value").alias("value"))


@register("pca_axes", """
SELECT CAST(i AS BIGINT) AS a, CAST(j AS BIGINT) AS b, TRUE AS holds FROM range(8) r(i), range(8) q(j) WHERE i <= j""")
def _pca_axes(s: SparkSession, d: str) -> DataFrame:
    """The projected vectors' covariances over the total variance: the explained shares on the diagonal, else 0 (to 1e-6)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from quarry.operators.pca import project

    emb = V.table(s, d, "embeddings")
    res = fit_pca(emb, "embedding", k=8)
    out = project(emb, res, "embedding", "p")
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    spread = Summarizer.variance(array_to_vector(F.col("embedding").cast("array<double>")))
    total = F.aggregate(vector_to_array(spread), F.lit(0.0), lambda x, y: x + y)
    covs = out.agg(*[F.covar_samp(F.col("p")[i], F.col("p")[j]).alias(f"c{i}_{j}") for i, j in pairs], total.alias("total"))
    rows = F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("a"), F.lit(j).cast("bigint").alias("b"),
        (F.abs(F.col(f"c{i}_{j}") / F.col("total") - F.lit(float(res.explained_variance[i]) if i == j else 0.0)) < 1e-6).alias("holds"))
        for i, j in pairs])
    return covs.select(F.inline(rows))


# ============================================================================ vector search
register("cosine_scores", f"""WITH {SQL_V_VEC}
SELECT vec_id, (round({_sql_cos('vector', _query_vector())}, 6) + 0.0) AS score FROM v_vec""")(
    lambda s, d: V.v_vec(s, d).select("vec_id", _r6(cosine_to_query("vector", _query_vector())).alias("score")))

register("resolve_model", f"""WITH {SQL_V_VEC} SELECT ws, min(model) AS model_id FROM v_vec GROUP BY ws""")(
    lambda s, d: V.v_vec(s, d).groupBy("ws").agg(F.min("model").alias("model_id")))


def _vector_search_ws(s: SparkSession, d: str, include: DataFrame | None = None) -> DataFrame:
    vec = V.v_vec(s, d)
    model = vec.groupBy("ws").agg(F.min("model").alias("model"))
    cand = vec.join(model, ["ws", "model"], "left_semi")
    if include is not None:
        cand = cand.join(include, "relpath", "left_semi")
    ranked = vector_search(cand, _query_vector(), TOPK, group_cols=["ws"], rank_col="rank")
    return ranked.select("ws", "model", "relpath", "chunk_index", _r6("score").alias("score"),
                         F.col("rank").cast("bigint").alias("rank"))


def _vs_sql(extra: str = "") -> str:
    return f"""WITH {SQL_V_VEC},
m AS (SELECT ws, min(model) AS model FROM v_vec GROUP BY ws),
s AS (SELECT v.*, {_sql_cos('vector', _query_vector())} AS score FROM v_vec v JOIN m USING (ws, model) WHERE TRUE {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY score DESC, id) AS rank FROM s WHERE score IS NOT NULL)
SELECT ws, model, relpath, chunk_index, (round(score, 6) + 0.0) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {TOPK}"""


register("vector_search_ws", _vs_sql())(lambda s, d: _vector_search_ws(s, d))
register("vector_search_files", _vs_sql(
    "AND relpath IN (SELECT DISTINCT 'f' || CAST(doc_id % 50 AS VARCHAR) FROM labels WHERE quality = 1)"))(
    lambda s, d: _vector_search_ws(s, d, V.table(s, d, "labels").filter(F.col("quality") == 1).select(
        F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string")).alias("relpath")).distinct()))


@register("vector_search_file", f"""WITH {sql_v_chunk()}{_sql_chunk_vectors()},
dots AS (SELECT file, chunk_index, sum(v * {_sql_vec(_query_vector())}[b + 1]) AS dot, sqrt(sum(v * v)) AS vn
         FROM v_sparse GROUP BY file, chunk_index),
s AS (SELECT c.*, d.dot / (d.vn * {sum(x * x for x in _query_vector()) ** 0.5!r}) AS score,
             {sql_hex_id('vec', 'c.ws', 'c.id', "('chunk#' || lpad(CAST(c.chunk_index AS VARCHAR), 6, '0'))")} AS cid
      FROM v_chunk c JOIN dots d ON d.file = c.id AND d.chunk_index = c.chunk_index WHERE d.vn > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY ws, relpath ORDER BY score DESC, cid) AS rank FROM s)
SELECT r.ws, r.relpath, CAST(r.chunk_index AS INTEGER) AS chunk_index, r.start, r."end", r.token_count,
       (round(r.score, 6) + 0.0) AS score, CAST(r.rank AS BIGINT) AS rank,
       {_snippet_sql('encode(f.content)', 'r.start', 'r."end"')} AS snippet
FROM r JOIN v_file f ON f.ws = r.ws AND f.relpath = r.relpath WHERE r.rank <= {TOPK_FILE}""")
def _vector_search_file(s: SparkSession, d: str) -> DataFrame:
    # The chunk's bytes are content[start:end] of the same snapshot: the partial window ships at most k chunks per
    # file and task, their snippets are cut after ranking, and the content table is not scanned again.
    vec = V.v_chunk_vectors(s, d, keep_text=True)
    data = F.encode("chunk_text", "UTF-8")
    ranked = vector_search(vec, _query_vector(), TOPK_FILE, group_cols=["ws", "relpath"], rank_col="rank")
    return ranked.select("ws", "relpath", "chunk_index", "start", "end", "token_count", _r6("score").alias("score"),
                         F.col("rank").cast("bigint").alias("rank"),
                         X.snippet(data, F.lit(0), F.octet_length(data)).alias("snippet"))


@register("vector_search_batch", f"""WITH {SQL_V_VEC},
q AS (SELECT item_id, {sql_normalise(sql_hash_embed('text'))} AS qv FROM benchmark),
s AS (SELECT q.item_id, v.id, v.ws, v.relpath, v.chunk_index,
             list_dot_product(v.vector, q.qv) / (sqrt(list_dot_product(v.vector, v.vector)) * sqrt(list_dot_product(q.qv, q.qv))) AS score
      FROM q, v_vec v WHERE list_dot_product(q.qv, q.qv) > 0 AND list_dot_product(v.vector, v.vector) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s)
SELECT item_id, ws, relpath, chunk_index, (round(score, 6) + 0.0) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {TOPK}""")
def _vector_search_batch(s: SparkSession, d: str) -> DataFrame:
    q = embed(V.table(s, d, "benchmark"), HashEmbedder(FIXTURE_DIM), "text", "query_vector").select("item_id", "query_vector")
    res = batch_knn(V.v_vec(s, d), q, TOPK, id_col="id", vec_col="vector", qid_col="item_id",
                    qvec_col="query_vector", carry_cols=["ws", "relpath", "chunk_index"])
    return res.select("item_id", "ws", "relpath", "chunk_index", _r6("score").alias("score"),
                      F.col("rank").cast("bigint").alias("rank"))


# ============================================================================ slice reads
def _slice_requests(f: DataFrame, hex_mode: bool) -> DataFrame:
    start = (F.col("doc_id") % 5) * 100 - 50
    span = (F.when(F.col("doc_id") % 3 == 0, F.lit(SLICE_CHARS + 8000 if not hex_mode else SLICE_CHARS + 9))
            .when(F.col("doc_id") % 3 == 1, F.lit(201)).otherwise(F.lit(-10)))
    if hex_mode:
        start = start + 1
    return f.select("ws", "relpath", "doc_id", start.cast("int").alias("start"), (start + span).cast("int").alias("end"))


def _slice_sql(hex_mode: bool) -> str:
    span = f"CASE WHEN doc_id % 3 = 0 THEN {SLICE_CHARS + (9 if hex_mode else 8000)} WHEN doc_id % 3 = 1 THEN 201 ELSE -10 END"
    st = f"((doc_id % 5) * 100 - 50{' + 1' if hex_mode else ''})"
    clamp = f"""
req AS (SELECT ws, relpath, doc_id, CAST({st} AS INTEGER) AS start, CAST({st} + {span} AS INTEGER) AS "end", content FROM v_file),
c0 AS (SELECT *, greatest(start, 0) AS s0, greatest(greatest("end", 0), greatest(start, 0)) AS e0,
              {"strlen(content) * 2" if hex_mode else "length(content)"} AS total FROM req),
c1 AS (SELECT *, least(s0, total) AS s1, least(e0, total) AS e1 FROM c0),
c2 AS (SELECT *, (e1 - s1) > {SLICE_CHARS} AS truncated,
              CASE WHEN (e1 - s1) > {SLICE_CHARS} THEN s1 + {SLICE_CHARS} ELSE e1 END AS e2 FROM c1)"""
    if hex_mode:
        body = ("substr(lower(hex(encode(content)[s1 // 2 + 1:least((e2 + 1) // 2, strlen(content))])), "
                "CAST(s1 % 2 AS INTEGER) + 1, e2 - s1)")
    else:
        body = "substr(content, s1 + 1, e2 - s1)"
    return f"""WITH {SQL_V_FILE},{clamp}
SELECT ws, relpath, doc_id, start, "end", TRUE AS found,
       {body} || CASE WHEN e2 >= total THEN '<|EOF|>' ELSE '' END || CASE WHEN truncated THEN '. . .truncated' ELSE '' END AS chunk,
       {"TRUE" if hex_mode else "FALSE"} AS hex, truncated
FROM c2"""


register("read_slice", _slice_sql(False))(
    lambda s, d: read_slices(V.v_file(s, d).select("ws", "relpath", "content"),
                             _slice_requests(V.v_file(s, d), False), hex_mode=False, max_chars=SLICE_CHARS))
register("read_slice_hex", _slice_sql(True))(
    lambda s, d: read_slices(V.v_file(s, d).select("ws", "relpath", "content"),
                             _slice_requests(V.v_file(s, d), True), hex_mode=True, max_chars=SLICE_CHARS))

register("file_exists", f"""WITH {SQL_V_FILE}
SELECT l.doc_id, EXISTS (SELECT 1 FROM v_file f WHERE f.ws = 'src' || CAST(l.doc_id % 20 AS VARCHAR)
                                          AND f.relpath = 'src/f' || CAST(l.doc_id AS VARCHAR) || '.PY') AS found
FROM labels l""")(
    lambda s, d: V.table(s, d, "labels").select(
        "doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("ws"),
        F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".PY")).alias("relpath")
    ).join(V.v_file(s, d).select("ws", "relpath", F.lit(True).alias("_hit")), ["ws", "relpath"], "left")
    .select("doc_id", F.coalesce("_hit", F.lit(False)).alias("found")))


# ============================================================================ inventory
register("node_list", f"WITH {SQL_V_NODE} SELECT id, name, kind, ram_gb FROM v_node")(
    lambda s, d: listing.node_list(V.v_node(s, d)).select("id", "name", "kind", "ram_gb"))

register("node_list_kind", f"WITH {SQL_V_NODE} SELECT id, name, kind, ram_gb FROM v_node WHERE kind = 'vm'")(
    lambda s, d: listing.node_list(V.v_node(s, d), kind=" vm ").select("id", "name", "kind", "ram_gb"))

_WS_LIST_SQL = f"""WITH {SQL_V_NODE},{SQL_V_DEN},{SQL_V_WORKSPACE},{SQL_V_DEN_WS},
first_den AS (SELECT out_id AS id, min(in_id) AS den_id FROM v_den_ws GROUP BY out_id),
listed AS (
  SELECT w.id, w.path, w.node AS node_id, n.name AS node_name, f.den_id, d.name AS den_name
  FROM v_workspace w LEFT JOIN v_node n ON n.id = w.node LEFT JOIN first_den f ON f.id = w.id
  LEFT JOIN v_den d ON d.id = f.den_id)"""

register("workspace_list", _WS_LIST_SQL + " SELECT * FROM listed")(
    lambda s, d: listing.workspace_list(V.v_workspace(s, d), V.v_node(s, d), V.v_den(s, d), V.v_den_ws(s, d)))
register("workspace_list_node", _WS_LIST_SQL + """
SELECT n.id AS filter_node, l.* FROM v_node n JOIN listed l ON l.node_id = n.id""")(
    lambda s, d: listing.workspace_list_by_node(V.v_workspace(s, d), V.v_node(s, d), V.v_den(s, d), V.v_den_ws(s, d)))
register("workspace_list_den", _WS_LIST_SQL + """
SELECT m.filter_den, l.* FROM (SELECT DISTINCT in_id AS filter_den, out_id FROM v_den_ws) m JOIN listed l ON l.id = m.out_id""")(
    lambda s, d: listing.workspace_list_by_den(V.v_workspace(s, d), V.v_node(s, d), V.v_den(s, d), V.v_den_ws(s, d)))


def _registrations(s: SparkSession, d: str) -> DataFrame:
    sp = V.table(s, d, "supplier")
    return sp.select(
        F.col("s_nationkey").cast("string").alias("id"), F.col("s_suppkey").alias("seq"),
        F.coalesce(F.nullif(X.go_trim(F.col("s_name")), F.lit("")), F.col("s_nationkey").cast("string")).alias("name"),
        F.when(F.col("s_acctbal") >= 0, F.lit("pc")).alias("kind"),
        F.when(F.col("s_acctbal") >= 1000, (F.col("s_acctbal") / 1000).cast("int")).alias("ram_gb"))


register("node_register", f"""
SELECT id, r.name AS name, r.kind AS kind, r.ram_gb AS ram_gb
FROM (SELECT id, arg_max({{'name': name, 'kind': kind, 'ram_gb': ram_gb}}, seq) AS r
      FROM (SELECT CAST(s_nationkey AS VARCHAR) AS id, s_suppkey AS seq,
                   coalesce(nullif({sql_trim('s_name')}, ''), CAST(s_nationkey AS VARCHAR)) AS name,
                   CASE WHEN s_acctbal >= 0 THEN 'pc' END AS kind,
                   CASE WHEN s_acctbal >= 1000 THEN CAST(trunc(s_acctbal / 1000) AS INTEGER) END AS ram_gb
            FROM supplier) t GROUP BY id) g""")(
    lambda s, d: upsert.latest_per_key(_registrations(s, d), ["id"], ["seq"], ["name", "kind", "ram_gb"]))

register("upsert_replace", f"""WITH {SQL_V_UPSERT}
SELECT user_id, r.event_type AS event_type, r.value AS value, r.props AS props
FROM (SELECT user_id, arg_max({{'event_type': event_type, 'value': value, 'props': props}}, row(ts, event_id)) AS r
      FROM v_upsert GROUP BY user_id) g""")(
    lambda s, d: upsert.latest_per_key(V.v_upsert(s, d), ["user_id"], ["ts", "event_id"], ["event_type", "value", "props"]))

register("upsert_merge", f"""WITH {SQL_V_UPSERT}
SELECT user_id, arg_max(event_type, row(ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type,
       arg_max(value, row(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value,
       arg_max(props, row(ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props
FROM v_upsert GROUP BY user_id""")(
    lambda s, d: upsert.merged_per_key(V.v_upsert(s, d), ["user_id"], ["ts", "event_id"], ["event_type", "value", "props"]))


def _split_upsert(s: SparkSession, d: str, merge: bool) -> DataFrame:
    """Catalog maintenance across two loads: the first half of the month is the stored
    table, the second half the incoming batch."""
    u = V.v_upsert(s, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    old, new = u.filter(F.col("ts") < cut), u.filter(F.col("ts") >= cut)
    fields = ["event_type", "value", "props"]
    if merge:
        base = upsert.merged_per_key(old, ["user_id"], ["ts", "event_id"], fields)
        return upsert.merge_table(base, new, ["user_id"], ["ts", "event_id"], fields)
    base = upsert.latest_per_key(old, ["user_id"], ["ts", "event_id"], fields)
    return upsert.upsert_table(base, new.select("user_id", "ts", "event_id", *fields), ["user_id"], ["ts", "event_id"])


register("upsert_table", f"""WITH {SQL_V_UPSERT}
SELECT user_id, r.event_type AS event_type, r.value AS value, r.props AS props
FROM (SELECT user_id, arg_max({{'event_type': event_type, 'value': value, 'props': props}}, row(ts, event_id)) AS r
      FROM v_upsert GROUP BY user_id) g""")(lambda s, d: _split_upsert(s, d, merge=False))
register("merge_table", f"""WITH {SQL_V_UPSERT}
SELECT user_id, arg_max(event_type, row(ts, event_id)) FILTER (WHERE event_type IS NOT NULL) AS event_type,
       arg_max(value, row(ts, event_id)) FILTER (WHERE value IS NOT NULL) AS value,
       arg_max(props, row(ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props
FROM v_upsert GROUP BY user_id""")(lambda s, d: _split_upsert(s, d, merge=True))


# ============================================================================ edges, checks
register("edges_ws_dir", f"WITH {SQL_V_DIR} SELECT 'ws_contains_dir' AS relation, ws AS in_id, id AS out_id FROM v_dir")(
    lambda s, d: ws_contains_dir(V.v_dir(s, d)))
register("edges_dir_dir", f"""WITH {SQL_V_DIR}
SELECT DISTINCT 'dir_contains_dir' AS relation, {sql_hex_id('dir', 'ws', "regexp_extract(relpath, '^(.*)/[^/]*$', 1)")} AS in_id,
       id AS out_id FROM v_dir WHERE relpath <> ''""")(
    lambda s, d: upsert.distinct_edges(dir_contains_dir(V.v_dir(s, d))))
register("edges_dir_file", f"""WITH {SQL_V_FILE}
SELECT DISTINCT 'dir_contains_file' AS relation, {sql_hex_id('dir', 'ws', "regexp_extract(relpath, '^(.*)/[^/]*$', 1)")} AS in_id,
       id AS out_id FROM v_file""")(
    lambda s, d: upsert.distinct_edges(dir_contains_file(V.v_file(s, d))))


register("check_unique", f"""WITH {SQL_V_DIR},
u AS (
  SELECT 'file' AS table_name, 'unique(ws,relpath)' AS check_name, (SELECT count(*) - count(DISTINCT (ws, relpath)) FROM v_file) AS violations
  UNION ALL SELECT 'file', 'unique(id)', (SELECT count(*) - count(DISTINCT id) FROM v_file)
  UNION ALL SELECT 'directory', 'unique(ws,relpath)', (SELECT count(*) - count(DISTINCT (ws, relpath)) FROM v_dir)
  UNION ALL SELECT 'directory', 'unique(id)', (SELECT count(*) - count(DISTINCT id) FROM v_dir))
SELECT table_name, check_name, CAST(violations AS BIGINT) AS violations FROM u""")(
    lambda s, d: quality.union_reports(
        quality.unique_violations(V.v_file(s, d), "file", ["ws", "relpath"]),
        quality.unique_violations(V.v_file(s, d), "file", ["id"]),
        quality.unique_violations(V.v_dir(s, d), "directory", ["ws", "relpath"]),
        quality.unique_violations(V.v_dir(s, d), "directory", ["id"])))

register("check_asserts", f"""WITH {SQL_V_NODE},{SQL_V_WORKSPACE}
SELECT 'node' AS table_name, 'name <> ''''' AS check_name, CAST(count(*) FILTER (WHERE NOT coalesce(name <> '', FALSE)) AS BIGINT) AS violations FROM v_node
UNION ALL SELECT 'workspace', 'path <> ''''', CAST(count(*) FILTER (WHERE NOT coalesce(path <> '', FALSE)) AS BIGINT) FROM v_workspace
UNION ALL SELECT 'workspace', 'node IS NOT NULL', CAST(count(*) FILTER (WHERE node IS NULL) AS BIGINT) FROM v_workspace""")(
    lambda s, d: quality.union_reports(
        quality.assert_violations(V.v_node(s, d), "node", "name <> ''", F.col("name") != ""),
        quality.assert_violations(V.v_workspace(s, d), "workspace", "path <> ''", F.col("path") != ""),
        quality.assert_violations(V.v_workspace(s, d), "workspace", "node IS NOT NULL", F.col("node").isNotNull())))


@register("acceptance_checks", f"""WITH {sql_v_chunk()},
t AS (SELECT
  (SELECT count(*) FROM v_tree WHERE NOT {SQL_PRUNED}) AS discovered,
  (SELECT count(*) FROM v_file) AS inserted,
  (SELECT count(DISTINCT ws) FROM v_file) AS n_ws,
  (SELECT count(*) FROM v_chunk) AS n_chunks,
  (SELECT count(*) FROM v_chunk c JOIN v_emb f ON c.id = f.id
     WHERE sha256(decode(encode(f.content)[c.start + 1:c."end"])) = c.content_sha) AS sha_ok,
  (SELECT count(*) FROM v_chunk WHERE token_count BETWEEN 1 AND 64) AS tokens_ok)
SELECT * FROM (
  SELECT 'files discovered = inserted' AS check_name, CAST(discovered AS BIGINT) AS expected, CAST(inserted AS BIGINT) AS actual FROM t
  UNION ALL SELECT 'chunk content_sha recomputes', n_chunks, sha_ok FROM t
  UNION ALL SELECT 'chunk token_count in 1..max', n_chunks, tokens_ok FROM t
  UNION ALL SELECT 'workspaces with chunks', n_ws, (SELECT count(DISTINCT ws) FROM v_chunk) FROM t) r""".replace(
    "SELECT * FROM (", "SELECT check_name, expected, actual, expected = actual AS ok FROM ("))
def _acceptance(s: SparkSession, d: str) -> DataFrame:
    tree = V.v_tree(s, d)
    files = V.v_file(s, d)
    chunks = V.v_chunk(s, d, keep_text=False).join(files.select("id", "content"), "id")
    recomputed = F.sha2(F.substring(F.encode("content", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), 256)
    M = quality.measures
    return quality.acceptance_report(
        M(tree, [("files discovered = inserted", "expected", F.sum(F.when(~P.is_pruned_file("relpath"), 1).otherwise(0)))]),
        M(files, [("files discovered = inserted", "actual", F.count(F.lit(1))),
                  ("workspaces with chunks", "expected", F.countDistinct("ws"))]),
        M(chunks, [("chunk content_sha recomputes", "expected", F.count(F.lit(1))),
                   ("chunk content_sha recomputes", "actual", F.sum(F.when(recomputed == F.col("content_sha"), 1).otherwise(0))),
                   ("chunk token_count in 1..max", "expected", F.count(F.lit(1))),
                   ("chunk token_count in 1..max", "actual", F.sum(F.when(F.col("token_count").between(1, 64), 1).otherwise(0))),
                   ("workspaces with chunks", "actual", F.countDistinct("ws"))]),
    )


# ============================================================================ ids, names, remaining edges
register("edges_file_has_vector", f"""WITH {sql_v_chunk()}
SELECT 'file_has_vector' AS relation, id AS in_id, {sql_hex_id('vec', 'ws', 'id', V.sql_chunk_label('chunk_index'))} AS out_id FROM v_chunk""")(
    lambda s, d: edges.file_has_vector(V.v_chunk_vectors(s, d)))

register("edges_workspace_has_vector", f"""WITH {SQL_V_VEC}
SELECT DISTINCT 'workspace_has_vector' AS relation, ws AS in_id, {sql_hex_id('wsv', 'ws', 'model', "'centroid@file'")} AS out_id FROM v_vec""")(
    lambda s, d: edges.workspace_has_vector(centroids(V.v_vec(s, d)).withColumn("id", H.centroid_id("ws", "model"))))

register("edges_on_node", f"""WITH {SQL_V_WORKSPACE}
SELECT 'on_node' AS relation, id AS in_id, node AS out_id FROM v_workspace WHERE node IS NOT NULL""")(
    lambda s, d: edges.on_node(V.v_workspace(s, d)))

register("relative_paths", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url END AS rel FROM pages""")(
    lambda s, d: V.table(s, d, "pages").select("page_id", P.relative_to(
        F.lit("/srv/root//"), F.when(F.col("page_id") % 3 == 0, F.lit("/srv/root"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("/srv/root/"), "url")).otherwise(F.concat(F.lit("/srv/rooted/"), "url"))).alias("rel")))

register("binary_sniff", "SELECT conv_id, turn, conv_id % 3 = 0 AS is_binary FROM conversations")(
    lambda s, d: V.table(s, d, "conversations").select("conv_id", "turn", X.is_binary(F.encode(F.concat(
        F.repeat(F.coalesce("text", F.lit("")), 9), F.when(F.col("conv_id") % 3 == 0, F.lit("\x00")).otherwise(F.lit(""))), "UTF-8")).alias("is_binary")))

register("filter_lists", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'f' || CAST(doc_id % 50 AS VARCHAR) || ',g' ELSE 'g' END AS filters FROM labels""")(
    lambda s, d: V.table(s, d, "labels").select("doc_id", F.array_join(F.sort_array(X.normalize_filters(F.array(
        F.when(F.col("quality") == 1, F.concat(F.lit(" f"), (F.col("doc_id") % 50).cast("string"), F.lit("\t"))).otherwise(F.lit("  ")),
        F.lit("g"), F.lit("\u00a0g "), F.lit("")))), ",").alias("filters")))

register("transform_ids", "SELECT item_id, 'pca@' || substr(sha256(text), 1, 8) AS transform FROM benchmark")(
    lambda s, d: V.table(s, d, "benchmark").select("item_id", H.transform_id("text", "pca").alias("transform")))

register("resolve_model_name", f"""WITH {SQL_V_VEC}
SELECT ws, form, model FROM (SELECT DISTINCT ws, model FROM v_vec) v, (VALUES ('id'), ('name'), ('prefixed')) f(form)""")(
    lambda s, d: _resolved_names(s, d))


def _resolved_names(s: SparkSession, d: str) -> DataFrame:
    """Every model of every workspace, found by its id, by a name that maps to its slug, and by its record id."""
    from quarry.plans.tools import match_model

    models = V.v_vec(s, d).select("ws", "model").distinct()
    forms = F.explode(F.map_from_arrays(F.array(F.lit("id"), F.lit("name"), F.lit("prefixed"), F.lit("none")), F.array(
        F.concat(F.lit("\u00a0"), "model"), F.concat(F.upper("model"), F.lit("_ ")), F.concat(F.lit("vector_model:"), "model"), F.lit("other"))))
    asked = models.select("ws", "model", forms.alias("form", "candidate"))
    return match_model(asked, F.col("candidate")).select("ws", "form", "model")


register("node_register_fields", f"""
SELECT id, r.name AS name, r.os AS os, r.cpu AS cpu, r.labels AS labels
FROM (SELECT id, arg_max({{'name': name, 'os': os, 'cpu': cpu, 'labels': labels}}, seq) AS r
      FROM (SELECT CAST(s_nationkey AS VARCHAR) AS id, s_suppkey AS seq, {sql_trim('s_name')} AS name,
                   CASE WHEN s_suppkey % 2 = 0 THEN 'linux' END AS os, CAST(NULL AS VARCHAR) AS cpu,
                   CASE WHEN s_suppkey % 3 = 0 THEN 'a,' || {sql_trim('s_name')} END AS labels
            FROM supplier) t GROUP BY id) g""")(
    lambda s, d: _registered_fields(s, d))


def _registered_fields(s: SparkSession, d: str) -> DataFrame:
    """Registrations with optional fields and labels, through the rule that the registration tool applies."""
    from quarry.plans.tools import clean_nodes

    r = V.table(s, d, "supplier").select(
        F.concat(F.lit(" "), F.col("s_nationkey").cast("string")).alias("id"), F.concat("s_name", F.lit("\t")).alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(" linux")).otherwise(F.lit(" ")).alias("os"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit(" a "), F.lit(""), F.col("s_name"))).otherwise(F.array(F.lit(" "))).alias("labels"),
        F.col("s_suppkey").alias("seq"))
    return clean_nodes(r).select("id", "name", "os", "cpu", F.array_join("labels", ",").alias("labels"))


def _complete() -> None:
    """Registers the queries of the module that builds on this one."""
    from quarry.plans import index_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _complete()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _complete()
    return dict(ORACLES)
