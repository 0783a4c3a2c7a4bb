"""User-level retrieval tools over a :class:`~quarry.sources.catalog.Catalog`.

Limits are what the caller passes: None means all rows for listings and searches
and five results for a vector search. Blank required arguments are errors. Results are DataFrames; nothing is collected here
except the tiny model-resolution lookups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.constants import MODEL_RECORD_PREFIX, TOPK_DEFAULT
from quarry.functions.text import go_trim, model_slug, normalize_filter_list
from quarry.operators import listing, reading, segments
from quarry.operators.embedding import Embedder, embed
from quarry.operators.knn import vector_search
from quarry.operators.upsert import latest_per_key
from quarry.sources.catalog import Catalog
from quarry.sources.staging import written


def _required(value: str | None, name: str) -> str:
    if value is None or not value.strip():
        raise ValueError(f"{name} is required")
    return value.strip()


# ------------------------------------------------------------------ registration (batch)
def clean_nodes(registrations: DataFrame, order_col: str = "seq") -> DataFrame:
    """The newest registration per id: blank name -> node id; labels trimmed, blanks dropped; absent fields NULL."""
    from quarry.functions.text import clean_labels

    have = set(registrations.columns)

    def opt(c, typ):
        return F.col(c) if c in have else F.lit(None).cast(typ)

    rows = registrations.select(
        go_trim(F.col("id")).alias("id"),
        F.coalesce(F.nullif(go_trim(opt("name", "string")), F.lit("")), go_trim(F.col("id"))).alias("name"),
        *[F.nullif(go_trim(opt(c, "string")), F.lit("")).alias(c) for c in ("kind", "os", "cpu")],
        opt("ram_gb", "int").cast("int").alias("ram_gb"),
        clean_labels(opt("labels", "array<string>")).alias("labels"),
        F.col(order_col).alias("_order"),
    ).filter(F.col("id") != "")
    return latest_per_key(rows, ["id"], ["_order"], ["name", "kind", "os", "cpu", "ram_gb", "labels"])


def register_nodes(catalog: Catalog, registrations: DataFrame, order_col: str = "seq") -> None:
    """Upsert ``node`` rows (replace semantics), so re-registering without ``kind`` clears it."""
    catalog.upsert("node", clean_nodes(registrations, order_col), ["id"])


def register_workspaces(catalog: Catalog, registrations: DataFrame, order_col: str = "seq") -> None:
    """Upsert ``workspace`` rows (path, node; VCS fields reset) and ``on_node`` edges."""
    from quarry.operators.edges import on_node
    r = registrations.select(
        go_trim(F.col("id")).alias("id"), go_trim(F.col("path")).alias("path"), go_trim(F.col("node")).alias("node"),
        F.lit("").alias("vcs"), F.lit("").alias("rev"), F.lit("").alias("content_sha"), F.col(order_col))
    bad = r.filter(F.col("id").isNull() | (F.col("id") == "") | F.col("path").isNull() | (F.col("path") == "") | F.col("node").isNull() | (F.col("node") == "")).limit(1).count()
    if bad:
        raise ValueError("a workspace needs an id, a path and a node")
    latest = latest_per_key(r, ["id"], [order_col], ["path", "node", "vcs", "rev", "content_sha"])
    latest = written(latest, "registrations")
    catalog.upsert("workspace", latest, ["id"])
    catalog.replace_edges(on_node(latest).withColumn("ws", F.col("in_id")), ["on_node"])


# ------------------------------------------------------------------ listings
def list_nodes(catalog: Catalog, kind: str | None = None) -> DataFrame:
    return listing.node_list(catalog.read("node"), kind)


def list_workspaces(catalog: Catalog, node_id: str | None = None, den_id: str | None = None) -> DataFrame:
    edges = catalog.read("edge").filter(F.col("relation") == "den_has_workspace")
    return listing.workspace_list(catalog.read("workspace"), catalog.read("node"), catalog.read("den"), edges,
                                  node_id, den_id)


def workspace_tree(catalog: Catalog, ws: str) -> tuple[DataFrame, DataFrame]:
    ws = _required(ws, "workspaceId")
    return (listing.tree_directories(catalog.read("directory"), ws),
            listing.tree_files(catalog.read("file"), ws))


def find_file(catalog: Catalog, ws: str, query: str, match_type: str | None = None, limit: int | None = None) -> DataFrame:
    ws = _required(ws, "workspaceId")
    return listing.find_file(catalog.read("file"), query, match_type, limit, ws=ws)


def search_text(catalog: Catalog, ws: str, query: str, case_sensitive: bool = False, limit: int | None = None,
                max_file_bytes: int | None = None) -> DataFrame:
    ws = _required(ws, "workspaceId")
    return segments.search_lines(catalog.read("content"), query, case_sensitive, limit, max_file_bytes, ws=ws)


def search_file_text(catalog: Catalog, ws: str, relpath: str, query: str, case_sensitive: bool = False,
                     limit: int | None = None) -> DataFrame:
    ws, rel = _required(ws, "workspaceId"), _required(relpath, "relpath")
    one = catalog.read("content").filter((F.col("ws") == ws) & (F.col("relpath") == rel))
    if one.limit(1).count() == 0:
        raise FileNotFoundError(f"file {rel} not found in workspace {ws}")
    return segments.search_lines(one, query, case_sensitive, limit, ws=ws)


def read_file(catalog: Catalog, ws: str, relpath: str, start: int, end: int, hex_mode: bool = False) -> DataFrame:
    return reading.read_file(catalog.read("content"), _required(ws, "workspaceId"), relpath, start, end, hex_mode)


# ------------------------------------------------------------------ vector search
def match_model(models: DataFrame, candidate) -> DataFrame:
    """Rows of ``models(model)`` that ``candidate`` (a column) names: by id with or without its table prefix, by slug, or by name."""
    name = go_trim(candidate)
    bare = F.when(F.startswith(name, F.lit(MODEL_RECORD_PREFIX)), F.substring(name, len(MODEL_RECORD_PREFIX) + 1, F.char_length(name))).otherwise(name)
    return models.filter((F.col("model") == bare) | (F.col("model") == model_slug(bare)))


def resolve_model(chunks: DataFrame, candidate: str | None = None) -> str:
    """The model to search: the smallest model id present in ``chunks`` (already scoped), or the one that
    ``candidate`` names (id, slug or model name) if it is used there."""
    if candidate is not None and candidate.strip():
        hit = match_model(chunks, F.lit(candidate)).agg(F.min("model")).first()[0]
        if hit is None:
            raise LookupError(f"nothing in this scope was embedded with {candidate!r}")
        return hit
    row = chunks.agg(F.min("model").alias("m")).collect()[0]
    if row["m"] is None:
        raise LookupError("this scope has no embedded chunks")
    return row["m"]


def _query_vector(spark, embedders: dict[str, Embedder] | Embedder, model: str, query: str) -> list[float]:
    emb = embedders.get(model) if isinstance(embedders, dict) else embedders
    if emb is None:
        raise LookupError(f"no embedder for model {model!r}")
    v = embed(spark.createDataFrame([(query,)], "t string"), emb, "t", "v").select("v").first()["v"]
    if not v:
        raise ValueError("the embedder gave no vector for the query")
    return [float(x) for x in v]


def workspace_vector_search(catalog: Catalog, ws: str, query: str, embedders, top_k: int | None = None,
                            model_id: str | None = None, file_filter: Sequence[str] | None = None) -> DataFrame:
    """Top-k chunks of one workspace by cosine similarity (filters applied before ranking)."""
    ws, query = _required(ws, "workspaceId"), _required(query, "query")
    k = TOPK_DEFAULT if top_k is None else top_k
    chunks = catalog.read("vector_chunk").filter(F.col("ws") == ws)
    model = resolve_model(chunks, model_id)
    qv = _query_vector(catalog.spark, embedders, model, query)
    filters = [F.col("model") == model]
    include = normalize_filter_list(list(file_filter or []))
    cand = chunks
    if include:
        inc = catalog.spark.createDataFrame([(p,) for p in include], "relpath string")
        cand = cand.join(inc, "relpath", "left_semi")
    res = vector_search(cand, qv, k, "vector", filters, id_col="id")
    return res.select("score", F.col("relpath").alias("file"), "start", "end",
                      F.col("token_count").alias("tokenCount"), F.col("content_sha").alias("contentSha"))


def file_vector_search(catalog: Catalog, ws: str, relpath: str, query: str, embedders, top_k: int | None = None,
                       model_id: str | None = None) -> DataFrame:
    """Top-k chunks of one file with snippets (content joined after ranking: at most k rows)."""
    ws, rel, query = _required(ws, "workspaceId"), _required(relpath, "relpath"), _required(query, "query")
    k = TOPK_DEFAULT if top_k is None else top_k
    files = catalog.read("file").filter((F.col("ws") == ws) & (F.col("relpath") == rel))
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"file {rel} not found in workspace {ws}")
    chunks = catalog.read("vector_chunk").filter((F.col("ws") == ws) & (F.col("relpath") == rel))
    model = resolve_model(chunks, model_id)
    qv = _query_vector(catalog.spark, embedders, model, query)
    res = vector_search(chunks, qv, k, "vector", [F.col("model") == model], id_col="id")
    out = reading.with_snippets(res.select("ws", "relpath", "id", "score", "start", "end", "token_count", "content_sha"),
                                catalog.read("content").filter((F.col("ws") == ws) & (F.col("relpath") == rel)))
    return out.orderBy(F.col("score").desc(), "id").select("score", F.col("content_sha").alias("contentSha"), "start", "end",
                                                           F.col("token_count").alias("tokenCount"), "snippet")
