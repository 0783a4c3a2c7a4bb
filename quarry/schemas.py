"""The catalogue's data model: table schemas (DDL), unique keys and row assertions.

Ids are strings; links between tables are id columns (``ws`` -> workspace,
``file`` -> file, ``model`` -> vector_model); edges are ``(relation, in_id,
out_id)`` rows partitioned by workspace and relation.
"""

from __future__ import annotations

# --- fixed values: catalogue tables --------------------------------------------------------
SCHEMAS = {
    "node": "id string, name string, kind string, os string, cpu string, ram_gb int, labels array<string>",
    "den": "id string, code string, name string, address string, "
           "geo struct<lat:double,lon:double,alt:double>, `desc` string, tags array<string>, inventory map<string,string>",
    "workspace": "id string, path string, node string, vcs string, rev string, content_sha string",
    "directory": "id string, ws string, relpath string, sha string",
    "file": "id string, ws string, relpath string, lang string, size bigint, mtime timestamp, sha string",
    "content": "ws string, relpath string, sha string, error string, segment int, at bigint, token_base bigint, line_base bigint, mid_line boolean, "
               "is_last boolean, size bigint, content binary",
    "vector_model": "id_slug string, family string, version string, native_dim int, model_sha string, notes string",
    "vector_chunk": "id string, ws string, file string, relpath string, symbol string, granularity string, "
                    "chunk_index int, start bigint, end bigint, token_count int, content_sha string, model string, "
                    "model_sha string, native_dim int, effective_dim int, transform_id string, vector array<float>, "
                    "ts timestamp, norm double",
    "workspace_vector": "id string, ws string, kind string, model string, vector array<float>, sample int, ts timestamp",
    "edge": "relation string, in_id string, out_id string, ws string",
    # bookkeeping of the index jobs: what a model embedded, and sums of its vectors by part
    "embedded_file": "ws string, relpath string, model string, max_tokens int, model_sha string, transform_id string, sha string",
    "vector_sum": "ws string, model string, part int, native_dim int, sample bigint, vector_sum array<double>, "
                  "first struct<p:array<string>,i:int>",
    "run_report": "run_id string, step string, started timestamp, finished timestamp, acceptance string, "
                  "artifact_paths array<string>, risks array<string>, notes array<string>",
}

#: The column whose hash picks a row's partition (see ``sources/catalog.py``).
BUCKET_COLUMNS = {
    "node": "id", "den": "id", "workspace": "id", "directory": "relpath", "file": "relpath", "content": "relpath",
    "vector_model": "id_slug", "vector_chunk": "relpath", "workspace_vector": "model", "edge": "out_id", "run_report": "run_id",
    "embedded_file": "relpath", "vector_sum": "part",
}

UNIQUE_KEYS = {
    "node": [["name"]],
    "workspace": [["node", "path"]],
    "directory": [["ws", "relpath"], ["id"]],
    "file": [["ws", "relpath"], ["id"]],
    "vector_model": [["id_slug"]],
    "vector_chunk": [["ws", "file", "granularity", "start", "end", "model"]],
    "workspace_vector": [["ws", "kind", "model"]],
    "edge": [["relation", "in_id", "out_id"]],
}

# SQL predicates every row must satisfy
ASSERTS = {
    "node": ["name <> ''"],
    "workspace": ["path <> ''", "node IS NOT NULL"],
    "directory": ["ws IS NOT NULL"],
    "file": ["ws IS NOT NULL"],
    "vector_model": ["id_slug <> ''"],
}

# (table, column, table it refers to, column there): every filled link names a row
LINKS = [
    ("workspace", "node", "node", "id"), ("directory", "ws", "workspace", "id"), ("file", "ws", "workspace", "id"),
    ("content", "ws", "workspace", "id"), ("vector_chunk", "ws", "workspace", "id"), ("vector_chunk", "file", "file", "id"),
    ("vector_chunk", "model", "vector_model", "id_slug"), ("workspace_vector", "ws", "workspace", "id"),
    ("workspace_vector", "model", "vector_model", "id_slug"),
]

# relation: (table of in_id, column), (table of out_id, column)
EDGE_LINKS = {
    "on_node": (("workspace", "id"), ("node", "id")),
    "den_has_workspace": (("den", "id"), ("workspace", "id")),
    "ws_contains_dir": (("workspace", "id"), ("directory", "id")),
    "dir_contains_dir": (("directory", "id"), ("directory", "id")),
    "dir_contains_file": (("directory", "id"), ("file", "id")),
    "file_has_vector": (("file", "id"), ("vector_chunk", "id")),
    "workspace_has_vector": (("workspace", "id"), ("workspace_vector", "id")),
}
