"""Containment edges derived from catalog tables (pure projections, no joins).

A parent's id is a function of (workspace, parent path), so child -> parent
needs no lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.hashing import dir_id
from quarry.functions.paths import parent_path


SCAN_RELATIONS = ("ws_contains_dir", "dir_contains_dir", "dir_contains_file")
VECTOR_RELATIONS = ("file_has_vector", "workspace_has_vector")


def _edge(df: DataFrame, relation: str, in_col, out_col) -> DataFrame:
    return df.select(F.lit(relation).alias("relation"), in_col.alias("in_id"), out_col.alias("out_id"))


def ws_contains_dir(dirs: DataFrame) -> DataFrame:
    """workspace -> directory, for every directory including the root."""
    return _edge(dirs, "ws_contains_dir", F.col("ws"), F.col("id"))


def dir_contains_dir(dirs: DataFrame, case_fold: bool = True) -> DataFrame:
    """parent directory -> directory, for every non-root directory."""
    d = dirs.filter(F.col("relpath") != "")
    return _edge(d, "dir_contains_dir", dir_id(F.col("ws"), parent_path("relpath"), case_fold), F.col("id"))


def dir_contains_file(files: DataFrame, case_fold: bool = True) -> DataFrame:
    """directory -> file, for every file."""
    return _edge(files, "dir_contains_file", dir_id(F.col("ws"), parent_path("relpath"), case_fold), F.col("id"))


def file_has_vector(chunks: DataFrame) -> DataFrame:
    return _edge(chunks, "file_has_vector", F.col("file"), F.col("id"))


def workspace_has_vector(ws_vectors: DataFrame) -> DataFrame:
    return _edge(ws_vectors, "workspace_has_vector", F.col("ws"), F.col("id"))


def on_node(workspaces: DataFrame) -> DataFrame:
    return _edge(workspaces.filter(F.col("node").isNotNull()), "on_node", F.col("id"), F.col("node"))


def scan_edges(dirs: DataFrame, files: DataFrame, case_fold: bool = True) -> DataFrame:
    """All edges written by a tree scan."""
    return (
        ws_contains_dir(dirs)
        .unionByName(dir_contains_dir(dirs, case_fold))
        .unionByName(dir_contains_file(files, case_fold))
    )
