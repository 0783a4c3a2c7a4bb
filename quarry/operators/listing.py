"""Inventory listings: nodes, workspaces, workspace trees and path search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.paths import leaf_name, parent_path

MATCH_TYPES = ("exact", "prefix", "suffix", "substring")


def first_n(df: DataFrame, n: int | None, order: Sequence[Column], group_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in ``order`` overall (``TakeOrderedAndProject``) or per group.

    Per group, ``row_number() <= n`` is planned with a map-side ``WindowGroupLimit``:
    a hot group sends at most ``n`` rows per task through the shuffle. ``None`` keeps every row.
    """
    if n is None:
        return df.orderBy(*(group_cols or ()), *order)
    if n < 1:
        raise ValueError("a limit is a positive number, or None for all rows")
    if not group_cols:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def node_list(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Nodes ordered by name; ``kind`` filters when given."""
    df = nodes if not kind else nodes.filter(F.col("kind") == kind.strip())
    return df.select("id", "name", "kind", "os", "cpu", "ram_gb", "labels").orderBy("name", "id")


def _first_den(den_edges: DataFrame, dens: DataFrame) -> DataFrame:
    """One den per workspace (smallest den id), with its name."""
    first = den_edges.groupBy(F.col("out_id").alias("ws_id")).agg(F.min("in_id").alias("den_id"))
    return first.join(dens.select(F.col("id").alias("den_id"), F.col("name").alias("den_name")), "den_id", "left")


def workspace_list(workspaces: DataFrame, nodes: DataFrame, dens: DataFrame, den_edges: DataFrame,
                   node_id: str | None = None, den_id: str | None = None) -> DataFrame:
    """Workspaces with node name and first den, ordered by path; optional node / den filters."""
    ws = workspaces
    if node_id and node_id.strip():
        ws = ws.filter(F.col("node") == node_id.strip())
    if den_id and den_id.strip():
        members = den_edges.filter(F.col("in_id") == den_id.strip()).select(F.col("out_id").alias("id"))
        ws = ws.join(members, "id", "left_semi")
    return _decorate(ws, nodes, dens, den_edges).orderBy("path", "id")


def _decorate(ws: DataFrame, nodes: DataFrame, dens: DataFrame, den_edges: DataFrame) -> DataFrame:
    node_names = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("node_name"))
    out = (
        ws.select("id", "path", F.col("node").alias("node_id"))
        .join(node_names, "node_id", "left")
        .join(_first_den(den_edges, dens).withColumnRenamed("ws_id", "id"), "id", "left")
    )
    return out.select("id", "path", "node_id", "node_name", "den_id", "den_name")


def workspace_list_by_node(workspaces: DataFrame, nodes: DataFrame, dens: DataFrame,
                           den_edges: DataFrame) -> DataFrame:
    """The node-filtered listing evaluated for every node at once (``filter_node``)."""
    listed = _decorate(workspaces, nodes, dens, den_edges)
    return nodes.select(F.col("id").alias("filter_node")).join(
        listed, F.col("filter_node") == F.col("node_id"), "inner"
    )


def workspace_list_by_den(workspaces: DataFrame, nodes: DataFrame, dens: DataFrame,
                          den_edges: DataFrame) -> DataFrame:
    """The den-filtered listing evaluated for every den at once (``filter_den``)."""
    listed = _decorate(workspaces, nodes, dens, den_edges)
    members = den_edges.select(F.col("in_id").alias("filter_den"), F.col("out_id").alias("id")).distinct()
    return members.join(listed, "id", "inner")


def tree_directories(dirs: DataFrame, ws: str | None = None) -> DataFrame:
    """Directory entries with name and parent, ordered by path; exactly one root row per workspace."""
    d = dirs if ws is None else dirs.filter(F.col("ws") == ws)
    entries = d.select("ws", "relpath", leaf_name("relpath").alias("name"), parent_path("relpath").alias("parent"),
                       F.col("sha"))
    rootless = d.groupBy("ws").agg(F.max(F.col("relpath") == "").alias("has_root")).filter(~F.col("has_root"))
    roots = rootless.select("ws", F.lit("").alias("relpath"), F.lit("/").alias("name"), F.lit("").alias("parent"),
                            F.lit(None).cast("string").alias("sha"))
    return entries.unionByName(roots).orderBy("ws", "relpath")


def tree_files(files: DataFrame, ws: str | None = None) -> DataFrame:
    """File entries with name and directory, ordered by path."""
    f = files if ws is None else files.filter(F.col("ws") == ws)
    return f.select(
        "ws", "relpath", leaf_name("relpath").alias("name"), parent_path("relpath").alias("directory"),
        "lang", "size", "mtime", "sha",
    ).orderBy("ws", "relpath")


def path_predicate(query: str, match_type: str | None = "substring") -> Column:
    """Case-sensitive literal path match (never a LIKE pattern)."""
    mt = (match_type or "").strip().lower() or "substring"
    q = query.strip()
    if not q:
        raise ValueError("query is required")
    rel = F.col("relpath")
    if mt == "exact":
        return rel == F.lit(q)
    if mt == "prefix":
        return F.startswith(rel, F.lit(q))
    if mt == "suffix":
        return F.endswith(rel, F.lit(q))
    if mt == "substring":
        return F.contains(rel, F.lit(q))
    raise ValueError(f"no such way to match a path: {match_type!r}")


def find_file(files: DataFrame, query: str, match_type: str | None = "substring", limit: int | None = None,
              ws: str | None = None) -> DataFrame:
    """Files whose path matches, ordered by path, at most ``limit`` of them when given (per workspace when ``ws`` is None)."""
    df = files.filter(path_predicate(query, match_type))
    if ws is not None:
        df = df.filter(F.col("ws") == ws.strip())
        return first_n(df.select("ws", "relpath", "lang", "size", "sha"), limit, [F.col("relpath")])
    return first_n(df.select("ws", "relpath", "lang", "size", "sha"), limit, [F.col("relpath")], ["ws"])
