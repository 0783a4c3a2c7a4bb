"""Index jobs: scan (inventory), embed (chunk + vectors + centroid), all; with run reports.

Each job is a handful of DataFrame writes into a :class:`~quarry.sources.catalog.Catalog`;
the driver only builds plans and writes the one-row run report.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.constants import CENTROID_KIND, CHUNK_GRANULARITY, MAX_TOKENS_PER_CHUNK
from quarry.functions.hashing import centroid_id, chunk_id, dir_id, file_id, run_id
from quarry.functions.text import model_slug, split_model
from quarry.functions.vectors import norm
from quarry.operators import edges as E
from quarry.operators.centroid import centroids_of, part_of, vector_sums
from quarry.operators.delta import ADDED, CHANGED, REMOVED, SAME, capture, distinct_new
from quarry.operators.embedding import Embedder, embed
from quarry.operators.segments import text_chunks
from quarry.operators.upsert import distinct_edges
from quarry.sources.catalog import Catalog
from quarry.sources.ndjson import write_artifact
from quarry.sources.staging import discard, written
from quarry.sources.tree_scan import list_tree, read_files, stat_entries, with_hashes

STEP_SCAN, STEP_EMBED, STEP_ALL = "index.scan", "index.embed", "index.all"

REPORT_SCHEMA = ("run_id string, step string, started timestamp, finished timestamp, acceptance string, "
                 "artifact_paths array<string>, risks array<string>, notes array<string>")


@dataclass
class RunReport:
    run_id: str
    step: str
    started: _dt.datetime
    finished: _dt.datetime | None = None
    acceptance: str = "fail"
    artifact_paths: list[str] = field(default_factory=list)
    risks: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    discovered_files: int | None = None  # counted on the scan's inventory, not on the catalogue

    def row(self):
        return (self.run_id, self.step, self.started, self.finished, self.acceptance, self.artifact_paths,
                self.risks, self.notes)


def new_run_id(spark: SparkSession, ws: str, step: str, started: _dt.datetime) -> str:
    """``RUN-YYYYMMDD-<8 hex>`` computed by the same expression as the ``run_ids`` query."""
    df = spark.createDataFrame([(ws, step, started)], "ws string, step string, ts timestamp")
    return df.select(run_id("ws", "step", "ts")).first()[0]


def _append_report(catalog: Catalog, report: RunReport) -> None:
    """A run's report is a file of its own: nothing that is stored is read or rewritten."""
    catalog.append("run_report", catalog.spark.createDataFrame([report.row()], REPORT_SCHEMA))


def _validate(root: str, ws: str) -> str:
    if not root or not root.strip():
        raise ValueError("workspaceRoot is required")
    if not ws or not ws.strip():
        raise ValueError("workspaceId is required")
    if not os.path.isdir(root):
        raise ValueError(f"workspace root {root} is not a directory")
    return os.path.abspath(root)


def scan_delta(catalog: Catalog, found: DataFrame, ws: str, full: bool = False) -> DataFrame:
    """(relpath, status) of the files of ``found`` against the stored ones, by size and modification time.

    ``full`` takes every file that is still there as changed.
    """
    files = found.where("kind = 'file'")
    if not catalog.exists("file"):
        return files.select("relpath", F.lit(ADDED).alias("status"))
    stored = catalog.read("file").where(F.col("ws") == ws)
    delta = capture(stored, files, ["relpath"], ["size", "mtime"])
    return delta.withColumn("status", F.when(F.col("status") == SAME, CHANGED).otherwise(F.col("status"))) if full else delta


def index_scan(spark: SparkSession, catalog: Catalog, root: str, ws: str, artifact_root: str,
               case_fold: bool = False, run_id_: str | None = None, full: bool = False) -> RunReport:
    """Bring ``directory``, ``file``, ``content`` and the edges of a workspace up to date with its tree.

    Folders and files are listed anew; only files whose size or modification time differs from the stored one are read
    (all with ``full``), and only the partitions that hold an added, changed or removed path are rewritten.
    """
    root = _validate(root, ws)
    started = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rid = run_id_ or new_run_id(spark, ws, STEP_SCAN, started)
    report = RunReport(rid, STEP_SCAN, started)
    try:
        _scan_into(spark, catalog, root, ws, f"{artifact_root}/{rid}", case_fold, report, full)
        report.acceptance, report.finished = "fail" if report.risks else "pass", _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    except Exception as e:  # noqa: BLE001 - recorded in the report, then raised
        report.risks.append(str(e))
        _append_report(catalog, report)
        raise
    _append_report(catalog, report)
    return report


def _scan_into(spark, catalog: Catalog, root: str, ws: str, run_dir: str, case_fold: bool, report: RunReport, full: bool = False):
    found = stat_entries(list_tree(spark, root), root, ws)
    delta = written(scan_delta(catalog, found, ws, full), "scan-delta")
    seen = found.where("kind = 'file'")
    fresh = seen.join(delta.where(F.col("status").isin(ADDED, CHANGED)), "relpath", "left_semi")
    touched = delta.where(F.col("status") != SAME).select(F.lit(ws).alias("ws"), "relpath")
    # contents are written once, straight from the reader; hashes and errors are read back from there
    catalog.replace_keys("content", read_files(fresh, root, bucket=catalog.bucket("content")), touched, dealt=True)
    rows = written(with_hashes(fresh, catalog.read("content").where(F.col("ws") == ws)), "scan-files")
    unread = rows.where("kind = 'reject'").select("ws", "relpath", "error")
    rejects = found.where("kind = 'reject'").select("ws", "relpath", "error").unionByName(unread)
    files = rows.where("kind = 'file'").select(
        file_id("ws", "relpath", case_fold).alias("id"), "ws", "relpath", "lang", "size", "mtime", "sha")
    # workspace row: merge keeps the node link, resets VCS fields
    ws_row = spark.createDataFrame([(ws, root, None, "", "", "", 0)],
                                   "id string, path string, node string, vcs string, rev string, content_sha string, seq long")
    catalog.merge("workspace", ws_row, ["id"], ["seq"], ["path", "node", "vcs", "rev", "content_sha"])
    catalog.replace_keys("file", files, touched)
    dirs = found.where("kind = 'dir'").select(dir_id("ws", "relpath", case_fold).alias("id"), "ws", "relpath", "sha")
    before = catalog.read("directory").where(F.col("ws") == ws) if catalog.exists("directory") else dirs.limit(0)
    moved = written(capture(before, dirs, ["relpath"], ["sha", "id"]).where(F.col("status") != SAME), "dir-delta")
    new_dirs = written(dirs.join(moved.where(F.col("status") != REMOVED), "relpath", "left_semi"), "new-dirs")
    _scan_edges(catalog, ws, delta, moved, case_fold)
    catalog.replace_keys("directory", new_dirs, moved.select(F.lit(ws).alias("ws"), "relpath"))
    count = {r.status: r["count"] for r in delta.groupBy("status").count().collect()}
    report.notes.append("files: " + ", ".join(f"{count.get(s, 0)} {s}" for s in (SAME, CHANGED, ADDED, REMOVED)))
    n_unread, n_rejects = unread.count(), rejects.count()
    report.discovered_files = seen.count() - n_unread
    if n_rejects:
        report.risks.append(f"{n_rejects} unreadable entries (see rejects artefact)")
        report.artifact_paths.append(write_artifact(rejects, run_dir, "rejects.ndjson"))
    report.artifact_paths.append(write_artifact(catalog.read("file").where(F.col("ws") == ws).select(
        "relpath", "size", "mtime", F.col("sha").alias("hash"), "lang"), run_dir, "files.ndjson"))
    report.artifact_paths.append(write_artifact(
        found.where("kind = 'dir'").select("relpath", F.col("sha").alias("hash"), "mtime"), run_dir, "dirs.ndjson"))


def _scan_edges(catalog: Catalog, ws: str, delta: DataFrame, moved: DataFrame, case_fold: bool) -> None:
    """The edges of added and removed files and folders; an edge depends on its paths only."""
    paths = lambda d, status, make: d.where(F.col("status") == status).select(
        make(F.lit(ws), F.col("relpath"), case_fold).alias("id"), F.lit(ws).alias("ws"), "relpath")
    new = E.scan_edges(paths(moved, ADDED, dir_id), paths(delta, ADDED, file_id), case_fold)
    gone = E.scan_edges(paths(moved, REMOVED, dir_id), paths(delta, REMOVED, file_id), case_fold)
    _replace_edges(catalog, ws, new, gone)


def _replace_edges(catalog: Catalog, ws: str, new: DataFrame, gone: DataFrame) -> None:
    new = distinct_edges(new).withColumn("ws", F.lit(ws))
    keys = new.select("ws", "relation", "out_id").unionByName(gone.select(F.lit(ws).alias("ws"), "relation", "out_id"))
    catalog.replace_keys("edge", new, keys)


def _check_acceptance(catalog: Catalog, ws: str, report: RunReport) -> None:
    """Run the workspace acceptance checks; a failed check fails the run (rows: one per check)."""
    from quarry.operators.quality import catalog_checks, workspace_acceptance

    for r in workspace_acceptance(catalog, ws, report.discovered_files).collect():
        report.notes.append(f"{r.check_name}: {r.actual}/{r.expected}")
        if not r.ok:
            report.risks.append(f"acceptance check failed: {r.check_name}")
    # schema constraints of this workspace's rows (e.g. ids colliding under case folding)
    scoped = {t: catalog.read(t).filter(F.col("ws") == ws) for t in ("directory", "file", "vector_chunk")}
    for r in catalog_checks(scoped).filter(F.col("violations") > 0).collect():
        report.risks.append(f"constraint {r.table_name}.{r.check_name}: {r.violations} violations")


def index_embed(spark: SparkSession, catalog: Catalog, ws: str, embedder: Embedder, model_name: str,
                artifact_root: str, max_tokens: int = MAX_TOKENS_PER_CHUNK, model_sha: str = "",
                effective_dim: int | None = None, transform_id_: str = "", case_fold: bool = False,
                run_id_: str | None = None, full: bool = False) -> RunReport:
    """Bring ``vector_chunk``, ``vector_model`` and ``workspace_vector`` up to date with a scanned workspace.

    Only files whose content, or whose embedding settings, differ from what the model embedded last are cut
    again (all with ``full``). Each distinct new chunk is embedded once; vectors of contents that the model has
    embedded before are carried over. Surplus chunks of changed and removed files go.
    """
    started = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rid = run_id_ or new_run_id(spark, ws, STEP_EMBED, started)
    report = RunReport(rid, STEP_EMBED, started)
    try:
        _embed_into(spark, catalog, ws, embedder, model_name, f"{artifact_root}/{rid}", max_tokens, model_sha,
                    effective_dim, transform_id_, case_fold, report, full)
        _check_acceptance(catalog, ws, report)
        report.acceptance = "fail" if report.risks else "pass"
        report.finished = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    except Exception as e:  # noqa: BLE001
        report.risks.append(str(e))
        _append_report(catalog, report)
        raise
    _append_report(catalog, report)
    return report


def _embed_into(spark, catalog, ws, embedder, model_name, run_dir, max_tokens, model_sha, effective_dim,
                transform_id_, case_fold, report, full=False):
    slug_row = spark.createDataFrame([(model_name,)], "m string").select(
        model_slug("m").alias("slug"), split_model("m").alias("fv")).first()
    slug, family, version = slug_row["slug"], slug_row["fv"]["family"], slug_row["fv"]["version"]
    now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    files = catalog.read("file").where(F.col("ws") == ws)
    here = (F.col("ws") == ws) & (F.col("model") == slug)
    # what this model has embedded, and with which contents and settings
    state = files.select("relpath", F.lit(max_tokens).alias("max_tokens"), F.lit(model_sha).alias("model_sha"), F.lit(transform_id_).alias("transform_id"), "sha")
    done = catalog.read("embedded_file").where(here) if catalog.exists("embedded_file") else state.limit(0)
    delta = capture(done, state, ["relpath"], ["sha", "max_tokens", "model_sha", "transform_id"])
    if full:
        delta = delta.withColumn("status", F.when(F.col("status") == SAME, CHANGED).otherwise(F.col("status")))
    delta = written(delta.where(F.col("status") != SAME), "embed-delta")
    fresh = delta.where(F.col("status") != REMOVED)
    content = catalog.read("content").where(F.col("ws") == ws).join(fresh, "relpath", "left_semi")
    cut = text_chunks(content, ("ws", "relpath"), max_tokens)
    cut = written(cut.withColumn("file", file_id("ws", "relpath", case_fold)), "new-chunks")
    stored = catalog.read("vector_chunk").where(F.col("model") == slug) if catalog.exists("vector_chunk") else None
    known = spark.createDataFrame([], "content_sha string, vector array<float>")
    if stored is not None and not full:  # vectors of equal contents are carried over, from any workspace
        same = stored.where(F.col("model_sha") == model_sha).join(cut.select("content_sha").distinct(), "content_sha", "left_semi")
        known = same.groupBy("content_sha").agg(F.first("vector").alias("vector"))
    known = written(known, "known-vectors")
    new = written(embed(distinct_new(cut, known), embedder, "chunk_text").select("content_sha", "vector"), "new-vectors")
    report.notes.append(f"chunks: {cut.count()} cut, {new.count()} embedded, {known.count()} contents carried over")
    vecs = cut.drop("chunk_text").join(known.unionByName(new), "content_sha").select(
        chunk_id("ws", F.col("file"), "chunk_index", case_fold).alias("id"), "ws", "file", "relpath",
        F.lit(None).cast("string").alias("symbol"), F.lit(CHUNK_GRANULARITY).alias("granularity"),
        "chunk_index", "start", "end", "token_count", "content_sha", F.lit(slug).alias("model"),
        F.lit(model_sha).alias("model_sha"), F.size("vector").alias("native_dim"),
        F.lit(effective_dim if effective_dim is not None else embedder.dim).cast("int").alias("effective_dim"),
        F.lit(transform_id_).alias("transform_id"), "vector", F.lit(now).alias("ts"),
        norm("vector").alias("norm"))  # stored once, so a search is one dot product per chunk
    touched = delta.select(F.lit(ws).alias("ws"), "relpath", F.lit(slug).alias("model"))
    old_ids, none_before = vecs.limit(0).select("id"), stored is None
    if not none_before:
        old_ids = written(stored.where(F.col("ws") == ws).join(touched.select("relpath"), "relpath", "left_semi").select("id"), "old-chunks")
    # vectors are stored once, in the catalogue, and read back from there
    catalog.replace_keys("vector_chunk", vecs, touched)
    discard(cut, new, known)
    stored = catalog.read("vector_chunk").where(here)
    vecs = stored if none_before else stored.join(touched.select("relpath"), "relpath", "left_semi")
    if stored.limit(1).count() == 0:
        raise RuntimeError(f"workspace {ws} holds no file that can be embedded")
    _refresh_sums(catalog, ws, slug, stored, touched)
    cents = centroids_of(catalog.read("vector_sum").where(here))
    native = cents.select("native_dim").first()["native_dim"]
    model_row = spark.createDataFrame(
        [(slug, family, version, int(native), model_sha, "generated by quarry")],
        "id_slug string, family string, version string, native_dim int, model_sha string, notes string")
    catalog.upsert("vector_model", model_row, ["id_slug"])
    wsv = written(cents.select(
        centroid_id("ws", "model", case_fold).alias("id"), "ws", F.lit(CENTROID_KIND).alias("kind"), "model",
        F.col("centroid").cast("array<float>").alias("vector"), F.col("sample").cast("int").alias("sample"),
        F.lit(now).alias("ts")), "centroids")
    catalog.upsert("workspace_vector", wsv, ["ws", "kind", "model"])
    edge = lambda ids: ids.select(F.lit("file_has_vector").alias("relation"), F.col("id").alias("out_id"))
    _replace_edges(catalog, ws, E.file_has_vector(vecs).unionByName(E.workspace_has_vector(wsv)), edge(old_ids))
    # last, so that a run that stops before is done again
    catalog.replace_keys("embedded_file", state.join(fresh, "relpath", "left_semi").select(F.lit(ws).alias("ws"), F.lit(slug).alias("model"), *state.columns), touched)
    report.artifact_paths.append(write_artifact(
        vecs.select("relpath", F.col("chunk_index").alias("index"), "start", "end", "token_count", "content_sha",
                    (F.col("end") - F.col("start")).alias("size"), "vector", "native_dim"),
        run_dir, "vectors.ndjson", "gzip"))  # as text, vectors are the largest of all that a run writes


def _refresh_sums(catalog: Catalog, ws: str, slug: str, stored: DataFrame, touched: DataFrame) -> None:
    """Vector sums of the parts that hold a touched file; the other parts' sums stay as they are."""
    part = lambda df: df.withColumn("part", part_of("relpath"))
    parts = written(part(touched).select("ws", "part", "model").distinct(), "sum-parts")
    rows = part(stored).join(parts.select("part"), "part", "left_semi")
    catalog.replace_keys("vector_sum", written(vector_sums(rows, ("ws", "model", "part")), "vector-sums"), parts)


def index_all(spark: SparkSession, catalog: Catalog, root: str, ws: str, embedder: Embedder, model_name: str,
              artifact_root: str, **kw) -> RunReport:
    """Scan, then embed, under one run id."""
    root = _validate(root, ws)
    started = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rid = kw.pop("run_id_", None) or new_run_id(spark, ws, STEP_ALL, started)
    report = RunReport(rid, STEP_ALL, started)
    run_dir = f"{artifact_root}/{rid}"
    case_fold, full = kw.get("case_fold", False), kw.get("full", False)
    try:
        _scan_into(spark, catalog, root, ws, run_dir, case_fold, report, full)
    except Exception as e:  # noqa: BLE001
        report.risks.append(f"scan failed: {e}")
        _append_report(catalog, report)
        raise
    try:
        _embed_into(spark, catalog, ws, embedder, model_name, run_dir, kw.get("max_tokens", MAX_TOKENS_PER_CHUNK),
                    kw.get("model_sha", ""), kw.get("effective_dim"), kw.get("transform_id_", ""), case_fold, report, full)
    except Exception as e:  # noqa: BLE001
        report.risks.append(f"embedding failed: {e}")
        _append_report(catalog, report)
        raise
    try:
        _check_acceptance(catalog, ws, report)
    except Exception as e:  # noqa: BLE001
        report.risks.append(f"acceptance checks failed: {e}")
        raise
    finally:
        report.acceptance = "fail" if report.risks else "pass"
        report.finished = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        _append_report(catalog, report)
    return report
