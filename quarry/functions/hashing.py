"""Content hashes and deterministic record ids.

Hash values use SHA-256 (built into Spark); equality structure matches the
indexer's, hash values do not (it uses BLAKE3).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.constants import CENTROID_KIND, CHUNK_ID_LABEL, ID_HEX_CHARS, RUN_ID_HEX_CHARS
from quarry.functions.text import go_trim


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_sha(content) -> Column:
    """Hex SHA-256 of file bytes (binary) or of the UTF-8 bytes of a string."""
    return F.sha2(_col(content), 256)


def path_sha(path) -> Column:
    """Directory 'hash': the hash of the directory's path string."""
    return F.sha2(_col(path), 256)


def hex_id(prefix: str, *parts, case_fold: bool = True) -> Column:
    """``prefix-`` + 20 hex chars of the hash of the trimmed parts joined by ``|``.

    ``case_fold=True`` lower-cases each part (the indexer's rule, which makes
    ``README.md`` and ``readme.md`` collide); pass False to keep case.
    """
    cleaned = []
    for p in parts:
        c = go_trim(_col(p))
        cleaned.append(F.lower(c) if case_fold else c)
    digest = F.sha2(F.concat_ws("|", *cleaned), 256)
    return F.concat(F.lit(prefix + "-"), F.substring(digest, 1, ID_HEX_CHARS))


def file_id(ws, relpath, case_fold: bool = True) -> Column:
    return hex_id("file", ws, relpath, case_fold=case_fold)


def dir_id(ws, relpath, case_fold: bool = True) -> Column:
    return hex_id("dir", ws, relpath, case_fold=case_fold)


def chunk_label(chunk_index, label: str = CHUNK_ID_LABEL) -> Column:
    """``chunk#000042``; indexes of a million and more keep all their digits."""
    i = _col(chunk_index)
    s = i.cast("string")
    return F.concat(F.lit(label + "#"), F.when(i < 1_000_000, F.lpad(s, 6, "0")).otherwise(s))


def chunk_id(ws, file_id_col, chunk_index, case_fold: bool = True) -> Column:
    return hex_id("vec", ws, file_id_col, chunk_label(chunk_index), case_fold=case_fold)


def centroid_id(ws, model_slug, case_fold: bool = True) -> Column:
    return hex_id("wsv", ws, model_slug, F.lit(CENTROID_KIND), case_fold=case_fold)


def rfc3339_nano(ts) -> Column:
    """UTC timestamp as RFC 3339 with the fraction's trailing zeros removed (``...05.25Z``)."""
    t = _col(ts)
    frac = F.regexp_replace(F.date_format(t, "SSSSSS"), "0+$", "")
    return F.concat(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
        F.lit("Z"),
    )


def run_id(ws, step, started) -> Column:
    """``RUN-YYYYMMDD-<8 hex>`` from workspace, step and start time."""
    digest = F.sha2(F.concat_ws("|", _col(ws), _col(step), rfc3339_nano(started)), 256)
    return F.concat(
        F.lit("RUN-"), F.date_format(_col(started), "yyyyMMdd"), F.lit("-"), F.substring(digest, 1, RUN_ID_HEX_CHARS)
    )


def transform_id(model_json, name: str) -> Column:
    """``<name>@<8 hex>``: first four bytes of the SHA-256 of a serialised transform."""
    return F.concat(F.lit(name + "@"), F.substring(F.sha2(_col(model_json), 256), 1, 8))
