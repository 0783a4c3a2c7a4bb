"""Path expressions over relative-path columns (``/`` separated, root = ``''``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.constants import LANGUAGE_BY_EXTENSION, LANGUAGE_NO_EXTENSION, SKIP_DIR_NAMES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path) -> Column:
    """Suffix from the last ``.`` of the last path element, lower-cased; ``''`` if none."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./]*)$", 1))


def detect_language(path) -> Column:
    """Language hint from the extension; ``text`` without one, else the extension minus its dot."""
    ext = extension(path)
    lang_map = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return (
        F.when(ext == "", F.lit(LANGUAGE_NO_EXTENSION))
        .otherwise(F.coalesce(F.try_element_at(lang_map, ext), F.substring(ext, 2, F.char_length(ext))))
    )


def parent_path(relpath) -> Column:
    """Parent directory of a relative path; ``''`` for top-level entries and the root."""
    return F.regexp_extract(_col(relpath), r"^(.*)/[^/]*$", 1)


def leaf_name(relpath) -> Column:
    """Last path element, ``/`` for the root."""
    p = _col(relpath)
    return F.when(p == "", F.lit("/")).otherwise(F.element_at(F.split(p, "/"), -1))


def dir_parts(relpath) -> Column:
    """Directory elements of a file path (all elements but the last)."""
    parts = F.split(_col(relpath), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def has_skipped_dir(dirs: Column) -> Column:
    """True if any element of an array of directory names is pruned by the scan."""
    skip = F.array(*[F.lit(s) for s in SKIP_DIR_NAMES])
    return F.exists(dirs, lambda x: F.array_contains(skip, F.lower(x)))


def is_pruned_file(relpath) -> Column:
    """True if a file lies below a pruned directory."""
    return has_skipped_dir(dir_parts(relpath))


def ancestors(relpath) -> Column:
    """Array of ancestor directories of a file path, nearest last (``a``, ``a/b`` for ``a/b/f``)."""
    parts = F.split(_col(relpath), "/")
    n = F.size(parts)
    return F.when(n <= 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    )


def relative_to(root, path) -> Column:
    """Path relative to ``root`` with ``/`` separators; the root itself maps to ``''``."""
    r = F.regexp_replace(_col(root), "/+$", "")
    p = _col(path)
    return (
        F.when(p == r, F.lit(""))
        .when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.length(p)))
        .otherwise(F.lit(None).cast("string"))
    )


def walk_order_key(relpath) -> Column:
    """Sort key reproducing a depth-first, name-ordered directory walk."""
    return F.split(_col(relpath), "/")
