"""Change capture between two states of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAME, CHANGED, ADDED, REMOVED = "same", "changed", "added", "removed"


def capture(old: DataFrame, new: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """(keys, status): whether each key of ``old`` or ``new`` is same, changed (in a ``compare`` column), added or removed.

    One full outer join on the keys, of keys and compared columns only; NULLs compare equal.
    """
    was = old.select(*keys, F.struct(*[F.col(c) for c in compare]).alias("_was"))
    now = new.select(*keys, F.struct(*[F.col(c) for c in compare]).alias("_now"))
    status = (F.when(F.col("_was").isNull(), ADDED).when(F.col("_now").isNull(), REMOVED)
              .when(F.col("_was").eqNullSafe(F.col("_now")), SAME).otherwise(CHANGED))
    return was.join(now, list(keys), "full_outer").select(*keys, status.alias("status"))


def distinct_new(rows: DataFrame, known: DataFrame, sha_col: str = "content_sha", text_col: str = "chunk_text") -> DataFrame:
    """(sha, text): each distinct content of ``rows`` that ``known(sha)`` lacks, once."""
    want = rows.groupBy(sha_col).agg(F.first(text_col).alias(text_col))
    return want.join(known.select(sha_col), sha_col, "left_anti")
