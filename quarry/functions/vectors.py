"""Vector expressions over ``array<float>`` columns, evaluated in the JVM in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector_literal(values: Sequence[float]) -> Column:
    """A query vector as an ``array<double>`` literal (bounded by the model dimension)."""
    return F.array(*[F.lit(float(v)).cast("double") for v in values])


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(a) -> Column:
    return F.sqrt(
        F.aggregate(_col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(a, b) -> Column:
    """Cosine similarity (= 1 - cosine distance); NULL when a norm is zero or sizes differ."""
    a, b = _col(a), _col(b)
    denom = norm(a) * norm(b)
    sim = F.try_divide(dot(a, b), F.when(denom != 0, denom))
    return F.when(F.size(a) == F.size(b), sim)


def cosine_to_query(vec, query: Sequence[float], norm_col=None) -> Column:
    """Cosine similarity against a literal query; the query norm is folded on the driver.

    ``norm_col`` names a stored vector norm (written at index time), so scoring is one dot product.
    """
    q = [float(x) for x in query]
    qn = sum(x * x for x in q) ** 0.5
    if qn == 0:
        return F.lit(None).cast("double")
    v = _col(vec)
    vn = _col(norm_col) if norm_col is not None else norm(v)
    sim = F.try_divide(dot(v, vector_literal(q)), F.when(vn != 0, vn * F.lit(qn)))
    return F.when(F.size(v) == len(q), sim)


def to_double_array(vec) -> Column:
    return _col(vec).cast("array<double>")
