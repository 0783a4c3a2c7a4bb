"""NDJSON text source (corpus for PCA fitting) and NDJSON artefact sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str, max_texts: int | None = None) -> DataFrame:
    """``text`` of every line whose JSON object has a non-empty *string* ``text``.

    Malformed lines and non-string ``text`` values are skipped (no coercion of
    numbers to strings); all are read unless ``max_texts`` asks for that
    many (any of them: a distributed read has no file order). No line-length limit.
    """
    lines = spark.read.text(path)
    v = F.try_parse_json(F.col("value"))
    field = F.variant_get(v, "$.text", "variant")
    texts = lines.select(
        F.when(F.schema_of_variant(field) == "STRING", F.variant_get(v, "$.text", "string")).alias("text")
    ).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    if max_texts is not None:
        texts = texts.limit(int(max_texts))
    return texts


def write_artifact(df: DataFrame, run_dir: str, name: str, compression: str = "none") -> str:
    """Write ``df`` as NDJSON under ``run_dir/name`` (a directory of part files), replacing it."""
    path = f"{run_dir.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path, compression=compression)
    return path
