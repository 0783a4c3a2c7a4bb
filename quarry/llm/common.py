"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_root, ship_package

#: White space of the word rules (code points 32 and 9-13), for trims and regular expressions.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder that every executor sees."""
    return f"{checkpoint_root(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs restart from the files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores appended until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words_column(text):
    """``[^\\x20\\x09-\\x0D]+`` words of a text column as an array (empty for NULL).

    Literal replacements and a one-character split stay on the JVM's fast paths (no regular expression).
    """
    plain = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer's file on this machine: a path as it is, a bare name in the package of public tokenizers.

    Called in tasks, so that each executor finds its own copy of the package.
    """
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """Return freed memory to the system: a task's worker stays for later tasks, whose memory would come on top of it.

    Arrow's pool and the C library both keep what Python has freed; the latter's call is missing outside of glibc.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def prepare(spark: SparkSession) -> None:
    """Called by every operator that runs Python on executors."""
    ship_package(spark)
