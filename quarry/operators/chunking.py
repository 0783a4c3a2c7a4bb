"""Token chunker (text -> rows of contiguous, token-bounded chunks) and line splitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.constants import MAX_TOKENS_PER_CHUNK, TOKEN_PATTERN
from quarry.functions.text import as_text


#: Chunks whose lengths are summed together before single chunks are.
_BLOCK = 128


def _starts(lens: Column) -> Column:
    """Running sum ahead of each element: block totals first, then inside the block, so the work stays near linear."""
    add = lambda a, x: a + x
    zero = F.lit(0).cast("bigint")
    n_blocks = F.ceil(F.size(lens) / _BLOCK).cast("int")
    totals = F.transform(F.sequence(F.lit(0), F.greatest(n_blocks - 1, F.lit(0))),
                         lambda b: F.aggregate(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))
    # one-element arrays bind what the inner lambdas use more than once
    return F.flatten(F.transform(F.array(totals), lambda t: F.flatten(F.transform(
        t, lambda _, b: F.transform(F.array(F.aggregate(F.slice(t, 1, b), zero, add)), lambda base: F.transform(
            F.array(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))), lambda part: F.transform(
                part, lambda _x, i: base + F.aggregate(F.slice(part, 1, i), zero, add))))[0][0]))))


def with_chunks(
    df: DataFrame,
    text_col: str = "text",
    max_tokens: int = MAX_TOKENS_PER_CHUNK,
    token_pattern: str = TOKEN_PATTERN,
    keep_text: bool = True,
) -> DataFrame:
    """Explode every text into chunk rows.

    Adds ``chunk_index`` (0-based), ``chunk_text``, byte ``start``/``end``,
    ``token_count``, ``content_sha`` (SHA-256 of the chunk) and ``chunk_size``
    (bytes). An empty text gives no rows. Byte offsets are prefix sums of the
    chunks' UTF-8 lengths, so ``bytes[start:end]`` of the source is the chunk.
    """
    text = F.col(text_col)
    if dict(df.dtypes).get(text_col) == "binary":
        text = as_text(text)
    if max_tokens < 1:
        raise ValueError("max_tokens must be positive")
    # tokens are split once and chunks cut by index; every stage is a column, so lambdas refer to values
    staged = df.withColumn("_toks", F.regexp_extract_all(text, F.lit(token_pattern), 0))
    n_chunks = F.ceil(F.size("_toks") / max_tokens).cast("int")
    staged = staged.withColumn("_chunks", F.when(F.size("_toks") > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))),
        lambda i: F.array_join(F.slice("_toks", i * max_tokens + 1, F.lit(max_tokens)), ""))).otherwise(F.array().cast("array<string>")))
    staged = staged.withColumn("_n", F.size("_toks")).drop("_toks")
    staged = staged.withColumn("_lens", F.transform("_chunks", lambda c: F.octet_length(c).cast("bigint")))
    staged = staged.withColumn("_starts", _starts(F.col("_lens")))
    rows = F.transform("_chunks", lambda c, i: F.struct(
        i.alias("chunk_index"), c.alias("chunk_text"), F.get(F.col("_starts"), i).alias("start"),
        F.least(F.lit(max_tokens), F.col("_n") - i * max_tokens).cast("int").alias("token_count")))
    out = (
        staged.withColumn("_chunk", F.explode(rows))
        .drop("_chunks", "_lens", "_starts", "_n")
        .select("*", "_chunk.*")
        .drop("_chunk")
        .withColumn("chunk_size", F.octet_length("chunk_text").cast("bigint"))
        .withColumn("end", F.col("start") + F.col("chunk_size"))
        .withColumn("content_sha", F.sha2(F.col("chunk_text"), 256))
    )
    return out if keep_text else out.drop("chunk_text")


def text_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line: ``line_number`` (1-based) and ``line`` (the text column itself is dropped).

    Lines end at ``\\n``; one trailing ``\\r`` is removed; an empty tail after
    the last ``\\n`` is not a line; an empty text has no lines. The split array
    is materialised once and its empty tail sliced off before the explode.
    """
    text = F.col(text_col)
    if dict(df.dtypes).get(text_col) == "binary":
        text = as_text(text)
    staged = df.withColumn("_parts", F.split(text, "\n", -1))
    parts = F.col("_parts")
    staged = staged.withColumn(
        "_parts", F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))
    keep = [c for c in df.columns if c != text_col]  # the whole text is not repeated on every line row
    exploded = staged.select(*keep, F.posexplode("_parts").alias("_pos", "_raw"))
    raw = F.col("_raw")
    line = F.when(F.endswith(raw, F.lit("\r")), F.left(raw, F.length(raw) - 1)).otherwise(raw)
    return exploded.withColumn("line_number", (F.col("_pos") + 1).cast("bigint")).withColumn("line", line).drop(
        "_pos", "_raw")
