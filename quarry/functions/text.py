"""Scalar text expressions. All are built-in Spark expressions (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.constants import (
    ANSI_CSI,
    ANSI_CSI_8BIT,
    ANSI_OSC,
    ANSI_SS3,
    EOF_MARKER,
    SNIPPET_ELLIPSIS,
    TRUNCATED_MARKER,
    UNICODE_SPACE_CHARS,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def go_trim(s) -> Column:
    """Strip leading and trailing Unicode white space (Spark's plain ``trim`` strips spaces only)."""
    return F.btrim(_col(s), F.lit(UNICODE_SPACE_CHARS))


def as_text(content) -> Column:
    """Bytes to a string; invalid UTF-8 sequences become U+FFFD instead of failing the task."""
    return F.make_valid_utf8(_col(content).cast("string"))


def as_bytes(text) -> Column:
    return F.encode(_col(text), "UTF-8")


def is_binary(content) -> Column:
    """A NUL byte anywhere in the file."""
    return F.locate("\u0000", _col(content).cast("string")) > 0


def byte_prefix(text, n: int) -> Column:
    """First ``n`` UTF-8 bytes of a string; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(as_bytes(text), 1, n).cast("string"))


def snippet(content, start, end, max_bytes: int | None = None) -> Column:
    """Bytes ``[start, end)`` of a file as one trimmed line; ``max_bytes`` cuts it and appends ``…``.

    Out-of-range windows give ``''``; the window is clamped to the file.
    """
    data = _col(content)
    n = F.octet_length(data)
    s = F.greatest(_col(start), F.lit(0))
    e = F.least(_col(end), n)
    window = F.substring(data, s + 1, e - s)
    text = go_trim(F.replace(as_text(window), F.lit("\n"), F.lit(" ")))
    cut = text if max_bytes is None else F.when(
        F.octet_length(text) > max_bytes, F.concat(byte_prefix(text, max_bytes), F.lit(SNIPPET_ELLIPSIS))).otherwise(text)
    return F.when((s >= n) | (s >= e), F.lit("")).otherwise(cut)


def _clamped_range(start, end, length, most: int | None):
    s = F.greatest(_col(start), F.lit(0))
    e = F.greatest(F.greatest(_col(end), F.lit(0)), s)
    s = F.least(s, length)
    e = F.least(e, length)
    truncated = F.lit(False) if most is None else (e - s) > most
    e = e if most is None else F.when(truncated, s + most).otherwise(e)
    return s, e, truncated


def read_slice(text, start, end, max_chars: int | None = None) -> Column:
    """Characters ``[start, end)`` of a text as ``struct<chunk, truncated>``.

    Negative offsets become 0, ``end < start`` becomes ``start``, both clamp to
    the length. ``max_chars`` cuts the slice. ``<|EOF|>`` is appended when the slice
    reaches the end, ``. . .truncated`` when it was cut.
    """
    t = _col(text)
    length = F.char_length(t)
    s, e, truncated = _clamped_range(start, end, length, max_chars)
    body = F.substring(t, s + 1, e - s)
    chunk = F.concat(
        body,
        F.when(e >= length, F.lit(EOF_MARKER)).otherwise(F.lit("")),
        F.when(truncated, F.lit(TRUNCATED_MARKER)).otherwise(F.lit("")),
    )
    return F.struct(chunk.alias("chunk"), truncated.alias("truncated"))


def read_slice_hex(content, start, end, max_digits: int | None = None) -> Column:
    """Hex-digit range ``[start, end)`` of file bytes (lower-case), same clamps and markers.

    Offsets count hex digits: an odd start drops the first nibble of its byte.
    """
    data = _col(content)
    total = F.octet_length(data) * 2
    s, e, truncated = _clamped_range(start, end, total, max_digits)
    nibbles = e - s
    byte_start = F.floor(s / 2).cast("int")
    byte_end = F.least(F.floor((e + 1) / 2).cast("int"), F.octet_length(data))
    seg_hex = F.lower(F.hex(F.substring(data, byte_start + 1, byte_end - byte_start)))
    body = F.substring(seg_hex, (s % 2).cast("int") + 1, nibbles)
    chunk = F.concat(
        body,
        F.when(e >= total, F.lit(EOF_MARKER)).otherwise(F.lit("")),
        F.when(truncated, F.lit(TRUNCATED_MARKER)).otherwise(F.lit("")),
    )
    return F.struct(chunk.alias("chunk"), truncated.alias("truncated"))


def strip_ansi(s) -> Column:
    """Remove OSC, CSI, 8-bit CSI and SS3 escape sequences, in that order."""
    out = _col(s)
    for pattern in (ANSI_OSC, ANSI_CSI, ANSI_CSI_8BIT, ANSI_SS3):
        out = F.regexp_replace(out, pattern, "")
    return out


def model_slug(model) -> Column:
    """Lower-case, map space ``/ : @ . _`` to ``-``, squeeze and strip dashes."""
    s = F.translate(F.lower(_col(model)), " /:@._", "------")
    s = F.regexp_replace(s, "-+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def split_model(model) -> Column:
    """``struct<family, version>``: split at the first ``-``; no dash gives (slug, ``base``)."""
    m = _col(model)
    pos = F.instr(m, "-")
    family = F.when(pos == 0, model_slug(m)).otherwise(F.substring_index(m, "-", 1))
    version = F.when(pos == 0, F.lit("base")).otherwise(F.substring(m, pos + 1, F.char_length(m)))
    return F.struct(family.alias("family"), version.alias("version"))


def clean_labels(labels) -> Column:
    """Trim each label and drop blanks (duplicates stay); an empty result is NULL."""
    cleaned = F.filter(F.transform(_col(labels), lambda x: go_trim(x)), lambda x: x != "")
    return F.when(F.size(cleaned) > 0, cleaned)


def normalize_filters(values) -> Column:
    """Trim, drop blanks, de-duplicate. An empty list means 'no filter'."""
    return F.array_distinct(F.filter(F.transform(_col(values), lambda x: go_trim(x)), lambda x: x != ""))


def normalize_filter_list(values: list[str] | None) -> list[str]:
    """Driver-side form of :func:`normalize_filters` for literal argument lists."""
    return [t for t in dict.fromkeys(v.strip() for v in values or []) if t]
