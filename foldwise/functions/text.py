"""Text expressions: dataset variants, file stems, name checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldwise.config import PARAGRAPH_BREAK, PARAGRAPH_MARKER, REG_TOKEN_PREFIX, RUN_NAME_PATTERN


def paragraph_marked(text: Column) -> Column:
    """Replace every blank line (two newlines) by the paragraph marker.

    Left to right, non-overlapping: three newlines become marker + newline.
    """
    return F.replace(text, F.lit(PARAGRAPH_BREAK), F.lit(PARAGRAPH_MARKER))


def reg_token_prefixed(text: Column) -> Column:
    """Prefix the six target words and a separator (train split only)."""
    return F.concat(F.lit(REG_TOKEN_PREFIX), text)


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n`` (text-mode file reading)."""
    return F.regexp_replace(text, "\r\n?", "\n")


def file_stem(path: Column) -> Column:
    """File name without directory and without its last extension only."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def full_match(col: Column, pattern: str) -> Column:
    """Whole-string regex match; ``\\z`` so a trailing newline does not pass."""
    return col.rlike(r"\A(?:" + pattern + r")\z")


def valid_run_name(col: Column) -> Column:
    return full_match(col, RUN_NAME_PATTERN)
