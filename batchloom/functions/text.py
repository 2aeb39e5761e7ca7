"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of a turn.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"

# Words are runs of anything but these four characters. An explicit class means the same to every
# regular expression engine.
WORD_PATTERN = r"[^ \t\n\r]+"


def templated(role: Column | str, content: Column) -> Column:
    """One turn: the role on the first line, the content between the markers."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), content, F.lit(TURN_END))


def word_count(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words(text: Column, pattern: str = WORD_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def required(column: Column, what: str) -> Column:
    """``column``, or an error that names it where it is null: a missing field aborts the job."""
    return F.coalesce(column, F.raise_error(F.lit(f"{what} is missing")).cast("string"))
