"""Column expressions and small helpers that the text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def word_count(col: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def id_slice(id_col: str, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``mod``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == rest, F.lit(False))
