"""Deterministic ids, numbers and orders from hashes: the only source of randomness, equal in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column | str) -> Column:
    """Parts as text, with the unit separator between them."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("None")) for p in parts]
    return F.concat_ws("\x1f", *cols)


def stable_hex(*parts: Column | str, n: int = 16) -> Column:
    """The first ``n`` hex digits of the parts' SHA-256."""
    return F.substring(F.sha2(joined(*parts), 256), 1, n)


def stable_unit(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first twelve hex digits of the parts' SHA-256."""
    return F.conv(stable_hex(*parts, n=12), 16, 10).cast("long") / float(1 << 48)


def hash_int(*parts: Column | str) -> Column:
    """A non-negative 32-bit number from the first eight hex digits of the parts' MD5."""
    return F.conv(F.substring(F.md5(joined(*parts)), 1, 8), 16, 10).cast("long")


def split_of(*parts: Column | str, train: float = 0.70, validation: float = 0.15) -> Column:
    """``train``, ``validation`` or ``test`` by ``stable_unit``."""
    u = stable_unit(*parts)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")
