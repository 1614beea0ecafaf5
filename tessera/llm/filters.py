"""Filters of bounded size: which hashes a set may hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bits of a broadcast filter: 32 MB.
FILTER_BITS = 28
#: Bits of one row of a filter while it is built.
_ROW = 15


def broadcast_filter(hashes: DataFrame, n_rows: int):
    """A bitmap of the low bits of the column ``h``, with some 32 bits a row but at most ``2 ** FILTER_BITS``.

    It is put together by bitmap aggregates in rows of 4 KB, so that what reaches the driver has a fixed
    bound. A set bit may be false; a clear one is sure.
    """
    bits = int(min(FILTER_BITS, max(_ROW + 1, (32 * max(1, n_rows)).bit_length())))
    place = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = hashes.groupBy(F.shiftright(place, _ROW).alias("r")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << _ROW) - 1))).alias("bits"))
    full = np.zeros((1 << (bits - _ROW), 1 << (_ROW - 3)), np.uint8)
    for r in rows.toLocalIterator():
        full[r["r"]] = np.frombuffer(r["bits"], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(full.ravel()), bits


def in_filter(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64((1 << bits) - 1)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
