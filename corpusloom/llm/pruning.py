"""Leaving out rows whose key can't be among a set of keys, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to which a bit table is broadcast: it has at most 2^20 rows of two longs.
MOST_KEYS = 1 << 23
_LEAST_BITS, _MOST_BITS = 1 << 16, 1 << 26


def bits_for(n: int) -> int:
    """Bits of the table for n keys: 16 a key as long as the limit allows, so about one row in 16 passes falsely."""
    return min(_MOST_BITS, max(_LEAST_BITS, 1 << max(0, 16 * n - 1).bit_length()))


def pruned(rows: DataFrame, key: str, wanted: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Rows whose ``key`` is in ``wanted``, and few others; an exact join has to follow.

    The bits are as many as the keys ask for.  Beyond ``most`` keys no table is
    made and all rows pass: the exact join then shuffles them by the key, which
    grows with the data but with no broadcast.  Null keys never pass.
    """
    n = wanted.count()
    if n > most:
        return rows
    words = bits_for(n) >> 6
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(17), key))
    place = F.pmod(F.shiftrightunsigned("_h", 6), F.lit(words)).alias("_word")
    bit = "cast(_h & 63 as int)"
    table = wanted.where(F.col(key).isNotNull()).select(F.xxhash64(F.lit(17), key).alias("_h")).select(place, F.expr(f"shiftleft(1L, {bit})").alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    joined = hashed.where(F.col(key).isNotNull()).withColumn("_word", place).join(F.broadcast(table), "_word")
    return joined.where(F.expr(f"getbit(_bits, {bit}) = 1")).drop("_h", "_word", "_bits")
