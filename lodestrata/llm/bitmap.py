"""Bitmap filters of a fixed number of bits: a semi join's first sieve, with false positives but no misses.

The bits grow with the number of keys up to a stated bound, so broadcasting one
is safe at any size of input; a full bitmap only sieves less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^29 bits are 64 MB.
MOST = 29


def bits_for(n: int, most: int = MOST) -> int:
    """32 bits a key as a power of two, from 2^20 to 2^most."""
    return 1 << max(20, min(most, (max(n, 1) * 32 - 1).bit_length()))


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def build(keys: DataFrame, place: Column) -> DataFrame:
    """(bucket, bitmap) rows of 32,768 bits each, set at the 1-based ``place`` of each key."""
    return keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bitmap"))


def sieve(rows: DataFrame, column: str, keys: DataFrame, n_keys: int, outside: bool = False) -> DataFrame:
    """The rows whose ``column`` may be among ``keys`` (one column of that name); if ``outside``, all others."""
    bits = bits_for(n_keys)
    place = _place(F.col(column), bits)
    marked = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(__bitmap, __bit div 8 + 1, 1)")), 16, 10).cast("long")
    bit = F.coalesce(F.getbit(byte, F.col("__bit") % 8), F.lit(0))
    # bits / 8 bytes at most, which bits_for bounds
    return marked.join(F.broadcast(build(keys, place)), "__bucket", "left" if outside else "inner").filter(bit == (0 if outside else 1)).select(*rows.columns)


#: Bits of a 64-bit hash at which its places in a bitmap of up to 2^29 bits begin.
_SHIFTS = (0, 17, 34)


def gather(hashes: DataFrame, bits: int, probes: int = 3) -> np.ndarray:
    """The longs in ``hash`` as a bitmap of ``bits / 8`` bytes on the driver, least bit first.

    Each sets ``probes`` bits; with one, only the low bits need be spread well.
    """
    out = np.zeros(bits // 8, np.uint8)
    places = F.array(*(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(bits - 1)) + 1 for k in _SHIFTS[:probes]))
    for bucket, bitmap in build(hashes.select(F.explode(places).alias("place")), F.col("place")).toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bitmap), np.uint8)
    return out


def has(bitmap: np.ndarray, hashes: np.ndarray, probes: int = 3) -> np.ndarray:
    out = np.ones(hashes.shape, bool)
    for k in _SHIFTS[:probes]:
        at = ((hashes >> np.uint64(k)) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out
