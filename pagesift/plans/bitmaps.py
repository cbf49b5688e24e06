"""Hashed bitmaps of key sets: which rows may belong to a set, told without moving them.

A bitmap has one bit per hash value and is kept as rows of 4 KB, made and merged by Spark's own bitmap functions. A
key of the set always has its bit; another one has it by chance, more often the fuller the bitmap is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .materialize import materialize

ROW_BITS = 1 << 15  # of one row: fixed by the bitmap functions
BITS_PER_KEY = 16
MOST_BITS = 1 << 28  # 32 MB, which may be broadcast


def bits_for(keys: int, most: int | None = MOST_BITS) -> int:
    """A power of two that gives each key some bits, at most ``most``."""
    wanted = max(ROW_BITS, 1 << (BITS_PER_KEY * max(keys, 1) - 1).bit_length())
    return min(wanted, most) if most else wanted


def place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap_row(key: Column, bits: int) -> Column:
    """Which row of the bitmap holds a key's bit."""
    return F.shiftright(place(key, bits), 15)


def bitmap_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """``bitmap_row, bitmap`` of the keys; rows without a key are left out."""
    at = place(F.col(key), bits)
    return keys.select(bitmap_row(F.col(key), bits).alias("bitmap_row"), (at % ROW_BITS).alias("_bit")).groupBy("bitmap_row").agg(
        F.bitmap_construct_agg("_bit").alias("bitmap"))


def has_bit(bitmap: Column, key: Column, bits: int) -> Column:
    """Is the key's bit set? False without a bitmap."""
    at = place(key, bits) % ROW_BITS
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (at % 8).cast("int") + 1)
    return F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))


def may_be_in(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the table ``keys``: all that are, and some others. The rows do not move."""
    bits = bits_for(n_keys)
    bitmap = materialize(bitmap_of(keys, key, bits), "bitmap")
    rows = df.withColumn("bitmap_row", bitmap_row(F.col(key), bits)).join(F.broadcast(bitmap), "bitmap_row")  # MOST_BITS at most
    return rows.filter(has_bit(F.col("bitmap"), F.col(key), bits)).drop("bitmap_row", "bitmap")


def mark_possible(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> DataFrame:
    """``df`` with ``_possible``: may the key be in the table ``keys``? All rows stay, and none moves."""
    bits = bits_for(n_keys)
    bitmap = materialize(bitmap_of(keys, key, bits), "bitmap")
    rows = df.withColumn("bitmap_row", bitmap_row(F.col(key), bits)).join(F.broadcast(bitmap), "bitmap_row", "left")  # MOST_BITS at most
    return rows.withColumn("_possible", has_bit(F.col("bitmap"), F.col(key), bits)).drop("bitmap_row", "bitmap")
