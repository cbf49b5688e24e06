"""Many-to-one lookups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from .bitmaps import mark_possible

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000
SALTS = 16
PLACE = "_salt"
NULL_SALTS = 1_024  # rows without a key meet nothing, so they may lie anywhere


def lookup(
    many: DataFrame, one: DataFrame, key: str, how: str = "left", one_rows: int | None = None, heat: str | None = None, misses: bool = True,
    keep_place: bool = False,
) -> DataFrame:
    """Join ``one`` (unique ``key``) to ``many``, which is read once whatever the way.

    A table of narrow rows may come with ``one_rows``, its measured size; any other is measured here, rows
    and bytes. Up to BROADCAST_ROWS and BROADCAST_BYTES it is broadcast and ``many`` does not move. Beyond that
    one salted join is made: the rows of a key are dealt to SALTS places by a hash of their columns, and the
    key's row of ``one`` goes to each. ``heat`` names a column of ``one`` that tells how
    frequent a key is (it is dropped from the result); then only the HOT_KEYS most frequent keys and rows without a key are salted, else all. The
    result is the same.

    Without ``misses`` a left join leaves out the rows whose key ``one`` lacks, but keeps those without a key. A bitmap of the keys then
    stands before the salted join, so that hardly any other row is moved.

    With ``keep_place`` the result of a salted join has the column PLACE: rows that are equal in all columns of ``many`` lie together by
    (``key``, PLACE), so a grouping by all of them and PLACE moves nothing again.
    """
    if misses is False:
        found = lookup(many, one.withColumn("_met", F.lit(True)), key, how, one_rows, heat, None, keep_place)
        return found.filter(F.col(key).isNull() | F.col("_met")).drop("_met")
    size = 0
    if one_rows is None:
        width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in one.columns])))
        one_rows, size = one.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    slim = one.drop(heat) if heat else one
    if one_rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return many.join(F.broadcast(slim), key, how)
    if misses is None:
        many = mark_possible(many, key, one, one_rows).filter(F.col(key).isNull() | F.col("_possible")).drop("_possible")
    salt = _dealt(many)
    copies = F.lit(SALTS)
    if heat:
        hot = one.orderBy(F.desc(heat), key).limit(HOT_KEYS).select(key, F.lit(True).alias("_hot"))
        many = many.join(F.broadcast(hot), key, "left")  # at most HOT_KEYS rows
        slim = slim.join(F.broadcast(hot), key, "left").withColumn("_copies", F.when(F.col("_hot"), SALTS).otherwise(1)).drop("_hot")
        copies = F.col("_copies")
        salt = F.when(F.col(key).isNull(), _dealt(many.drop("_hot"), NULL_SALTS)).when(F.col("_hot"), salt).otherwise(0)
    many = many.withColumn(PLACE, salt.cast("int")).drop("_hot")
    slim = slim.withColumn(PLACE, F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    found = many.join(slim, [key, PLACE], how)
    return found if keep_place else found.drop(PLACE)


def _dealt(rows: DataFrame, places: int = SALTS) -> Column:
    """A place of each row by its content, so that a task that is run again deals as before."""
    plain = [F.col(f"`{f.name}`") for f in rows.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.pmod(F.xxhash64(*plain), F.lit(places))
