"""Exploding computed arrays without computing them twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def unnest(df: DataFrame, keep: list[str], array: str, value: str, position: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Rows ``keep + [position] + value``, one per array element.

    An inner explode of a column makes Catalyst infer ``size(column) > 0``, push it
    below the projection that computes the column, and so compute it once more with
    all its inputs inlined. The outer form infers nothing; the test follows it.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(value))
    return rows if keep_empty else rows.filter(F.col(position or value).isNotNull())
