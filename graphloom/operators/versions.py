"""Choosing the row in force among several ingest rows of one id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(
    rows: DataFrame,
    columns: Sequence[str | Column],
    key: str = "id",
    newest: Sequence[str] = ("updated_at", "ingest_no"),
) -> DataFrame:
    """The newest row of each ``key``: greatest ``newest`` columns, compared in order, null lowest.

    Rows with a null key name nothing and are dropped. Rows equal in key and order are the same request, any
    one of them is kept. It is an aggregation, so versions are combined before the shuffle and one key that
    holds a large part of all rows does not end up in a single task.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    kept = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("__key"), F.struct(*newest).alias("__at"), F.struct(*cols).alias("__row")
    )
    best = kept.groupBy("__key").agg(F.max_by("__row", "__at").alias("__row"))
    return best.select(F.col("__key").alias(key), "__row.*")
