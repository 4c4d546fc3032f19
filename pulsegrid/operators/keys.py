"""Joins on keys of which any may be null: null equals null, so no row is lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.shared import stored

#: Rows of a summary that are sent to all tasks at most; a larger one is joined by a shuffle.
SENT_ROWS = 200_000


def join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, null-safe; columns as of a join by name."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def join_summary(left: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """``join`` with one short row per key: stored and counted first, and sent to all tasks up to ``SENT_ROWS`` rows.

    So a large table with few keys isn't shuffled by them.
    """
    summary = stored(summary, "summary")
    return join(left, F.broadcast(summary) if summary.count() <= SENT_ROWS else summary, keys)
