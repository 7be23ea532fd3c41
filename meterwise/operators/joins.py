"""Joins with a table of keys that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in SHARE of all rows, and more than LEAST rows, is hot; so there are at most SHARE hot keys.
SHARE, LEAST = 10_000, 500


def join_spread(rows: DataFrame, keyed: DataFrame, on: Sequence[str], size: str, total: int, how: str = "inner", least: int | None = None) -> DataFrame:
    """rows joined (inner or left) with keyed, which has one row for each key and in `size` its number of rows in rows.

    Hot keys, at most SHARE of them, are broadcast, and their rows stay where they are; the other keys meet by shuffle, each
    with at most `least` (LEAST) rows or one in SHARE of the `total`. rows and keyed are read more than once, so rows should be stored.
    """
    most = max(LEAST if least is None else least, total // SHARE)
    if total <= most:
        return rows.join(keyed.drop(size), list(on), how)
    hot = keyed.where(F.col(size) > most).drop(size)
    beside = rows.join(F.broadcast(hot), list(on))
    others = rows.join(F.broadcast(hot.select(*on)), list(on), "left_anti").join(keyed.where(F.col(size) <= most).drop(size), list(on), how)
    return beside.unionByName(others)
