"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are handled as heavy; that bounds what is collected and broadcast.
MAX_HEAVY_KEYS = 512
#: A key with fewer rows is never heavy.
MIN_HEAVY_ROWS = 20_000


def heavy_keys(counts: DataFrame, key: str, n: str, min_rows: int = MIN_HEAVY_ROWS, max_keys: int = MAX_HEAVY_KEYS) -> list:
    """The keys with most rows, from pre-aggregated counts: at most ``max_keys`` values.

    A key outside the list holds fewer than ``1 / max_keys`` of all rows or fewer than ``min_rows``.
    Null is never a heavy key. An empty input gives an empty list.
    """
    top = counts.filter(F.col(key).isNotNull() & (F.col(n) >= min_rows)).orderBy(F.desc(n), F.asc(key)).limit(max_keys)
    return [r[0] for r in top.select(key).collect()]


def among(col: Column, values: list) -> Column:
    """``col`` is one of ``values``; false, not null, for null."""
    return F.coalesce(col.isin(values), F.lit(False)) if values else F.lit(False)


def lookup(left: DataFrame, right: DataFrame, key: str, heavy: list, how: str = "left") -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) on ``key``; heavy keys take a broadcast of their few right rows.

    ``heavy`` comes from :func:`heavy_keys`, so the broadcast side has at most that many rows. Null keys match nothing.
    """
    if not heavy:
        return left.join(right, key, how)
    rest = left.filter(~among(F.col(key), heavy)).join(right.filter(~among(F.col(key), heavy)), key, how)
    hot = left.filter(among(F.col(key), heavy)).join(F.broadcast(right.filter(among(F.col(key), heavy))), key, how)
    return rest.unionByName(hot)
