"""Joins and shuffles laid out by counted rows: nothing is broadcast unseen, and no task's share grows with the log."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows (ids and short texts, some 100 bytes each) up to which a side of a join is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 400_000
#: Rows that one task of a shuffle sorts or groups, at most on average.
TASK_ROWS = 400_000
_TOTAL: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()
_EXTENT: WeakKeyDictionary[DataFrame, dict[str, tuple[int, str | None, str | None]]] = WeakKeyDictionary()


def total(log: DataFrame) -> int:
    """Rows of a log, counted once."""
    if log not in _TOTAL:
        _TOTAL[log] = log.count()
    return _TOTAL[log]


def extent(log: DataFrame, attribute: str) -> tuple[int, str | None, str | None]:
    """Rows of an attribute, and the first and last subject of them in order; looked up once."""
    known = _EXTENT.setdefault(log, {})
    if attribute not in known:
        known[attribute] = tuple(log.where(F.col("attribute") == attribute).agg(F.count("*"), F.min("entity"), F.max("entity")).first())
    return known[attribute]


def hinted(keys: DataFrame, log: DataFrame, attribute: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, at most one row for each row of ``attribute``, for a broadcast if those are few, else for a shuffled join."""
    return F.broadcast(keys) if extent(log, attribute)[0] <= most else keys.hint("merge")


def spread(df: DataFrame, rows: int, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """``df`` of at most ``rows`` rows shuffled by ``keys``, with so many partitions that none has more than its share."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)
