"""Joins against lists of keys whose size is checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a written key list (of some 40 bytes each) up to which it is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def hinted(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a written table, marked for broadcast if it has at most ``most`` rows, else for a shuffled join."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")
