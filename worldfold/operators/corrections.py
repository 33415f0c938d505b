"""What corrections need to know: the row that one replaces, and rows that say the same twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .visible import Snapshot, is_domain, visible


def priors(rows: DataFrame) -> DataFrame:
    """(id, prior): of every keyed() row the latest earlier one of its key and class of sources, which a correction of it retracts; null for a first."""
    said = Window.partitionBy("entity", "attribute", "frame", "source_class").orderBy("seq")
    return rows.select("id", F.lag("id").over(said).alias("prior"))


def twins(s: Snapshot) -> DataFrame:
    """(id, twins): visible rows about things whose entity, attribute, value and frame another visible row has too; one of them may be retracted.

    Rows are put together by counts, not brought to one place: a fact repeated without end is one row of the join.
    """
    same = ["entity", "attribute", "value_type", "value", "frame"]
    rows = visible(s, is_domain()).select("id", *same)
    often = rows.groupBy(*same).agg((F.count("*") - 1).alias("twins")).where("twins > 0")
    return rows.join(often, same).select("id", "twins")
