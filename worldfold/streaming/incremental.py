"""Folds kept up to date as a log grows: each micro-batch refolds the keys it touches, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fold import fold
from ..operators.identity import canon_map, edges
from ..operators.semantics import Policy
from ..operators.visible import Snapshot


def touched(log: DataFrame, new: DataFrame) -> DataFrame:
    """(entity): subjects of new rows, of rows that new metas speak of (retractions too), and both closures of new merges.

    Late rows are never dropped, so there is no watermark.
    """
    own = new.where(~F.col("entity").startswith("a:")).select("entity")
    told = new.where(F.col("entity").startswith("a:")).select(F.col("entity").alias("id")).distinct()
    spoken = log.join(told, "id", "left_semi").select("entity")
    first = own.union(spoken).distinct()
    same = edges(Snapshot(log), "same_as")
    both = same.union(same.select("b", "a"))
    while True:  # closures are small: a round for each step of a chain
        more = both.join(first.select(F.col("entity").alias("a")), "a", "left_semi").select(F.col("b").alias("entity")).join(first, "entity", "left_anti").distinct()
        if not more.limit(1).count():
            return first
        first = first.union(more)


def maintain(stream: DataFrame, log: Callable[[], DataFrame], policy: Policy, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Refold what each batch of ``stream`` touches in ``log()`` (the table, the batch in it) and give the folds to ``sink``.

    A batch that is run again gives the same folds, so that a sink that overwrites by batch number is exact.
    """

    def refold(batch: DataFrame, number: int) -> None:
        rows = log()
        keys = touched(rows, batch)
        s = Snapshot(rows)
        canon = canon_map(s)
        names = keys.join(canon.withColumnRenamed("id", "entity"), "entity", "left").select(F.coalesce("canon", "entity").alias("entity")).distinct()
        sink(fold(s, policy, canon).join(names, "entity", "left_semi"), number)

    return stream.writeStream.foreachBatch(refold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
