"""Reads of the log: what is visible at a valid and a transaction time, and the facts, heads and lookups over it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import META
from .sizes import hinted


@dataclass(frozen=True)
class Snapshot:
    """A log and the two times it is read at; an omitted time is no bound at all."""

    log: DataFrame
    valid_as_of: float | None = None
    asserted_as_of: int | None = None

    def at(self, valid_as_of: float | None) -> Snapshot:
        return replace(self, valid_as_of=valid_as_of)


def valid_at(t: float | None) -> Column:
    """Half open: from valid_from on, before valid_to; null is unbounded."""
    if t is None:
        return F.lit(True)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def asserted_by(n: int | None) -> Column:
    return F.lit(True) if n is None else F.col("asserted_at") <= n


def retracted_ids(s: Snapshot) -> DataFrame:
    """Targets of retractions. A retraction's own status, frame and valid time don't matter, so it can't be taken back."""
    return s.log.where((F.col("attribute") == "retracts") & asserted_by(s.asserted_as_of)).select(F.col("entity").alias("id"))


def visible(s: Snapshot, where: Column | None = None) -> DataFrame:
    """Rows of the log that hold at the snapshot. ``where`` is pushed below the anti-join, into the scan; unless retractions are very many, nothing is shuffled."""
    rows = s.log.where((F.col("status") != "retracted") & valid_at(s.valid_as_of) & asserted_by(s.asserted_as_of))
    if where is not None:
        rows = rows.where(where)
    return rows.join(hinted(retracted_ids(s), s.log, "retracts"), "id", "left_anti")


def is_domain() -> Column:
    """Rows about things, not about other rows or attributes."""
    return ~F.col("entity").startswith("a:") & ~F.col("entity").startswith("attr:")


def get(log: DataFrame, assertion_id: str) -> DataFrame:
    """One row by id, visible or not."""
    return log.where(F.col("id") == assertion_id)


def axis_heads(log: DataFrame) -> DataFrame:
    """The last transaction and the latest valid time of all rows, retracted ones too."""
    return log.agg(F.coalesce(F.max("asserted_at"), F.lit(0)).alias("asserted_head"), F.max("valid_from").alias("valid_head"))


def metas(s: Snapshot, attribute: str) -> DataFrame:
    """(id, value, seq) of the visible rows that say ``attribute`` of another row."""
    rows = visible(s, (F.col("attribute") == attribute) & F.col("entity").startswith("a:"))
    return rows.select(F.col("entity").alias("id"), F.get_json_object("value", "$").alias("meta"), "value", "seq")


def facts(s: Snapshot, frame: str, entity_prefix: str | None = None, attribute: str | None = None, include_meta: bool = False) -> DataFrame:
    """Raw visible rows of a frame with their source chains, in the order that the sources were given."""
    where = F.col("frame") == frame
    if entity_prefix is not None:
        where &= F.col("entity").startswith(entity_prefix)
    if attribute is not None:
        where &= F.col("attribute") == attribute
    if not include_meta:
        where &= is_domain() & ~F.col("attribute").isin(*META)
    chain = metas(s, "source").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "meta"))).alias("c"))
    rows = visible(s, where).join(chain.select("id", F.col("c.meta").alias("source_chain")), "id", "left")
    return rows.withColumn("source_chain", F.coalesce("source_chain", F.array().cast("array<string>")))
