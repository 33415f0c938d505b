"""Projections of a scope: its current state, its establishing facts, what happened, one sheet, a situation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import text_of
from ..schema import CONTAINED
from .fold import KEY, keyed
from .knowledge import causes, event_rows
from .semantics import Policy
from .visible import Snapshot, metas
from .walks import ancestors, parents

DEFAULTS = [("room", "lighting", '"unremarkable"'), ("room", "walls", '"plain"'), ("person", "build", '"average"')]
FACTS = "entity string, attribute string, value string, source string, winner_id string"


def scope(folded: DataFrame, roots: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity): the roots and everything in them, however deep."""
    inside = ancestors(parents(folded).where(F.col("frame") == frame))
    below = inside.join(roots.select(F.col("entity").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("entity"))
    return roots.select("entity").union(below).distinct()


def current(folded: DataFrame, within: DataFrame, frame: str = "canon") -> DataFrame:
    """What holds of a scope, one row a key."""
    return folded.where(F.col("frame") == frame).join(within, "entity", "left_semi")


def establishing(s: Snapshot, policy: Policy, canon: DataFrame, folded: DataFrame, within: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity, attribute, winner_id): of states the first that no event caused (a row marked world_defining before all); other keys as folded."""
    now = current(folded, within, frame)
    effects = causes(s).select("id").distinct().withColumn("effect", F.lit(True))
    pinned = metas(s, "world_defining").select("id").distinct().withColumn("pinned", F.lit(True))
    rows = keyed(s, policy, canon).where((F.col("durability") == "STATE") & (F.col("frame") == frame) & ~F.col("is_set") & ~F.col("accrues") & (F.col("value_type") != "delta"))
    rows = rows.join(within, "entity", "left_semi").join(effects, "id", "left").join(pinned, "id", "left").where("effect is null or pinned")
    first = rows.groupBy("entity", "attribute").agg(F.min_by("id", F.struct(F.col("pinned").isNull(), "vf_or", "asserted_at")).alias("winner_id"))
    return now.where("branch <> 'state'").select("entity", "attribute", "winner_id").union(first)


def what_happened(s: Snapshot, within: DataFrame | None = None, frame: str = "canon", since: float | None = None) -> DataFrame:
    """Rows about events whose subject or object is in the scope (all, without one)."""
    rows = event_rows(s, frame, since)
    if within is None:
        return rows
    of = F.when(F.col("value_type") == "entity", text_of(F.col("value")))
    own = rows.withColumn("object", of)
    subject = own.join(within, "entity", "left_semi")
    object_ = own.join(within.select(F.col("entity").alias("object")), "object", "left_semi").select(*own.columns)
    return subject.unionByName(object_).distinct().drop("object")


def situation(s: Snapshot, folded: DataFrame, within: DataFrame, frame: str = "canon") -> tuple[DataFrame, DataFrame]:
    """The scope's state, and the rows of the events that caused what is served there."""
    now = current(folded, within, frame)
    served = now.select(F.explode(F.array_union(F.array("winner_id"), "conflicting")).alias("id")).distinct()
    live = causes(s).join(served, "id", "left_semi").select(F.col("event").alias("entity")).distinct()
    return now, event_rows(s, frame).join(live, "entity", "left_semi")


def with_defaults(now: DataFrame) -> DataFrame:
    """(entity, attribute, value, source, winner_id): facts, and what a kind is by default where nothing is said."""
    spark = now.sparkSession
    shown = now.select("entity", F.when(F.col("attribute") == CONTAINED, "in").otherwise(F.col("attribute")).alias("attribute"), F.col("winner_value").alias("value"), F.lit("log").alias("source"), "winner_id")
    kinds = shown.where("attribute = 'kind'").select("entity", text_of(F.col("value")).alias("kind"))
    fill = kinds.join(F.broadcast(spark.createDataFrame(DEFAULTS, "kind string, attribute string, value string")), "kind")
    fill = fill.select("entity", "attribute", "value").join(shown.select("entity", "attribute"), ["entity", "attribute"], "left_anti")
    return shown.union(fill.select("entity", "attribute", "value", F.lit("default"), F.lit(None).cast("string")))


def audit(s: Snapshot, folded: DataFrame, classified_rows: DataFrame) -> dict[str, DataFrame]:
    """What to look at in a log: timed rows without a time, things that are nowhere, conflicts."""
    placed = folded.where(F.col("attribute") == CONTAINED).select("entity")
    things = folded.where(F.col("entity").startswith("obj:") | F.col("entity").startswith("person:")).select("entity").distinct()
    return {
        "unstamped": classified_rows.where("valid_from is null and durability in ('STATE', 'EVENT')").select("id", "entity", "attribute"),
        "orphans": things.join(placed, "entity", "left_anti"), "conflicts": folded.where("conflicted").select(*KEY),
    }
