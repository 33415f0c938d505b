"""Events, movement, and what one frame holds that another doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import equal_key, text_of
from ..schema import CONTAINED
from ..storage import kept
from .classify import classified
from .identity import resolved
from .sizes import spread, total
from .visible import Snapshot, visible

ROLES = ("kind", "agent", "patient", "origin", "destination", "manner", "complete")


def event_rows(s: Snapshot, frame: str, since: float | None = None, sidecar: DataFrame | None = None) -> DataFrame:
    """Rows about events. A valid time to read at bounds when they began, not when they ended; ``since`` drops earlier and untimed ones."""
    where = (F.col("frame") == frame) & ~F.col("entity").startswith("a:")
    rows = classified(visible(Snapshot(s.log, None, s.asserted_as_of), where), sidecar).where("durability = 'EVENT'")
    if s.valid_as_of is not None:
        rows = rows.where(F.col("valid_from").isNull() | (F.col("valid_from") <= s.valid_as_of))
    return rows if since is None else rows.where(F.col("valid_from") >= since)


def events(s: Snapshot, canon: DataFrame, frame: str = "canon", since: float | None = None, kind: str | None = None, participants: tuple[str, ...] = ()) -> DataFrame:
    """One row per event: t, its roles, participants (resolved, sorted), n_rows. ``participants`` must all take part."""
    rows = event_rows(s, frame, since)
    value = F.coalesce(text_of(F.col("value")), F.col("value"))
    rows = resolved(rows.withColumn("said", value).withColumn("who", F.when(F.col("value_type") == "entity", value)), canon, "who", "known")
    order = F.struct(F.coalesce("valid_from", F.lit(float("-inf"))), "seq")
    last = lambda role: F.max_by("said", F.when(F.col("attribute") == role, order)).alias(role)
    out = rows.groupBy(F.col("entity").alias("event")).agg(
        F.max("valid_from").alias("t"), *[last(r) for r in ROLES],
        F.array_sort(F.collect_set(F.when(F.col("attribute").isin("agent", "patient"), F.col("known")))).alias("participants"), F.count("*").alias("n_rows"),
    )
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    for p in participants:
        out = out.where(F.array_contains("participants", p))
    return out


def participation(s: Snapshot, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity, event, role, t): who took part in what, and as what."""
    rows = event_rows(s, frame).where((F.col("value_type") == "entity") & F.col("entity").startswith("event:") & (F.col("attribute") != "caused_by"))
    rows = resolved(rows.withColumn("who", text_of(F.col("value"))), canon, "who", "known")
    rows = spread(rows.select(F.col("known").alias("entity"), F.col("entity").alias("event"), F.col("attribute").alias("role"), "valid_from"), total(s.log), "event")
    return rows.groupBy("entity", "event", "role").agg(F.max("valid_from").alias("t"))


def causes(s: Snapshot) -> DataFrame:
    """(id, event): rows and the events that caused them."""
    rows = visible(s, (F.col("attribute") == "caused_by") & F.col("entity").startswith("a:"))
    return rows.select(F.col("entity").alias("id"), text_of(F.col("value")).alias("event")).distinct()


def in_transit(s: Snapshot, folded: DataFrame, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(agent, event, origin, destination, departed): moves open at the snapshot whose agent hasn't been placed since."""
    t = s.valid_as_of
    rows = visible(s, (F.col("frame") == frame) & F.col("entity").startswith("event:"))
    value = F.coalesce(text_of(F.col("value")), F.col("value"))
    rows = resolved(rows.withColumn("said", value), canon, "said", "known")
    pick = lambda role, c: F.max_by(c, F.when(F.col("attribute") == role, F.col("seq"))).alias(role)
    moves = rows.groupBy("entity").agg(
        pick("kind", "said"), pick("agent", "known"), pick("origin", "known"), pick("destination", "known"), F.max("valid_from").alias("departed"), F.min("asserted_at").alias("told"), F.max("valid_to").alias("until"),
    ).where("kind = 'moved' and agent is not null")
    if t is not None:
        moves = moves.where((F.col("departed").isNull() | (F.col("departed") <= t)) & (F.col("until").isNull() | (F.col("until") > t)))
    placed = folded.where((F.col("attribute") == CONTAINED) & (F.col("frame") == frame)).select(F.col("entity").alias("agent"), "winner_from", F.regexp_replace("winner_id", "^a:", "").cast("long").alias("placed"))
    early = F.lit(float("-inf"))
    anchor = F.struct(F.coalesce("departed", early), "told")
    since = F.struct(F.coalesce("winner_from", early), "placed")
    out = moves.join(placed, "agent", "left").where(F.col("placed").isNull() | (since < anchor))
    return out.select("agent", F.col("entity").alias("event"), "origin", "destination", "departed")


def who_knows(folded: DataFrame, entity: str | None = None, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """(entity, attribute, frame): who holds a fact, by the folds of their frames; ``value`` is canonical JSON."""
    rows = folded.where(F.col("frame").startswith("knows:"))
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if attribute is not None:
        rows = rows.where(F.col("attribute") == attribute)
    if value is not None:
        rows = rows.where(equal_key(F.col("winner_value")) == equal_key(F.lit(value)))
    return rows.select("entity", "attribute", "frame")


def _held(folded: DataFrame, canon: DataFrame) -> DataFrame:
    """Comparable folds: no thunks, no events; entity values resolved."""
    rows = folded.where("winner_type <> 'unresolved'").withColumn("text", F.when(F.col("winner_type") == "entity", text_of(F.col("winner_value"))))
    rows = resolved(rows, canon, "text", "known")
    same = F.when(F.col("branch") == "accrue", F.concat(F.lit("#"), F.col("quantity").cast("string"))).otherwise(F.coalesce("known", equal_key(F.col("winner_value"))))
    return rows.select("entity", "attribute", "frame", "branch", same.alias("same"), F.coalesce("known", F.col("winner_value")).alias("value"), "members", "winner_from", "winner_id")


def frame_diff(folded: DataFrame, canon: DataFrame, a: str, *b: str) -> DataFrame:
    """(entity, attribute, value, divergent, other): what frame ``a`` holds that none of the frames ``b`` holds alike.

    A key that none has is absent (divergent false); else it diverges, and the latest other value is shown. Of sets, members are compared.
    """
    held = kept(_held(folded, canon).where(F.col("frame").isin(a, *b)), "held")
    one, rest = held.where(F.col("frame") == a), held.where(F.col("frame").isin(*b))
    order = F.struct(F.coalesce("winner_from", F.lit(float("-inf"))), F.regexp_replace("winner_id", "^a:", "").cast("long"))
    there = rest.where("branch <> 'set'").groupBy("entity", "attribute").agg(F.collect_set("same").alias("all"), F.max_by("value", order).alias("other"))
    x = one.where("branch <> 'set'").join(there, ["entity", "attribute"], "left").where(F.col("all").isNull() | ~F.array_contains("all", F.col("same")))
    single = x.select("entity", "attribute", "value", F.col("all").isNotNull().alias("divergent"), "other")
    member = lambda df: df.where("branch = 'set'").select("entity", "attribute", F.explode("members").alias("value"))
    missing = member(one).join(member(rest).distinct(), ["entity", "attribute", "value"], "left_anti")
    return single.unionByName(missing.select("entity", "attribute", "value", F.lit(False).alias("divergent"), F.lit(None).cast("string").alias("other")))


def entities(s: Snapshot, canon: DataFrame, frame: str, prefix: str | None = None) -> DataFrame:
    """(entity): canonical ids that a frame speaks of."""
    where = (F.col("frame") == frame) & ~F.col("entity").startswith("a:") & ~F.col("entity").startswith("attr:")
    if prefix is not None:
        where &= F.col("entity").startswith(prefix)
    return resolved(visible(s, where).select("entity").distinct(), canon, "entity", "canon").select(F.col("canon").alias("entity")).distinct()


def event_time() -> Column:
    return F.coalesce("valid_from", F.lit(float("-inf")))
