"""The write gate: items in, log rows and skip receipts out, a batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import text_of
from ..schema import CONTAINMENT, ENTITY_ID, LATERAL, RANKS, STRUCTURAL
from .identity import resolved
from .walks import blocks_cycle

ITEM = "entity string, attribute string, value string, value_type string, frame string, status string, timeless boolean, valid_from double, valid_to double, confidence double, source string, caused_by string"
ALIASES = {"location": "in", "located_in": "in", "called": "name", "type": "kind"}
#: Which statuses a writer may give.
ROLES = {"ingestor": ("stated", "observed", "inferred", "assumed"), "resolver": ("generated",), "truth_maintenance": ("retracted", "inferred"), "builder": tuple(RANKS)}


def canonical_attribute(column: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Lower case, underscores for spaces, aliases replaced; structural names stay as they are."""
    plain = F.regexp_replace(F.lower(F.trim(column)), "\\s+", "_")
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return plain if named is None else F.when(plain.isin(*STRUCTURAL), plain).otherwise(F.coalesce(F.try_element_at(named, plain), plain))


def gated(items: DataFrame, edges: DataFrame, canon: DataFrame, cursor: float | None = None, frame: str = "canon", role: str = "ingestor") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of ITEM rows numbered by ``n``.

    An item is skipped for the first of: malformed_id, role, generated_frame, valid_to_without_from, reversed_interval, bad_half_life,
    self_edge, cycle. ``edges`` (child, parent) are the places that hold now; of a batch that would close a cycle together,
    every item on the cycle is skipped. Cycles are looked for once for a batch, not item by item.
    """
    x = items.withColumn("attribute", canonical_attribute(F.col("attribute"))).withColumn("frame", F.coalesce("frame", F.lit(frame))).withColumn("status", F.coalesce("status", F.lit("stated")))
    text = text_of(F.col("value"))
    kind = F.coalesce("value_type", F.when(text.rlike(ENTITY_ID), "entity").otherwise("literal"))
    x = x.withColumn("value_type", kind).withColumn("valid_from", F.when(F.col("timeless"), F.lit(None)).otherwise(F.coalesce("valid_from", F.lit(cursor).cast("double"))))
    x = x.withColumn("target", F.when(F.col("value_type") == "entity", text))
    x = resolved(resolved(x.withColumn("raw", F.col("entity")), canon, "entity", "e"), canon, "target", "t").drop("entity").withColumnRenamed("e", "entity")
    well = F.col("raw").rlike(ENTITY_ID) & ((F.col("value_type") != "entity") | F.col("target").rlike(ENTITY_ID))
    edge = F.col("attribute").isin(*CONTAINMENT) & (F.col("value_type") == "entity")
    number = F.col("value").try_cast("double")
    reason = (
        F.when(~F.coalesce(well, F.lit(False)), "malformed_id").when(~F.col("status").isin(*ROLES[role]), "role")
        .when((F.col("status") == "generated") & ((F.col("frame") == "canon") | F.col("frame").startswith("knows:")), "generated_frame")
        .when(F.col("valid_to").isNotNull() & F.col("valid_from").isNull(), "valid_to_without_from").when(F.col("valid_to") < F.col("valid_from"), "reversed_interval")
        .when((F.col("attribute") == "half_life") & ~F.coalesce((number > 0) & (number < float("inf")), F.lit(False)), "bad_half_life")
        .when((edge | F.col("attribute").isin(*LATERAL)) & (F.col("entity") == F.col("t")), "self_edge")
    )
    x = x.withColumn("reason", reason)
    new = x.where(edge & F.col("reason").isNull()).select(F.col("entity").alias("child"), F.col("t").alias("parent"))
    moved = edges.join(new.select("child").distinct(), "child", "left_anti").select("child", "parent").union(new)
    loops = blocks_cycle(moved, new).select(F.col("child").alias("entity"), F.col("parent").alias("t"), F.lit("cycle").alias("loop"))
    x = x.join(loops, ["entity", "t"], "left").withColumn("reason", F.coalesce("reason", F.when(edge, F.col("loop"))))
    value = F.when(F.col("value_type") == "entity", F.concat(F.lit('"'), F.col("t"), F.lit('"'))).otherwise(F.col("value"))
    rows = x.where("reason is null").select("n", "entity", "attribute", "value_type", value.alias("value"), "valid_from", "valid_to", "frame", "status", "confidence", "source", "caused_by")
    return rows, x.where("reason is not null").select("n", F.col("raw").alias("entity"), "attribute", "reason")


def with_metas(rows: DataFrame, head: int) -> DataFrame:
    """Gated rows and, right after each, what is said of it (source, caused_by), numbered for dump.numbered() from ``head``."""
    said = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("attribute"), F.col(name).alias("what")))
    own = F.array_compact(F.array(F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("what")), said("source"), said("caused_by")))
    each = rows.select("*", F.posexplode(own).alias("k", "meta"))
    # One writer numbers a batch, so the window is over the batch alone.
    order = Window.orderBy("n", "k")
    each = each.withColumn("m", F.row_number().over(order).cast("long"))
    first = F.max(F.when(F.col("k") == 0, F.col("m"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("subject", F.concat(F.lit("a:"), (F.lit(head) + first).cast("string")))
    meta = F.col("k") > 0
    pick = lambda name, other: F.when(meta, other).otherwise(F.col(name)).alias(name)
    none = F.lit(None).cast("double")
    kind = F.when(F.col("meta.what").rlike(ENTITY_ID), "entity").otherwise("literal")
    return each.select(F.col("m").alias("n"), pick("entity", F.col("subject")), pick("attribute", F.col("meta.attribute")), pick("value_type", kind), pick("value", F.concat(F.lit('"'), F.col("meta.what"), F.lit('"'))), pick("valid_from", none), pick("valid_to", none), "frame", "status", pick("confidence", none))
