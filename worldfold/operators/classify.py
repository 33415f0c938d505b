"""Durability of assertions by rule, and habits found in repeated observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CONTAINMENT, META, NAMES, STRUCTURAL
from .visible import Snapshot, is_domain, visible


def _rule() -> Column:
    """(durability, confidence) of a row, the first rule that fits."""
    e, a, kind = F.col("entity"), F.col("attribute"), F.col("value_type")
    give = lambda name, sure: F.struct(F.lit(name).alias("durability"), F.lit(sure).alias("class_confidence"))
    return (
        F.when(kind == "delta", give("STATE", 1.0))
        .when(e.startswith("event:") | (a == "caused_by"), give("EVENT", 1.0))
        .when(a.isin(*NAMES), give("CONSTITUTIVE", 0.95))
        .when(a.isin(*META), give("EVENT", 1.0))
        .when(kind == "unresolved", give("STATE", 1.0))
        .when(a.isin("held_by", "worn_by", "carried_by"), give("STATE", 0.95))
        .when(a.isin(*CONTAINMENT) & e.startswith("place:"), give("CONSTITUTIVE", 0.9))
        .when(a.isin(*CONTAINMENT), give("STATE", 0.5))
        .when(a.isin(*STRUCTURAL), give("CONSTITUTIVE", 1.0))
        .otherwise(give("STATE", 0.5))
    )


def classified(rows: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """``rows`` with durability, class_confidence and needs_review; a judgement in ``sidecar`` (id, durability, class_confidence) goes before the rules."""
    out = rows.withColumn("_rule", _rule())
    if sidecar is None:
        named = [F.col("_rule.durability").alias("durability"), F.col("_rule.class_confidence").alias("class_confidence")]
    else:
        out = out.join(sidecar.select("id", F.col("durability").alias("_d"), F.col("class_confidence").alias("_c")), "id", "left")
        named = [F.coalesce("_d", "_rule.durability").alias("durability"), F.coalesce("_c", "_rule.class_confidence").alias("class_confidence")]
    out = out.select(*rows.columns, *named)
    return out.withColumn("needs_review", (F.col("durability") == "CONSTITUTIVE") & (F.col("class_confidence") < 0.6))


def promoted(s: Snapshot, threshold: int = 3, accrues: tuple[str, ...] = ()) -> DataFrame:
    """(id, durability, class_confidence) of the STATE rows that say one thing at ``threshold`` distinct times: habits."""
    rows = classified(visible(s, is_domain() & ~F.col("attribute").isin(*META, *accrues) & ~F.col("value_type").isin("unresolved", "delta")))
    rows = rows.where("durability = 'STATE'")
    key = ["entity", "attribute", "frame", "value"]
    often = rows.groupBy(*key).agg((F.count_distinct("valid_from") + F.max(F.col("valid_from").isNull().cast("int"))).alias("times")).where(F.col("times") >= threshold)
    return rows.join(often, key, "left_semi").select("id", F.lit("DISPOSITIONAL").alias("durability"), F.lit(0.8).alias("class_confidence"))
