"""How far to trust a folded value, and how much an entity matters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import number_of
from ..schema import CONTAINED, META
from ..storage import kept
from .classify import classified
from .fold import KEY, keyed
from .identity import resolved
from .semantics import Policy
from .sizes import spread, total
from .visible import Snapshot, is_domain, metas, visible
from .walks import incoming

PROVENANCE = {"stated": 1.0, "observed": 1.0, "inferred": 0.6, "generated": 0.4, "assumed": 0.3}


def half_lives(s: Snapshot) -> DataFrame:
    """(attribute, half_life): declared decay; the last valid one of each attribute."""
    rows = visible(Snapshot(s.log), F.col("entity").startswith("attr:") & (F.col("attribute") == "half_life")).select(F.regexp_replace("entity", "^attr:", "").alias("attribute"), number_of(F.col("value")).alias("n"), "asserted_at")
    ok = (F.col("n") > 0) & (F.col("n") < float("inf")) & ~F.isnan("n")
    return rows.where(ok).groupBy("attribute").agg(F.max_by("n", "asserted_at").alias("half_life"))


def stamps(s: Snapshot, rows: DataFrame, folded: DataFrame) -> DataFrame:
    """(key, stamp): the last wall-clock time at which a first-hand row strictly said what the winner says."""
    told = metas(s, "learned_at_wallclock").select("id", number_of(F.col("value")).alias("told"))
    win = rows.select("id", F.col("same").alias("w_same"))
    of = folded.select(*KEY, F.col("winner_id").alias("id")).join(win, "id").drop("id")
    first_hand = rows.where("status in ('stated', 'observed')").join(told, "id")
    return first_hand.join(of, KEY).where("same = w_same").groupBy(*KEY).agg(F.max("told").alias("stamp"))


def confidence(s: Snapshot, policy: Policy, canon: DataFrame, folded: DataFrame, now: float | None = None) -> DataFrame:
    """(key, provenance, recency, recency_state, corroboration, confidence) of every single-valued folded key.

    0.45 provenance, 0.30 recency, 0.25 corroboration (log of further source classes); without recency the others are
    rescaled; a conflict halves it. Recency counts only where ``now`` is given.
    """
    if now is not None and not math.isfinite(now):
        raise ValueError("now must be finite")
    rows = keyed(s, policy, canon)
    win = folded.where("branch not in ('set', 'accrue')").select(*KEY, "winner_id", "winner_status", "conflicted", "corroborated_by")
    # A winner is a row of its key, so that all is found where the rows of a key lie.
    own, per = F.col("id") == F.col("winner_id"), Window.partitionBy(*KEY)
    match = win.join(rows.select(*KEY, "id", "same", "source_class", "confidence"), KEY, "left")
    match = match.withColumns({"w_same": F.max(F.when(own, F.col("same"))).over(per), "confidence": F.max(F.when(own, F.col("confidence"))).over(per)})
    counted = F.coalesce((F.col("same") == F.col("w_same")) | own | F.array_contains("corroborated_by", F.col("id")), F.lit(False))
    served = [*KEY, "winner_status", "conflicted", "confidence"]
    classes = match.groupBy(*served, "source_class").agg(F.max(counted.cast("int")).alias("hit")).groupBy(*served).agg(F.greatest(F.sum("hit") - 1, F.lit(0)).alias("further"))
    given = F.coalesce(*[F.when(F.col("winner_status") == k, F.lit(v)) for k, v in PROVENANCE.items()], F.lit(0.3))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    out = classes.withColumn("provenance", F.when(F.col("confidence").isNull(), given).otherwise(F.least(given, clamped)))
    out = out.withColumn("corroboration", F.log1p(F.coalesce("further", F.lit(0)).cast("double")) / F.lit(math.log1p(4)))
    if now is None:
        out = out.withColumn("recency", F.lit(1.0)).withColumn("recency_state", F.lit("permanent"))
    else:
        lives = half_lives(s)
        named = lives.withColumnRenamed("half_life", "own")
        world = lives.where("attribute in ('in', '__world__')").groupBy().agg(F.max(F.when(F.col("attribute") == "in", F.col("half_life"))).alias("inside"), F.max(F.when(F.col("attribute") == "__world__", F.col("half_life"))).alias("all"))
        out = out.join(named, "attribute", "left").crossJoin(F.broadcast(world)).join(stamps(s, rows, folded), KEY, "left")
        life = F.coalesce("own", F.when(F.col("attribute") == CONTAINED, F.col("inside")), "all")
        age = F.when(F.lit(now) > F.col("stamp"), F.lit(now) - F.col("stamp")).otherwise(0.0)
        out = out.withColumn("recency", F.when(life.isNotNull() & F.col("stamp").isNotNull(), F.pow(F.lit(2.0), -age / life)))
        out = out.withColumn("recency_state", F.when(life.isNull(), "unconfigured").when(F.col("stamp").isNull(), "unconfirmed").otherwise("configured"))
    base = 0.45 * F.col("provenance") + 0.25 * F.col("corroboration")
    score = F.when(F.col("recency").isNull(), base / 0.70).otherwise(base + 0.30 * F.col("recency"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * F.when(F.col("conflicted"), 0.5).otherwise(1.0)))
    return out.select(*KEY, "provenance", "recency", "recency_state", "corroboration", score.alias("confidence"))


def confidence_over(single: DataFrame, folded: DataFrame, *frames: str) -> DataFrame:
    """(entity, attribute, confidence, frame): of several frames the one whose winner is latest, halved if they disagree."""
    rows = folded.where(F.col("frame").isin(*frames) & ~F.col("branch").isin("set", "accrue"))
    order = F.struct(F.coalesce("winner_from", F.lit(float("-inf"))), F.regexp_replace("winner_id", "^a:", "").cast("long"))
    both = rows.groupBy("entity", "attribute").agg(F.max_by("frame", order).alias("frame"), (F.min("winner_value") != F.max("winner_value")).alias("split"), F.max_by("conflicted", order).alias("own"))
    return both.join(single, KEY).select("entity", "attribute", "frame", (F.col("confidence") * F.when(F.col("split") & ~F.col("own"), 0.5).otherwise(1.0)).alias("confidence"))


def salience(s: Snapshot, policy: Policy, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity, recency, references, reinforcement, delta, salience) of every entity of a frame.

    0.40 how late it was last spoken of, 0.25 how many refer to it, 0.20 at how many times something is said of it, 0.15 whether a
    state of it has changed since its first.
    """
    rows = resolved(classified(visible(s, (F.col("frame") == frame) & is_domain() & ~F.col("attribute").isin(*META))), canon, "entity", "canon")
    moment = F.when(F.expr("durability = 'STATE' and value_type <> 'delta'"), F.struct(F.coalesce("valid_from", F.lit(float("-inf"))).alias("t"), "asserted_at"))
    rows = spread(rows.select(F.col("canon").alias("entity"), policy.fold_attribute().alias("attribute"), "valid_from", "asserted_at", moment.alias("moment")), total(s.log), "entity")
    per = Window.partitionBy("entity", "attribute")
    rows = rows.withColumn("changed", F.max("moment").over(per) > F.min("moment").over(per))
    head = s.log.agg(F.coalesce(F.max("asserted_at"), F.lit(1)).alias("head"))
    each = rows.groupBy("entity").agg(F.max("asserted_at").alias("last"), (F.count_distinct("valid_from") + F.max(F.col("valid_from").isNull().cast("int"))).alias("times"), F.max(F.col("changed").cast("double")).alias("delta"))
    log8: Column = F.lit(math.log1p(8))
    refs = resolved(incoming(s, frame), canon, "target", "canon").groupBy(F.col("canon").alias("entity")).agg(F.sum("n").alias("n"))
    out = each.join(refs, "entity", "left").crossJoin(F.broadcast(head))
    out = out.select(
        "entity", (F.col("last") / F.col("head")).alias("recency"), F.least(F.lit(1.0), F.log1p(F.coalesce("n", F.lit(0)).cast("double")) / log8).alias("references"),
        F.least(F.lit(1.0), F.log1p(F.col("times").cast("double")) / log8).alias("reinforcement"), F.coalesce("delta", F.lit(0.0)).alias("delta"),
    )
    return out.withColumn("salience", 0.40 * F.col("recency") + 0.25 * F.col("references") + 0.20 * F.col("reinforcement") + 0.15 * F.col("delta"))


def budgeted(facts: DataFrame, ranking: DataFrame, budget: int, by: list[str] | None = None) -> DataFrame:
    """Rows (entity, branch, winner_id, …): constitutive ones all, of the rest the ``budget`` of most salient, latest rows; per ``by``, if given."""
    rows = facts.join(ranking.select("entity", "salience"), "entity", "left").withColumn("exempt", F.col("branch") == "constitutive")
    order = [F.coalesce("salience", F.lit(0.0)).desc(), F.regexp_replace("winner_id", "^a:", "").cast("long").desc()]
    if by is None:  # a top-k: every partition keeps its own first
        rows = kept(rows, "ranked")
        top = rows.where("not exempt").orderBy(*order).limit(budget)
        return rows.where("exempt").union(top).drop("exempt")
    k = F.row_number().over(Window.partitionBy(*by, "exempt").orderBy(*order))
    return rows.withColumn("k", k).where(F.col("exempt") | (F.col("k") <= budget)).drop("k", "exempt")
