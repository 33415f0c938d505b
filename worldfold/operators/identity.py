"""Who is who: closures of same_as, correlations by aka, name collisions and what stands against a merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import content_tokens, text_of
from ..schema import CONTAINMENT, META
from ..storage import written
from .sizes import BROADCAST_ROWS, spread, total
from .visible import Snapshot, is_domain, visible


def edges(s: Snapshot, attribute: str) -> DataFrame:
    """(a, b) of the visible entity-valued rows of an attribute."""
    rows = visible(s, (F.col("attribute") == attribute) & (F.col("value_type") == "entity"))
    return rows.select(F.col("entity").alias("a"), text_of(F.col("value")).alias("b"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root) of every end of ``pairs`` (a, b): the least id that it is connected to.

    Labels shrink along edges and jump along labels; each round is a written table, so that plans stay short and a lost
    executor costs no more than a round.
    """
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        via = labels.select(F.col("id").alias("root"), F.col("root").alias("via"))
        new = labels.join(near, "id").join(via, "root").select("id", F.col("root").alias("old"), F.least("root", "near", "via").alias("root"))
        new = written(new, "labels")
        labels = new.select("id", "root")
        if not new.where("root < old").limit(1).count():
            return labels


def first_seen(s: Snapshot, ids: DataFrame) -> DataFrame:
    """(id, first): the first row that mentions each of ``ids`` (id), a written table, as subject or as value. Only rows that do are grouped."""
    wanted = F.broadcast(ids.select("id")) if ids.count() <= BROADCAST_ROWS else ids.select("id")
    rows = s.log.select(F.col("entity").alias("id"), "seq").union(s.log.where("value_type = 'entity'").select(text_of(F.col("value")), "seq"))
    return rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("seq").alias("first"))


def canon_map(s: Snapshot) -> DataFrame:
    """(id, canon) of entities that others are the same as: the member seen first stands for all. At the log's head, in all frames."""
    roots = components(edges(Snapshot(s.log), "same_as"))
    seen = first_seen(s, roots).join(roots, "id")
    canon = seen.groupBy("root").agg(F.min_by("id", F.struct("first", "id")).alias("canon"))
    return written(roots.join(canon, "root").select("id", "canon"), "canon")


def resolved(rows: DataFrame, canon: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: what ``column`` stands for."""
    return rows.join(canon.select(F.col("id").alias(column), F.col("canon").alias("_canon")), column, "left").withColumn(name, F.coalesce("_canon", column)).drop("_canon")


def correlations(s: Snapshot, frame: str = "canon", canon: DataFrame | None = None) -> DataFrame:
    """(id, facet): every entity and the others that aka joins it with at the snapshot, its own closure left out."""
    canon = canon_map(s) if canon is None else canon
    pairs = visible(s, (F.col("attribute") == "aka") & (F.col("value_type") == "entity") & (F.col("frame") == frame)).select(F.col("entity").alias("a"), text_of(F.col("value")).alias("b"))
    pairs = resolved(resolved(pairs, canon, "a", "ca"), canon, "b", "cb")
    groups = components(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return groups.alias("x").join(groups.alias("y"), "root").where("x.id <> y.id").select("x.id", F.col("y.id").alias("facet"))


def correlation_conflicts(s: Snapshot, frame: str = "canon") -> DataFrame:
    """(a, b): pairs said to be facets of one whom something else declares distinct."""
    pair = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    aka = visible(s, (F.col("attribute") == "aka") & (F.col("frame") == frame)).select(F.col("entity").alias("a"), text_of(F.col("value")).alias("b"))
    return pair(aka).intersect(pair(edges(Snapshot(s.log), "distinct_from")))


def anchors(s: Snapshot, frame: str | None = None) -> DataFrame:
    """(entity, anchor): names and aliases, trimmed, in lower case."""
    where = F.col("attribute").isin("name", "alias") & (F.col("value_type") == "literal")
    if frame is not None:
        where &= F.col("frame") == frame
    rows = visible(s, where).select("entity", F.lower(F.trim(text_of(F.col("value")))).alias("anchor"))
    return rows.where("anchor is not null").distinct()


def by_alias(s: Snapshot, text: str, canon: DataFrame) -> DataFrame:
    """(entity): whom a name or alias means."""
    found = anchors(s).where(F.col("anchor") == text.strip().lower())
    return resolved(found, canon, "entity", "canon").select(F.col("canon").alias("entity")).distinct()


def name_collisions(s: Snapshot, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(anchor, entities, n): texts that name more than one canonical entity."""
    named = resolved(anchors(s, frame), canon, "entity", "canon").select("anchor", "canon").distinct()
    return named.groupBy("anchor").agg(F.array_sort(F.collect_set("canon")).alias("entities"), F.count("*").alias("n")).where("n > 1")


def blocks(s: Snapshot, canon: DataFrame) -> DataFrame:
    """(a, b, reason): pairs of canonical entities that must not be merged: one contains the other, or they are declared distinct."""
    where = F.col("attribute").isin("distinct_from", *CONTAINMENT) & (F.col("value_type") == "entity") & is_domain()
    rows = visible(s, where).select("entity", text_of(F.col("value")).alias("other"), "attribute")
    rows = resolved(resolved(rows, canon, "entity", "x"), canon, "other", "y").where("x <> y")
    reason = F.when(F.col("attribute") == "distinct_from", "distinct").otherwise("containment")
    pairs = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), reason.alias("reason"))
    return spread(pairs, total(s.log), "a", "b").distinct()


def relating_edges(s: Snapshot, canon: DataFrame) -> DataFrame:
    """(a, b, attribute): what else relates two canonical entities, a soft reason against merging them."""
    skip = ("same_as", "aka", "maybe_same_as", "distinct_from", "kind", "caused_by", *CONTAINMENT, *META)
    rows = visible(s, ~F.col("attribute").isin(*skip) & (F.col("value_type") == "entity") & is_domain()).select("entity", text_of(F.col("value")).alias("other"), "attribute")
    rows = resolved(resolved(rows, canon, "entity", "x"), canon, "other", "y").where("x <> y")
    return spread(rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "attribute"), total(s.log), "a", "b").distinct()


def merge_candidates(s: Snapshot, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(a, b, anchor, decline): pairs that share a name, and the first reason against merging them (null: none).

    Reasons in order: containment, distinct, relating_edge, kind_conflict, alias_not_specific (under two telling words), kind_absent.
    """
    named = resolved(anchors(s, frame), canon, "entity", "canon").select("anchor", "canon").distinct()
    pairs = named.alias("x").join(named.alias("y"), "anchor").where("x.canon < y.canon").select(F.col("x.canon").alias("a"), F.col("y.canon").alias("b"), "anchor")
    kinds = visible(s, (F.col("attribute") == "kind") & ~F.col("entity").startswith("event:")).select("entity", "value")
    kinds = resolved(kinds, canon, "entity", "canon").groupBy("canon").agg(F.array_sort(F.collect_set("value")).alias("kinds"))
    against = blocks(s, canon).groupBy("a", "b").agg(F.min("reason").alias("reason"))
    related = relating_edges(s, canon).select("a", "b").distinct().withColumn("related", F.lit(True))
    out = pairs.join(against, ["a", "b"], "left").join(related, ["a", "b"], "left")
    out = out.join(kinds.select(F.col("canon").alias("a"), F.col("kinds").alias("ka")), "a", "left").join(kinds.select(F.col("canon").alias("b"), F.col("kinds").alias("kb")), "b", "left")
    both = F.col("ka").isNotNull() & F.col("kb").isNotNull()
    decline = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("related"), "relating_edge").when(both & ~F.arrays_overlap("ka", "kb"), "kind_conflict")
        .when(F.size(content_tokens(F.col("anchor"))) < 2, "alias_not_specific").when(~both, "kind_absent")
    )
    return out.select("a", "b", "anchor", decline.alias("decline"))


def facet_map(s: Snapshot) -> DataFrame:
    """(id, canon): as canon_map(), but facets that aka joins at the snapshot stand together as well; for folds over all of one's facets."""
    pairs = edges(Snapshot(s.log), "same_as").union(edges(s, "aka"))
    roots = components(pairs)
    seen = first_seen(s, roots).join(roots, "id")
    canon = seen.groupBy("root").agg(F.min_by("id", F.struct("first", "id")).alias("canon"))
    return written(roots.join(canon, "root").select("id", "canon"), "facets")


def proposed(s: Snapshot, canon: DataFrame) -> DataFrame:
    """(a, b): canonical entities that somebody took for one, and that nobody has merged or told apart since."""
    pair = lambda attribute: resolved(resolved(edges(Snapshot(s.log), attribute), canon, "a", "x"), canon, "b", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()
    return pair("maybe_same_as").exceptAll(pair("maybe_same_as").intersect(pair("distinct_from")))


def relations(s: Snapshot, canon: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity, attribute, other, outgoing): every entity's neighbours by what is said of it and what is said of others about it."""
    rows = visible(s, (F.col("frame") == frame) & (F.col("value_type") == "entity") & is_domain() & ~F.col("attribute").isin(*META)).select("entity", "attribute", text_of(F.col("value")).alias("other"))
    rows = resolved(resolved(rows, canon, "entity", "x"), canon, "other", "y").where("x <> y")
    both = F.explode(F.array(F.struct(F.col("x").alias("entity"), F.col("y").alias("other"), F.lit(True).alias("outgoing")), F.struct(F.col("y").alias("entity"), F.col("x").alias("other"), F.lit(False).alias("outgoing"))))
    ends = rows.select("attribute", both.alias("r")).select("r.entity", "attribute", "r.other", "r.outgoing")
    return spread(ends, 2 * total(s.log), "entity", "other").distinct()
