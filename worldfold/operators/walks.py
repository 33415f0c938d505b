"""Walks over folded and raw edges: places, parts, contents, rollups, ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import number_of, text_of
from ..schema import CONTAINED, LATERAL, META
from ..storage import kept, scratch, written
from .sizes import spread, total
from .visible import Snapshot, is_domain, visible

#: Steps after which a walk gives up; folds have one parent each, so only absurdly deep trees are cut, with an error.
DEEPEST = 1000


def told(folded: DataFrame) -> DataFrame:
    """What walks and rollups read of folds, written, for those that read it more than once: a fold is made once."""
    return written(folded.select("entity", "attribute", "frame", "branch", "winner_value", "winner_type", "conflicted", "quantity"), "folds")


def parents(folded: DataFrame, attribute: str = CONTAINED) -> DataFrame:
    """(child, parent, frame, conflicted, branch) of folded single-parent edges: containment, or ``part_of``."""
    rows = folded.where((F.col("attribute") == attribute) & (F.col("winner_type") == "entity"))
    return rows.select(F.col("entity").alias("child"), text_of(F.col("winner_value")).alias("parent"), "frame", "conflicted", "branch")


def ancestors(edges: DataFrame, start: DataFrame | None = None, through_conflicts: bool = True) -> DataFrame:
    """(node, ancestor, hop, chain) of edges (child, parent, conflicted): every ancestor, nearest first; cycles end a walk.

    One join a level, with what is left to walk: a level is a written table.
    """
    if not through_conflicts:
        edges = edges.where("not conflicted")
    with scratch(edges.sparkSession):
        edges = written(edges.select("child", "parent"), "parents")
        first = edges if start is None else edges.join(start.select(F.col("entity").alias("child")).distinct(), "child", "left_semi")
        level = written(first.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("hop"), F.array("child", "parent").alias("chain")), "level")
        levels = [level]
        while level.limit(1).count():
            if len(levels) > DEEPEST:
                raise RuntimeError(f"a walk of over {DEEPEST} steps")
            step = level.join(edges, level["ancestor"] == edges["child"]).where(~F.array_contains("chain", F.col("parent")))
            level = written(step.select("node", F.col("parent").alias("ancestor"), (F.col("hop") + 1).alias("hop"), F.array_append("chain", F.col("parent")).alias("chain")), "level")
            levels.append(level)
        out = levels[0]
        for more in levels[1:]:
            out = out.union(more)
        return kept(out, "ancestors")


def locate(folded: DataFrame, frame: str = "canon", start: DataFrame | None = None) -> DataFrame:
    """(entity, chain): where each entity is, nearest place first, up to the last."""
    up = ancestors(parents(folded).where(F.col("frame") == frame), start)
    return up.groupBy(F.col("node").alias("entity")).agg(F.max_by("chain", "hop").alias("c")).select("entity", F.slice("c", 2, 1 << 30).alias("chain"))


def composition(folded: DataFrame, frame: str = "canon") -> DataFrame:
    """(entity, chain): what each entity is part of; a contested edge ends the chain."""
    up = ancestors(parents(folded, "part_of").where(F.col("frame") == frame), through_conflicts=False)
    return up.groupBy(F.col("node").alias("entity")).agg(F.max_by("chain", "hop").alias("c")).select("entity", F.slice("c", 2, 1 << 30).alias("chain"))


def contents(folded: DataFrame, frame: str = "canon") -> DataFrame:
    """(container, child): what is directly in each container, by the folded winner."""
    return parents(folded).where(F.col("frame") == frame).select(F.col("parent").alias("container"), "child")


def features(folded: DataFrame, frame: str = "canon") -> DataFrame:
    """(place, feature): uncontested parts of each place."""
    return parents(folded, "part_of").where((F.col("frame") == frame) & ~F.col("conflicted")).select(F.col("parent").alias("place"), F.col("child").alias("feature"))


def numeric(folded: DataFrame) -> DataFrame:
    """(entity, attribute, frame, number): folded numbers and quantities; sets, booleans and thunks have none."""
    n = F.when(F.col("branch") == "accrue", F.col("quantity")).when((F.col("branch") != "set") & (F.col("winner_type") == "literal"), number_of(F.col("winner_value")))
    return folded.select("entity", "attribute", "frame", n.alias("number")).where("number is not null")


def where(folded: DataFrame, attribute: str, op: str, value: float, frame: str = "canon") -> DataFrame:
    """(entity, number) of the entities whose folded number compares so."""
    try:
        v = float(value)
    except (TypeError, ValueError):  # nothing compares with what is no number
        v = float("nan")
    n = F.col("number")
    test = {">=": n >= v, ">": n > v, "<=": n <= v, "<": n < v, "==": n == v}
    if op not in test:
        raise ValueError(f"not a comparison: {op}")
    told = F.lit(v == v) & (F.col("attribute") == attribute) & (F.col("frame") == frame)
    return numeric(folded).where(told & test[op]).select("entity", "number")


def aggregate(folded: DataFrame, attribute: str, frame: str = "canon", recursive: bool = False) -> DataFrame:
    """(container, count, sum, min, max, avg) of a folded number over what is in each container; recursively, over all below it.

    A container itself and members without a number don't count; a container without any numeric member has no row.
    """
    inside = contents(folded, frame)
    if recursive:
        inside = ancestors(parents(folded).where(F.col("frame") == frame)).select(F.col("ancestor").alias("container"), F.col("node").alias("child"))
    own = numeric(folded).where((F.col("attribute") == attribute) & (F.col("frame") == frame)).select(F.col("entity").alias("child"), "number")
    n = F.col("number")
    return inside.join(own, "child").groupBy("container").agg(F.count("*").alias("count"), F.sum(n).alias("sum"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("avg"))


def lateral_edges(s: Snapshot, frame: str = "canon", attributes: tuple[str, ...] = LATERAL) -> DataFrame:
    """(x, y) both ways: raw visible ways between places, not folded."""
    rows = visible(s, F.col("attribute").isin(*attributes) & (F.col("value_type") == "entity") & (F.col("frame") == frame)).select(F.col("entity").alias("x"), text_of(F.col("value")).alias("y"))
    return rows.union(rows.select("y", "x")).where("x <> y").distinct()


def shortest(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, path) of the requested pairs: of the shortest ways over edges (x, y) the least in order; null if there is none.

    All pairs advance together, a level at a time, each node keeping its least way; from a place to itself the way is that place.
    """
    spark = edges.sparkSession
    with scratch(spark):
        edges = written(edges, "ways")
        pairs = written(pairs.select("a", "b").distinct(), "asked")
        front = written(pairs.select("a", F.col("a").alias("at"), F.array("a").alias("path")).distinct(), "front")
        seen, open_ = front, pairs
        for _ in range(DEEPEST):
            left = open_.join(seen.select("a", F.col("at").alias("b")), ["a", "b"], "left_anti")
            if not left.limit(1).count():
                break
            alive = front.join(left.select("a").distinct(), "a", "left_semi")
            step = alive.join(edges, alive["at"] == edges["x"]).select("a", F.col("y").alias("at"), F.array_append("path", F.col("y")).alias("path"))
            front = written(step.join(seen.select("a", "at"), ["a", "at"], "left_anti").groupBy("a", "at").agg(F.min("path").alias("path")), "front")
            if not front.limit(1).count():
                break
            seen = written(seen.union(front), "seen")
            open_ = left
        else:
            raise RuntimeError(f"ways of more than {DEEPEST} steps")
        return kept(pairs.join(seen.withColumnRenamed("at", "b"), ["a", "b"], "left").select("a", "b", "path"), "paths")


def portals(s: Snapshot, folded: DataFrame, frame: str = "canon") -> DataFrame:
    """(place, status): how every entity lets one pass: clear, blocked or obscured.

    A kind's policy (rows blocks_state and blocks_relation on ``traversal:<kind>``) names the states and relations that block. No
    policy is clear; a blocking relation blocks; no folded state, or one yet to be made up, obscures; a blocking state blocks.
    """
    said = visible(Snapshot(s.log), F.col("entity").startswith("traversal:") & F.col("attribute").isin("blocks_state", "blocks_relation"))
    said = said.select(F.regexp_replace("entity", "^traversal:", "").alias("kind"), "attribute", F.coalesce(text_of(F.col("value")), F.col("value")).alias("what"))
    policy = said.groupBy("kind").agg(F.collect_set(F.when(F.col("attribute") == "blocks_state", F.col("what"))).alias("states"), F.collect_set(F.when(F.col("attribute") == "blocks_relation", F.col("what"))).alias("relations"))
    own = folded.where(F.col("frame") == frame)
    kinds = own.where("attribute = 'kind'").select(F.col("entity").alias("place"), text_of(F.col("winner_value")).alias("kind"))
    state = own.where("attribute = 'state'").select(F.col("entity").alias("place"), "winner_type", F.coalesce(text_of(F.col("winner_value")), F.col("winner_value")).alias("state"))
    related = visible(s, (F.col("frame") == frame) & is_domain()).groupBy(F.col("entity").alias("place")).agg(F.collect_set("attribute").alias("has"))
    all_ = kinds.join(policy, "kind", "left").join(state, "place", "left").join(related, "place", "left")
    status = (
        F.when(F.col("states").isNull(), "clear").when(F.arrays_overlap("relations", "has"), "blocked").when(F.col("winner_type").isNull() | (F.col("winner_type") == "unresolved"), "obscured")
        .when(F.array_contains("states", F.col("state")), "blocked").otherwise("clear")
    )
    return all_.select("place", status.alias("status"))


def route(s: Snapshot, folded: DataFrame, pairs: DataFrame, frame: str = "canon") -> DataFrame:
    """(a, b, status, path): a clear way if there is one, else the shortest way with the worst that stands in it, else no_path."""
    edges, gates = lateral_edges(s, frame), portals(s, folded, frame).where("status <> 'clear'")
    shut = gates.select(F.col("place").alias("p"))
    open_ = edges.join(shut, F.col("x") == F.col("p"), "left_anti").join(shut, F.col("y") == F.col("p"), "left_anti")
    free = pairs.join(shut, F.col("a") == F.col("p"), "left_anti").join(shut, F.col("b") == F.col("p"), "left_anti")
    clear = shortest(open_, free).select("a", "b", F.col("path").alias("clear"))
    any_ = shortest(edges, pairs).join(clear, ["a", "b"], "left")
    stops = any_.select("a", "b", F.explode("path").alias("p")).join(gates.withColumnRenamed("place", "p"), "p").groupBy("a", "b").agg(F.min("status").alias("worst"))
    status = F.when(F.col("clear").isNotNull(), "clear").when(F.col("path").isNull(), "no_path").otherwise(F.coalesce("worst", F.lit("clear")))
    return any_.join(stops, ["a", "b"], "left").select("a", "b", status.alias("status"), F.coalesce("clear", "path").alias("path"))


def former_passages(s: Snapshot, frame: str = "canon") -> DataFrame:
    """(x, y, closed): ways that had ended by the snapshot's valid time."""
    if s.valid_as_of is None:
        return s.log.limit(0).select(F.col("entity").alias("x"), F.col("value").alias("y"), F.col("valid_to").alias("closed"))
    rows = visible(Snapshot(s.log, None, s.asserted_as_of), F.col("attribute").isin(*LATERAL) & (F.col("frame") == frame) & (F.col("valid_to") <= s.valid_as_of))
    return rows.select(F.col("entity").alias("x"), text_of(F.col("value")).alias("y"), F.col("valid_to").alias("closed"))


def incoming(s: Snapshot, frame: str = "canon") -> DataFrame:
    """(target, n): distinct subjects that refer to an entity."""
    rows = visible(s, (F.col("frame") == frame) & (F.col("value_type") == "entity") & is_domain() & ~F.col("attribute").isin(*META))
    pairs = spread(rows.select(text_of(F.col("value")).alias("target"), "entity"), total(s.log), "target", "entity").distinct()
    return pairs.groupBy("target").agg(F.count("entity").alias("n"))


def neighborhood(s: Snapshot, folded: DataFrame, start: DataFrame, ranking: DataFrame, depth: int = 1, max_fanout: int = 64, frame: str = "canon") -> DataFrame:
    """(root, node, via, hop): what lies within ``depth`` (at most 3) steps over places, ways, events and relations.

    Of each node's neighbours the ``max_fanout`` of the highest salience (entity, salience in ``ranking``) are followed.
    """
    up = parents(folded).where(F.col("frame") == frame)
    place = up.select(F.col("child").alias("x"), F.col("parent").alias("y")).union(up.select("parent", "child"))
    part = visible(s, (F.col("frame") == frame) & F.col("attribute").isin("agent", "patient") & F.col("entity").startswith("event:")).select(F.col("entity").alias("x"), text_of(F.col("value")).alias("y"))
    relation = folded.where((F.col("frame") == frame) & (F.col("winner_type") == "entity") & ~F.col("attribute").isin(CONTAINED, *LATERAL)).select(F.col("entity").alias("x"), text_of(F.col("winner_value")).alias("y"))
    kinds = [("containment", place), ("lateral", lateral_edges(s, frame)), ("event", part.union(part.select("y", "x"))), ("relation", relation)]
    all_: DataFrame | None = None
    for name, edges in kinds:
        own = edges.select("x", "y", F.lit(name).alias("via"))
        all_ = own if all_ is None else all_.union(own)
    ranked = all_.groupBy("x", "y").agg(F.min("via").alias("via")).join(ranking.select(F.col("entity").alias("y"), "salience"), "y", "left")
    best = F.row_number().over(Window.partitionBy("x").orderBy(F.coalesce("salience", F.lit(0.0)).desc(), "y"))
    with scratch(s.log.sparkSession):
        near = written(ranked.withColumn("k", best).where(F.col("k") <= max_fanout).select("x", "y", "via"), "near")
        front = written(start.select(F.col("entity").alias("root"), F.col("entity").alias("node"), F.lit(None).cast("string").alias("via"), F.lit(0).cast("long").alias("hop")), "front")
        seen = front
        for hop in range(1, max(0, min(depth, 3)) + 1):
            step = front.join(near, front["node"] == near["x"]).groupBy("root", "y").agg(F.min(near["via"]).alias("via"))
            new = step.withColumnRenamed("y", "node").join(seen.select("root", "node"), ["root", "node"], "left_anti")
            front = written(new.select("root", "node", "via", F.lit(hop).cast("long").alias("hop")), "front")
            seen = seen.union(front)
        return kept(seen, "neighborhood")


def blocks_cycle(edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Rows (child, parent) of ``proposed`` that would put a thing into itself, directly or through what it holds."""
    up = ancestors(edges.select("child", "parent", F.lit(False).alias("conflicted"))).select(F.col("node").alias("parent"), F.col("ancestor").alias("child"))
    direct = proposed.where("child = parent").select("child", "parent")
    return direct.union(proposed.join(up, ["child", "parent"], "left_semi").select("child", "parent")).distinct()


def chain_text(column: str = "chain") -> Column:
    return F.array_join(column, ">")
