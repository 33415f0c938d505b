"""Registered queries of the world-state operators over the sample world, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import content_tokens, text_of
from ..operators import classify, corrections, fold, identity, knowledge, trust, visible, walks
from ..operators.semantics import Policy
from ..operators.visible import Snapshot
from ..schema import CONTAINED
from ..sources.sample_world import ACCRUES, duckdb_log, sample_log
from ..storage import UNLISTED, exists, kept

#: The day that as-of queries read the sample world at.
T = 10500.0
POLICY = Policy(accrues=ACCRUES)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOG = f"with recursive log as materialized ({duckdb_log()}),\n"
_RETRACTED = "not exists (select 1 from log r where r.attribute = 'retracts' and r.entity = l.id)"
_AT = f"(valid_from is null or valid_from <= {T}) and (valid_to is null or valid_to > {T})"
_VIS = _LOG + f"vis as materialized (select *, trim(value, '\"') as txt from log l where status <> 'retracted' and {_AT} and {_RETRACTED}),\nev as (select *, trim(value, '\"') as txt from log l where status <> 'retracted' and {_RETRACTED}),\n"
_SAME = """same as (select entity a, txt b from ev where attribute = 'same_as' union select txt, entity from ev where attribute = 'same_as'),
reach(id, other) as (select a, a from same union select reach.id, same.b from reach join same on reach.other = same.a),
seen as (select id, min(seq) as first from (select entity as id, seq from log union all select trim(value, '"'), seq from log where value_type = 'entity') group by id),
canon as (select r.id, arg_min(r.other, (s.first, r.other)) as canon from reach r join seen s on s.id = r.other group by r.id),
"""
_CANON = _VIS + _SAME
_CONTAIN = "('in', 'within', 'held_by', 'worn_by', 'carried_by')"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample world's log, ingested once in a session and read from its table ever after, as a log is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not exists(spark, _STORED[key].inputFiles()[0]):
        _STORED[key] = kept(sample_log(spark, sf_dir), "log", **UNLISTED)
    return _STORED[key]


def snapshot(spark: SparkSession, sf_dir: str, t: float | None = T) -> Snapshot:
    return Snapshot(stored_log(spark, sf_dir), t)


def no_canon(s: Snapshot) -> DataFrame:
    """For keys whose entities nothing is the same as."""
    return s.log.sparkSession.sql("select '' as id, '' as canon where false")


def places(s: Snapshot) -> DataFrame:
    return fold.fold(s, POLICY, no_canon(s), where=F.col("attribute").isin(*POLICY.containment))


@query(_VIS + "x as (select 1) select attribute, frame, status, count(*) as n, max(seq) as last, count(valid_from) as timed from vis group by 1, 2, 3")
def visible_asof(spark, d):
    return visible.visible(snapshot(spark, d)).groupBy("attribute", "frame", "status").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.count("valid_from").alias("timed"))


@query(_LOG + "x as (select 1) select l.id, l.entity, l.attribute, l.valid_from from log l where l.attribute like 'last\\_%' escape '\\' and " + _RETRACTED)
def retraction_antijoin(spark, d):
    return visible.visible(snapshot(spark, d, None), F.col("attribute").startswith("last_")).select("id", "entity", "attribute", "valid_from")


@query(_LOG + "x as (select 1) select max(asserted_at) as asserted_head, max(valid_from) as valid_head from log")
def axis_heads(spark, d):
    return visible.axis_heads(stored_log(spark, d))


@query(_LOG + "x as (select 1) select * from log where id = 'a:1004'")
def point_lookup(spark, d):
    return visible.get(stored_log(spark, d), "a:1004")


@query(
    _VIS + """src as (select entity as id, string_agg(txt, '>' order by seq) as chain from ev where attribute = 'source' and entity like 'a:%' group by 1)
select v.id, v.entity, v.attribute, v.value, coalesce(s.chain, '') as source_chain from ev v left join src s on s.id = v.id where v.attribute like 'last%' and v.frame = 'canon'"""
)
def facts_scan(spark, d):
    rows = visible.facts(snapshot(spark, d, None), "canon", "person:user_").where(F.col("attribute").startswith("last"))
    return rows.select("id", "entity", "attribute", "value", F.array_join("source_chain", ">").alias("source_chain"))


@query(
    _VIS + """x as (select *, case when value_type = 'delta' then 'STATE' when entity like 'event:%' or attribute = 'caused_by' then 'EVENT' when attribute in ('name', 'alias') then 'CONSTITUTIVE'
 when attribute in ('retracts', 'source', 'resolved_by') then 'EVENT' when value_type = 'unresolved' then 'STATE' when attribute in ('held_by', 'worn_by', 'carried_by') then 'STATE'
 when attribute in ('in', 'within') and entity like 'place:%' then 'CONSTITUTIVE' when attribute in ('in', 'within') then 'STATE'
 when attribute in ('kind', 'connects_to', 'adjacent_to', 'part_of') then 'CONSTITUTIVE' else 'STATE' end as durability from vis)
select attribute, durability, count(*) as n from x group by 1, 2"""
)
def classify_rules(spark, d):
    return classify.classified(visible.visible(snapshot(spark, d))).groupBy("attribute", "durability").agg(F.count("*").alias("n"))


@query(
    _VIS + """m as (select entity, frame, value from ev where attribute = 'mood' group by 1, 2, 3 having count(distinct valid_from) >= 3)
select e.id, 'DISPOSITIONAL' as durability, 0.8 as class_confidence from ev e join m on e.entity = m.entity and e.frame = m.frame and e.value = m.value where e.attribute = 'mood'"""
)
def promote_accruals(spark, d):
    s = snapshot(spark, d, None)
    habits = classify.promoted(Snapshot(s.log.where("attribute in ('mood', 'retracts')")), 3, ACCRUES)
    return habits.withColumn("class_confidence", F.col("class_confidence"))


_HELD = """k as (select *, coalesce(nullif(valid_from, 0), '-infinity'::double) as vf_or from vis where attribute in ('held_by', 'in') and not (entity like 'place:%')),
top as (select entity, max((vf_or, asserted_at)) as t from k group by 1),
w as (select k.entity, k.valid_from from k join top on k.entity = top.entity and (k.vf_or, k.asserted_at) = top.t),
tied as (select k.* from k join w on k.entity = w.entity and k.valid_from is not distinct from w.valid_from),
f as (select entity, count(distinct value) > 1 as conflicted, case when count(distinct value) > 1 then arg_min(id, asserted_at) else arg_max(id, asserted_at) end as winner_id,
 case when count(distinct value) > 1 then arg_min(txt, asserted_at) else arg_max(txt, asserted_at) end as place, case when count(distinct value) > 1 then string_agg(id, ',' order by seq) else '' end as conflicting from tied group by 1)"""


@query(_VIS + _HELD + " select entity, winner_id, place, conflicted, conflicting from f")
def fold_containment_move(spark, d):
    rows = places(snapshot(spark, d)).where(~F.col("entity").startswith("place:"))
    return rows.select("entity", "winner_id", text_of(F.col("winner_value")).alias("place"), "conflicted", F.array_join("conflicting", ",").alias("conflicting"))


@query(_VIS + _HELD + " select entity, conflicting from f where conflicted")
def fold_simultaneity_conflicts(spark, d):
    return fold_containment_move(spark, d).where("conflicted").select("entity", "conflicting")


@query(_VIS + _HELD + ", c as (select entity, 'in' as attribute, 'canon' as frame, 'cross_source' as kind from f where conflicted) select * from c")
def conflict_scan(spark, d):
    return fold.conflicts(places(snapshot(spark, d)))


_UP = _HELD + """, up as (select entity as child, place as parent from f union all select entity, txt from vis where entity like 'place:%' and attribute = 'in'),
walk(node, anc, hop, chain) as (select child, parent, 1, parent from up union all select w.node, u.parent, w.hop + 1, w.chain || '>' || u.parent from walk w join up u on u.child = w.anc where w.hop < 20)"""


@query(_VIS + _UP + ", best as (select node, arg_max(chain, hop) as chain, max(hop) as depth from walk group by 1) select node as entity, chain, cast(depth as bigint) as depth from best where node like 'obj:part%'")
def locate_chain(spark, d):
    s = snapshot(spark, d)
    folded = walks.told(places(s))
    start = folded.where(F.col("entity").startswith("obj:part")).select("entity")
    found = walks.locate(folded, start=start)
    return found.select("entity", F.array_join("chain", ">").alias("chain"), F.size("chain").cast("long").alias("depth"))


@query(_VIS + _UP + " select parent as container, count(*) as n, min(child) as first, max(child) as last from up group by 1")
def contents(spark, d):
    inside = walks.contents(places(snapshot(spark, d)))
    return inside.groupBy("container").agg(F.count("*").alias("n"), F.min("child").alias("first"), F.max("child").alias("last"))


@query(_VIS + _UP + " select anc as container, count(*) as n, max(hop) as deepest from walk group by 1")
def subtree_scope(spark, d):
    up = walks.ancestors(walks.parents(places(snapshot(spark, d))))
    return up.groupBy(F.col("ancestor").alias("container")).agg(F.count("*").alias("n"), F.max("hop").cast("int").alias("deepest"))


_PRICE = ", num as (select entity, cast(value as double) as x from vis where attribute = 'retailprice')"
_ROLL = "count(*) as count, round(sum(x), 4) as sum, min(x) as min, max(x) as max, round(avg(x), 6) as avg"


def _rollup(spark, d, recursive):
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, no_canon(s), where=F.col("attribute").isin("retailprice", *POLICY.containment))
    return walks.aggregate(walks.told(folded), "retailprice", recursive=recursive).withColumn("sum", F.round("sum", 4)).withColumn("avg", F.round("avg", 6))


@query(_VIS + _UP + _PRICE + f" select parent as container, {_ROLL} from up join num on num.entity = up.child group by 1")
def aggregate_members(spark, d):
    return _rollup(spark, d, False)


@query(_VIS + _UP + _PRICE + f" select anc as container, {_ROLL} from walk join num on num.entity = walk.node group by 1")
def aggregate_recursive(spark, d):
    return _rollup(spark, d, True)


@query(
    _VIS + """p as (select entity, count(distinct txt) > 1 as conflicted, arg_min(txt, seq) as parent from vis where attribute = 'part_of' group by 1),
walk(node, anc, hop, chain) as (select entity, parent, 1, parent from p where not conflicted union all select w.node, p.parent, w.hop + 1, w.chain || '>' || p.parent from walk w join p on p.entity = w.anc where not p.conflicted)
select node as entity, arg_max(chain, hop) as chain from walk group by 1"""
)
def composition(spark, d):
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, no_canon(s), where=F.col("attribute") == "part_of")
    return walks.composition(folded).select("entity", F.array_join("chain", ">").alias("chain"))


@query(_VIS + "p as (select entity, count(distinct txt) > 1 as conflicted, arg_min(txt, seq) as parent from vis where attribute = 'part_of' group by 1) select parent as place, entity as feature from p where not conflicted")
def features(spark, d):
    s = snapshot(spark, d)
    return walks.features(fold.fold(s, POLICY, no_canon(s), where=F.col("attribute") == "part_of"))


@query(
    _VIS + """c as (select entity, attribute, min(value) <> max(value) as conflicted, arg_min(id, seq) as winner_id, string_agg(id, ',' order by seq) as ids from vis where attribute = 'kind' and entity not like 'event:%' group by 1, 2)
select entity, winner_id, conflicted, case when conflicted then ids else '' end as conflicting from c"""
)
def fold_constitutive(spark, d):
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, no_canon(s), where=(F.col("attribute") == "kind") & ~F.col("entity").startswith("event:"))
    return folded.select("entity", "winner_id", "conflicted", F.array_join("conflicting", ",").alias("conflicting"))


@query(
    _VIS + """m as (select entity, value, max((coalesce(valid_from, '-infinity'::double), asserted_at)) as o from vis where attribute = 'name' and entity like 'obj:%' group by 1, 2)
select entity, string_agg(value, ',' order by o[2]) as members, arg_max(value, o) as newest from m group by 1"""
)
def fold_set_valued(spark, d):
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, no_canon(s), where=(F.col("attribute") == "name") & F.col("entity").startswith("obj:"))
    return folded.select("entity", F.array_join("members", ",").alias("members"), F.col("winner_value").alias("newest"))


_SPEND = "q as (select entity, round(sum(cast(value as double)), 4) as quantity, arg_max(id, (coalesce(valid_from, '-infinity'::double), asserted_at)) as winner_id from {rows} where attribute = 'spend' group by 1) select * from q"


def _spend(s: Snapshot) -> DataFrame:
    folded = fold.fold(s, POLICY, no_canon(s), where=F.col("attribute") == "spend")
    return folded.select("entity", F.round("quantity", 4).alias("quantity"), "winner_id")


@query(_VIS + _SPEND.format(rows="ev"))
def fold_accrue(spark, d):
    return _spend(snapshot(spark, d, None))


@query(_VIS + _SPEND.format(rows="vis"))
def fold_accrue_asof(spark, d):
    return _spend(snapshot(spark, d))


@query(_VIS + "r as (select entity, id, cast(value as double) as x, coalesce(valid_from, '-infinity'::double) as vf, asserted_at from ev where attribute = 'spend') select entity, id, round(sum(x) over (partition by entity order by vf, asserted_at), 4) as running from r")
def ledger_running(spark, d):
    s = snapshot(spark, d, None)
    spends = Snapshot(s.log.where("attribute in ('spend', 'retracts')"))
    return fold.ledger(spends, POLICY, no_canon(s)).select("entity", "id", F.round("running", 4).alias("running"))


@query(
    _VIS + """r as (select *, case status when 'inferred' then 1 else 3 end as rank from vis where attribute = 'segment'), b as (select entity, max(rank) as best from r group by 1)
select r.entity, arg_max(r.id, r.seq) as winner_id, arg_max(r.txt, r.seq) as segment, arg_max(r.status, r.seq) as status from r join b on r.entity = b.entity and r.rank = b.best group by 1"""
)
def fold_evidence_rank(spark, d):
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, no_canon(s), where=F.col("attribute") == "segment")
    return folded.select("entity", "winner_id", text_of(F.col("winner_value")).alias("segment"), F.col("winner_status").alias("status"))


_CLASS = """src as (select s.entity as id, string_agg(distinct coalesce(c.canon, s.txt), '|' order by coalesce(c.canon, s.txt)) filter (s.txt like 'doc:%') as docs, string_agg(distinct coalesce(c.canon, s.txt), '|' order by coalesce(c.canon, s.txt)) filter (s.txt not like 'doc:%') as people
 from ev s left join canon c on c.id = s.txt where s.attribute = 'source' group by 1),
k as (select coalesce(c.canon, v.entity) as ent, v.attribute as att, v.frame as fr, v.*, case status when 'inferred' then 1 else 3 end as rank, case when status = 'inferred' then 'inferred' when docs is not null then 'document:' || docs when people is not null then 'speaker:' || people else 'direct' end as cls
 from ev v left join canon c on c.id = v.entity left join src on src.id = v.id where v.attribute like 'last%'),
b as (select ent, att, fr, max(rank) as best from k group by 1, 2, 3),
cw as (select k.ent as entity, k.att as attribute, k.fr as frame, cls as source_class, arg_max(k.id, (coalesce(nullif(k.valid_from, 0), '-infinity'::double), k.asserted_at)) as winner_id, min(k.seq) as first_seq from k join b on b.ent = k.ent and b.att = k.att and b.fr = k.fr and k.rank = b.best group by 1, 2, 3, 4)"""


def _last(spark, d) -> tuple[Snapshot, DataFrame]:
    s = snapshot(spark, d, None)
    return s, identity.canon_map(s)


@query(_CANON + _CLASS + " select * from cw")
def fold_source_class(spark, d):
    s, canon = _last(spark, d)
    return fold.class_winners(s, fold.keyed(s, POLICY, canon, where=F.col("attribute").startswith("last_")))


_SERVED = _CLASS + """, one as (select cw.entity, cw.attribute, cw.frame, count(*) as classes, arg_min(winner_id, cast(replace(winner_id, 'a:', '') as bigint)) as first_id, string_agg(winner_id, ',' order by cast(replace(winner_id, 'a:', '') as bigint)) as ids, list(l.value) as vals, arg_min(l.value, cast(replace(winner_id, 'a:', '') as bigint)) as v0 from cw join log l on l.id = cw.winner_id group by cw.entity, cw.attribute, cw.frame)"""


@query(_CANON + _SERVED + " select entity, attribute, frame, first_id as winner_id, classes > 1 as conflicted, case when classes > 1 then ids else '' end as conflicting from one where len(list_filter(vals, lambda x: x = v0)) = 1")
def fold_cross_source(spark, d):
    """Keys whose first class nobody agrees with: it is served and conflicts with every other."""
    s, canon = _last(spark, d)
    folded = fold.fold(s, POLICY, canon, where=F.col("attribute").startswith("last_"))
    return folded.where("size(corroborated_by) = 0").select("entity", "attribute", "frame", "winner_id", "conflicted", F.array_join("conflicting", ",").alias("conflicting"))


@query(_VIS + "x as (select entity, attribute, frame, id as winner_id from vis where value_type = 'unresolved' and id not in (select entity from ev where attribute = 'resolved_by')) select * from x")
def thunk_table(spark, d):
    s = snapshot(spark, d)
    return fold.open_thunks(Snapshot(s.log.where("attribute in ('contents', 'resolved_by', 'retracts')"), T), POLICY, no_canon(s)).select("entity", "attribute", "frame", "winner_id")


@query(_VIS + "x as (select entity, cast(value as double) as number from vis where attribute = 'acctbal' and cast(value as double) >= 4000) select * from x")
def where_numeric(spark, d):
    s = snapshot(spark, d)
    return walks.where(fold.fold(s, POLICY, no_canon(s), where=F.col("attribute") == "acctbal"), "acctbal", ">=", 4000)


@query(_CANON + "x as (select distinct coalesce(c.canon, v.entity) as entity from vis v left join canon c on c.id = v.entity where v.frame = 'canon' and v.entity like 'person:%') select * from x")
def entities_roster(spark, d):
    s = snapshot(spark, d)
    return knowledge.entities(s, identity.canon_map(s), "canon", "person:")


@query(_CANON + "x as (select id, canon from canon) select * from x")
def canonical_resolve(spark, d):
    return identity.canon_map(snapshot(spark, d)).select("id", "canon")


@query(_CANON + "x as (select id, min(other) as root from reach group by 1) select * from x")
def closure_components(spark, d):
    return identity.components(identity.edges(snapshot(spark, d, None), "same_as"))


@query(
    _CANON + """a as (select coalesce(c.canon, v.entity) as x, coalesce(k.canon, v.txt) as y from ev v left join canon c on c.id = v.entity left join canon k on k.id = v.txt where v.attribute = 'aka'),
b as (select x, y from a union select y, x from a), r(id, facet) as (select x, y from b union select r.id, b.y from r join b on r.facet = b.x) select id, facet from r where id <> facet"""
)
def correlation_set(spark, d):
    return identity.correlations(snapshot(spark, d, None))


@query(_VIS + "x as (select least(e.entity, e.txt) as a, greatest(e.entity, e.txt) as b from ev e where attribute = 'aka' intersect select least(entity, txt), greatest(entity, txt) from ev where attribute = 'distinct_from') select * from x")
def correlation_conflicts(spark, d):
    return identity.correlation_conflicts(snapshot(spark, d, None))


_ANCHOR = "n as (select distinct coalesce(c.canon, v.entity) as e, lower(trim(v.txt)) as anchor from vis v left join canon c on c.id = v.entity where v.attribute in ('name', 'alias') and v.value_type = 'literal' and v.frame = 'canon')"


@query(_CANON + _ANCHOR + " select anchor, string_agg(e, ',' order by e) as entities, count(*) as n from n group by 1 having count(*) > 1")
def name_collisions(spark, d):
    s = snapshot(spark, d)
    return identity.name_collisions(s, identity.canon_map(s)).select("anchor", F.array_join("entities", ",").alias("entities"), "n")


@query(_CANON + _ANCHOR + " select e as entity from n where anchor = 'caller 3'")
def by_alias(spark, d):
    s = snapshot(spark, d)
    return identity.by_alias(s, " Caller 3 ", identity.canon_map(s))


@query(_VIS + "x as (select distinct lower(trim(txt)) as anchor from vis where attribute = 'name' and frame = 'canon') select anchor, array_to_string(list_filter(string_split(trim(regexp_replace(anchor, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda w: length(w) > 1), ' ') as tokens from x")
def name_tokens(spark, d):
    names = identity.anchors(snapshot(spark, d), "canon").select("anchor").distinct()
    return names.select("anchor", F.array_join(content_tokens(F.col("anchor")), " ").alias("tokens"))


@query(
    _CANON + """x as (select coalesce(c.canon, v.entity) as x, coalesce(k.canon, v.txt) as y, v.attribute from ev v left join canon c on c.id = v.entity left join canon k on k.id = v.txt where v.value_type = 'entity' and v.attribute in ('distinct_from', 'in', 'held_by'))
select distinct least(x, y) as a, greatest(x, y) as b, case attribute when 'distinct_from' then 'distinct' else 'containment' end as reason from x where x <> y"""
)
def merge_blocks(spark, d):
    s = snapshot(spark, d, None)
    return identity.blocks(s, identity.canon_map(s))


@query(_VIS + "e as (select entity x, txt y from vis where attribute in ('connects_to', 'adjacent_to') union select txt, entity from vis where attribute in ('connects_to', 'adjacent_to')) select x, y from e where x <> y")
def lateral_neighbors(spark, d):
    return walks.lateral_edges(snapshot(spark, d))


_WAY = """e as (select entity x, txt y from vis where attribute in ('connects_to', 'adjacent_to') union select txt, entity from vis where attribute in ('connects_to', 'adjacent_to')),
p(a, spot, path, hop) as (select distinct x, x, [x], 0 from e where x in ('place:nation_0', 'place:nation_7') union all select p.a, e.y, list_append(p.path, e.y), p.hop + 1 from p join e on e.x = p.spot where not list_contains(p.path, e.y) and p.hop < 12),
best as (select a, spot as b, arg_min(path, (hop, path)) as path from p group by 1, 2)"""


@query(_VIS + _WAY + " select a, b, array_to_string(path, '>') as path from best")
def path_shortest(spark, d):
    s = snapshot(spark, d)
    edges = walks.lateral_edges(s)
    nations = edges.select(F.col("x").alias("b")).distinct()
    starts = nations.where("b in ('place:nation_0', 'place:nation_7')").select(F.col("b").alias("a"))
    found = walks.shortest(edges, starts.crossJoin(nations))
    return found.where("path is not null").select("a", "b", F.array_join("path", ">").alias("path"))


@query(_VIS + "x as (select entity as x, txt as y, valid_to as closed from ev where attribute in ('connects_to', 'adjacent_to') and valid_to <= 10500) select * from x")
def former_passages(spark, d):
    return walks.former_passages(snapshot(spark, d))


@query(_VIS + "x as (select txt as target, count(distinct entity) as n from vis where value_type = 'entity' and frame = 'canon' and entity not like 'a:%' group by 1) select * from x")
def incoming_refs(spark, d):
    return walks.incoming(snapshot(spark, d))


@query(
    _VIS + """e as (select entity as event, max(valid_from) as t, max(txt) filter (attribute = 'kind') as kind, max(txt) filter (attribute = 'agent') as agent, max(txt) filter (attribute = 'patient') as patient, count(*) as n_rows from vis where entity like 'event:%' group by 1)
select * from e"""
)
def events_pivot(spark, d):
    s = snapshot(spark, d)
    return knowledge.events(s, no_canon(s)).where(F.col("event").startswith("event:")).select("event", "t", "kind", "agent", "patient", "n_rows")


@query(_VIS + "e as (select entity as event, max(valid_from) as t, max(txt) filter (attribute = 'agent') as agent from ev where entity like 'event:%' and valid_from >= 10450 and valid_from <= 10500 group by 1) select * from e where agent is not null")
def events_window(spark, d):
    s = snapshot(spark, d)
    return knowledge.events(s, no_canon(s), since=10450.0, kind="order").select("event", "t", "agent")


@query(_VIS + "x as (select e.entity as id, e.txt as event from ev e where attribute = 'caused_by' and entity like 'a:%') select * from x")
def causal_sources(spark, d):
    return knowledge.causes(snapshot(spark, d, None))


@query(_CANON + "x as (select distinct coalesce(c.canon, v.entity) as entity, v.attribute, v.frame from ev v left join canon c on c.id = v.entity where v.frame like 'knows:%') select * from x")
def who_knows(spark, d):
    s, canon = _last(spark, d)
    return knowledge.who_knows(fold.fold(s, POLICY, canon, where=F.col("frame").startswith("knows:")))


@query(_CANON + "x as (select distinct coalesce(c.canon, v.entity) as entity, v.attribute, v.frame from ev v left join canon c on c.id = v.entity where v.attribute like 'last%') select entity, attribute from x where frame = 'knows:person:user_3' except select entity, attribute from x where frame in ('knows:person:user_4', 'knows:person:user_5')")
def frame_diff_absent(spark, d):
    s, canon = _last(spark, d)
    folded = fold.fold(s, POLICY, canon, where=F.col("attribute").startswith("last_"))
    diff = knowledge.frame_diff(folded, canon, "knows:person:user_3", "knows:person:user_4", "knows:person:user_5")
    return diff.where("not divergent").select("entity", "attribute")


@query()
def frame_diff_divergent(spark, d):
    s, canon = _last(spark, d)
    folded = fold.fold(s, POLICY, canon, where=F.col("attribute").startswith("last_"))
    return knowledge.frame_diff(folded, canon, "canon", "knows:person:user_3").where("divergent").select("entity", "attribute", "value", "other")


@query(
    _VIS + """r as (select *, case status when 'inferred' then 1 else 3 end as rank from vis where attribute = 'segment'), b as (select entity, max(rank) as best from r group by 1)
select r.entity, round(0.45 * case max(status) when 'inferred' then 0.6 else 1.0 end + 0.30, 9) as confidence from r join b on r.entity = b.entity and r.rank = b.best group by 1"""
)
def confidence_single(spark, d):
    s = snapshot(spark, d)
    own = Snapshot(s.log.where("attribute in ('segment', 'source', 'retracts')"), T)
    folded = fold.fold(own, POLICY, no_canon(s))
    return trust.confidence(own, POLICY, no_canon(s), folded).select("entity", F.round("confidence", 9).alias("confidence"))


@query(
    _VIS + """r as (select * from vis where frame = 'canon' and entity not like 'a:%'), head as (select max(asserted_at) as h from log),
e as (select entity, max(asserted_at) as last, count(distinct valid_from) + max(case when valid_from is null then 1 else 0 end) as times from r where entity like 'place:%' group by 1),
i as (select txt as entity, count(distinct entity) as n from r where value_type = 'entity' group by 1)
select e.entity, round(0.40 * last / h + 0.25 * least(1.0, ln(1 + coalesce(n, 0)) / ln(9)) + 0.20 * least(1.0, ln(1 + times) / ln(9)), 9) as salience from e left join i using (entity) cross join head"""
)
def salience(spark, d):
    s = snapshot(spark, d)
    ranked = trust.salience(s, POLICY, no_canon(s)).where(F.col("entity").startswith("place:"))
    return ranked.select("entity", F.round("salience", 9).alias("salience"))


@query()
def budget_topk(spark, d):
    s = snapshot(spark, d)
    canon = identity.canon_map(s)
    return trust.budgeted(fold.fold(s, POLICY, canon).select("entity", "attribute", "branch", "winner_id"), trust.salience(s, POLICY, canon), 50).select("entity", "attribute", "winner_id")


@query()
def locate_chain_whole(spark, d):
    """Of everything that is anywhere, not of parts only; likewise the other queries of this name."""
    found = walks.locate(places(snapshot(spark, d)))
    return found.select("entity", F.array_join("chain", ">").alias("chain"), F.size("chain").cast("long").alias("depth"))


@query()
def path_shortest_whole(spark, d):
    edges = walks.lateral_edges(snapshot(spark, d))
    ends = edges.select(F.col("x").alias("a")).distinct()
    found = walks.shortest(edges, ends.crossJoin(ends.select(F.col("a").alias("b"))))
    return found.where("path is not null").select("a", "b", F.array_join("path", ">").alias("path"))


@query()
def confidence_whole(spark, d):
    s = snapshot(spark, d)
    canon = identity.canon_map(s)
    found = trust.confidence(s, POLICY, canon, fold.fold(s, POLICY, canon))
    return found.select("entity", "attribute", "frame", F.round("confidence", 9).alias("confidence"))


@query()
def salience_whole(spark, d):
    s = snapshot(spark, d)
    return trust.salience(s, POLICY, identity.canon_map(s)).select("entity", F.round("salience", 9).alias("salience"))


@query()
def current_state(spark, d):
    """The whole fold as of a day: every key of every entity and frame."""
    s = snapshot(spark, d)
    folded = fold.fold(s, POLICY, identity.canon_map(s))
    shown = F.when(F.col("attribute") == CONTAINED, "in").otherwise(F.col("attribute"))
    return folded.select("entity", shown.alias("attribute"), "frame", "branch", "winner_id", "winner_value", "conflicted", F.size("members").alias("n_members"), F.round("quantity", 4).alias("quantity"))


#: A transaction amid those of the events table.
ASSERTED = 40000002000


@query(
    _LOG + f"""x as (select * from log l where status <> 'retracted' and {_AT} and asserted_at <= {ASSERTED} and not exists (select 1 from log r where r.attribute = 'retracts' and r.entity = l.id and r.asserted_at <= {ASSERTED}))
select attribute, frame, count(*) as n, max(seq) as last from x group by 1, 2"""
)
def visible_asserted_asof(spark, d):
    s = Snapshot(stored_log(spark, d), T, ASSERTED)
    return visible.visible(s).groupBy("attribute", "frame").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query(_LOG + "x as (select 1) select value_type, status, frame like 'knows:%' as known, count(*) as n, sum(seq % 1000003) as checked from log group by 1, 2, 3")
def full_scan(spark, d):
    log = stored_log(spark, d)
    return log.groupBy("value_type", "status", F.col("frame").startswith("knows:").alias("known")).agg(F.count("*").alias("n"), F.sum(F.col("seq") % 1000003).alias("checked"))


_FACETS = _VIS + """pairs as (select entity a, txt b from ev where attribute = 'same_as' union select entity, txt from ev where attribute = 'aka'),
same as (select a, b from pairs union select b, a from pairs),
reach(id, other) as (select a, a from same union select reach.id, same.b from reach join same on reach.other = same.a),
seen as (select id, min(seq) as first from (select entity as id, seq from log union all select trim(value, '"'), seq from log where value_type = 'entity') group by id),
canon as (select r.id, arg_min(r.other, (s.first, r.other)) as canon from reach r join seen s on s.id = r.other group by r.id),
"""


@query(
    _FACETS + """k as (select v.*, coalesce(c.canon, v.entity) as who, coalesce(nullif(valid_from, 0), '-infinity'::double) as vf_or from ev v left join canon c on c.id = v.entity where attribute = 'mood'),
top as (select who, frame, max((vf_or, asserted_at)) as t from k group by 1, 2),
w as (select k.who, k.frame, k.valid_from from k join top on k.who = top.who and k.frame = top.frame and (k.vf_or, k.asserted_at) = top.t),
tied as (select k.* from k join w on k.who = w.who and k.frame = w.frame and k.valid_from is not distinct from w.valid_from)
select who as entity, frame, count(distinct value) > 1 as conflicted, case when count(distinct value) > 1 then arg_min(txt, asserted_at) else arg_max(txt, asserted_at) end as mood from tied group by 1, 2"""
)
def state_union(spark, d):
    s = snapshot(spark, d, None)
    rows = fold.fold(s, POLICY, identity.facet_map(s), where=F.col("attribute") == "mood")
    return rows.select("entity", "frame", "conflicted", text_of(F.col("winner_value")).alias("mood"))


@query(
    _CANON + f"""r as (select coalesce(x.canon, v.entity) as x, coalesce(y.canon, v.txt) as y, attribute from vis v left join canon x on x.id = v.entity left join canon y on y.id = v.txt
 where value_type = 'entity' and not entity like 'a:%' and not entity like 'attr:%' and attribute not in ('same_as', 'aka', 'maybe_same_as', 'distinct_from', 'kind', 'caused_by', 'source') and attribute not in {_CONTAIN})
select distinct least(x, y) as a, greatest(x, y) as b, attribute from r where x <> y"""
)
def relating_edges(spark, d):
    s = snapshot(spark, d)
    return identity.relating_edges(s, identity.canon_map(s))


@query(
    _CANON + """r as (select coalesce(x.canon, v.entity) as x, coalesce(y.canon, v.txt) as y, attribute from vis v left join canon x on x.id = v.entity left join canon y on y.id = v.txt
 where value_type = 'entity' and frame = 'canon' and not entity like 'a:%' and not entity like 'attr:%' and attribute <> 'source')
select distinct x as entity, attribute, y as other, true as outgoing from r where x <> y union select distinct y, attribute, x, false from r where x <> y"""
)
def relation_neighbours(spark, d):
    s = snapshot(spark, d)
    return identity.relations(s, identity.canon_map(s))


@query(
    _CANON + """r as (select coalesce(c.canon, e.txt) as who, e.* from ev e left join canon c on c.id = e.txt where e.entity like 'event:%' and value_type = 'entity' and frame = 'canon' and attribute <> 'caused_by')
select who as entity, entity as event, attribute as role, max(valid_from) as t from r group by 1, 2, 3"""
)
def event_participation(spark, d):
    s = snapshot(spark, d, None)
    return knowledge.participation(s, identity.canon_map(s))


@query(
    _CANON + """k as (select e.id, e.seq, coalesce(c.canon, e.entity) as who, e.frame from ev e left join canon c on c.id = e.entity where attribute = 'mood')
select id, lag(id) over (partition by who, frame order by seq) as prior from k"""
)
def correction_priors(spark, d):
    s = snapshot(spark, d, None)
    return corrections.priors(fold.keyed(s, POLICY, identity.canon_map(s), where=F.col("attribute") == "mood"))


@query(
    _VIS + """x as (select entity, attribute, value_type, value, frame, count(*) - 1 as twins from ev where not entity like 'a:%' and not entity like 'attr:%' group by all having count(*) > 1)
select e.id, x.twins from ev e join x using (entity, attribute, value_type, value, frame)"""
)
def duplicate_twins(spark, d):
    return corrections.twins(snapshot(spark, d, None))
