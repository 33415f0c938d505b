"""Small worlds whose answers are known by hand."""

from __future__ import annotations

import pytest

from worldfold.functions.values import canonical, decoded, exact_total
from worldfold.operators import fold, identity, walks
from worldfold.operators.semantics import Policy
from worldfold.operators.visible import Snapshot
from worldfold.schema import LOG
from worldfold.sources import dump, grammar
from worldfold.storage import new_path
from worldfold.world import World


def log_of(spark, *rows):
    """Rows (entity, attribute, value[, vf[, status[, frame[, vt]]]]); @x is an entity, +n a delta, ?x a thunk."""
    full = []
    for seq, (e, a, v, *more) in enumerate(rows, 1):
        vf, status, frame, vt = [*more, *[None, "stated", "canon", None][len(more) :]]
        kind = {"@": "entity", "+": "delta", "?": "unresolved"}.get(v[0] if isinstance(v, str) else "", "literal")
        text = canonical(v[1:] if kind in ("entity", "unresolved") else float(v[1:]) if kind == "delta" else v)
        full.append((seq, f"a:{seq}", "world:t", e, a, kind, text, vf, vt, frame, status, None, seq))
    return spark.createDataFrame(full, LOG)


def folded(spark, *rows, t=None, accrues=("gold",)):
    s = Snapshot(log_of(spark, *rows), t)
    canon = identity.canon_map(s)
    return {(r["entity"], r["attribute"], r["frame"]): r for r in fold.fold(s, Policy(accrues=accrues), canon).collect()}


def test_ledgers(spark):
    rows = [("person:a", "gold", 500, 1.0), ("person:a", "gold", "+-20", 2.0), ("person:b", "gold", 500, 1.0), ("person:b", "gold", "+-20", 2.0), ("person:b", "gold", "+-20", 2.0), ("person:c", "gold", "+5", 3.0), ("person:d", "gold", "+-20", 1.0), ("person:d", "gold", 500, 2.0)]
    now = folded(spark, *rows)
    assert [now[f"person:{x}", "gold", "canon"]["quantity"] for x in "abcd"] == [480, 460, 5, 500]
    assert folded(spark, *rows, t=1.5)["person:a", "gold", "canon"]["quantity"] == 500
    assert folded(spark, *rows, ("a:2", "retracts", True))["person:a", "gold", "canon"]["quantity"] == 500


def test_state_ties_ranks_and_the_zero_quirk(spark):
    now = folded(
        spark, ("obj:x", "color", "red", 5.0), ("obj:x", "color", "blue", 5.0), ("obj:y", "color", "red", -1.0), ("obj:y", "color", "blue", 0.0), ("obj:z", "color", "red", 1.0, "stated"), ("obj:z", "color", "blue", 2.0, "inferred"),
        ("obj:w", "color", "?later"), ("obj:w", "color", "red", 1.0), ("obj:v", "color", "?later"), ("obj:u", "kind", "box"), ("obj:u", "kind", "crate", 9.0),
    )
    tie = now["obj:x", "color", "canon"]
    assert tie["conflicted"] and tie["conflicting"] == ["a:1", "a:2"] and tie["winner_id"] == "a:1"
    assert now["obj:y", "color", "canon"]["winner_value"] == '"red"'
    assert now["obj:z", "color", "canon"]["winner_value"] == '"red"'
    assert now["obj:w", "color", "canon"]["winner_value"] == '"red"' and now["obj:v", "color", "canon"]["winner_type"] == "unresolved"
    kind = now["obj:u", "kind", "canon"]
    assert kind["branch"] == "constitutive" and kind["winner_value"] == '"box"' and kind["conflicting"] == ["a:10", "a:11"]


def test_sources_corroborate_or_conflict(spark):
    base = [("obj:x", "price", 100, 1.0), ("obj:x", "price", {"approx": 105}, 2.0), ("obj:y", "price", 100, 1.0), ("obj:y", "price", 300, 2.0)]
    said = [("a:1", "source", "@doc:one"), ("a:2", "source", "@doc:two"), ("a:3", "source", "@doc:one"), ("a:4", "source", "@person:p")]
    now = folded(spark, *base, *said)
    x, y = now["obj:x", "price", "canon"], now["obj:y", "price", "canon"]
    assert x["winner_id"] == "a:2" and x["corroborated_by"] == ["a:2"] and not x["conflicted"]
    assert y["winner_id"] == "a:3" and y["conflicting"] == ["a:3", "a:4"]


def test_sets_merge_and_frames(spark):
    now = folded(spark, ("person:a", "name", "Ann"), ("person:a", "name", "Anna", 3.0), ("person:b", "name", "Ann", 4.0), ("person:b", "same_as", "@person:a"), ("person:a", "mood", "calm", 1.0, "stated", "knows:person:c"))
    names = now["person:a", "name", "canon"]
    assert names["members"] == ['"Anna"', '"Ann"'] and names["winner_value"] == '"Ann"' and not names["conflicted"]
    assert ("person:a", "mood", "knows:person:c") in now and ("person:a", "mood", "canon") not in now


def test_retracting_a_retraction_hides_still(spark):
    rows = [("obj:x", "color", "red"), ("a:1", "retracts", True), ("a:2", "retracts", True)]
    assert folded(spark, *rows) == {}


def test_walks(spark):
    log = log_of(
        spark, ("place:room", "in", "@place:house"), ("obj:box", "in", "@place:room", 1.0), ("obj:pen", "in", "@obj:box", 1.0), ("obj:pen", "held_by", "@person:p", 5.0), ("obj:a", "in", "@obj:b", 1.0), ("obj:b", "in", "@obj:a", 1.0),
        ("place:a", "connects_to", "@place:d"), ("place:a", "connects_to", "@place:c"), ("place:c", "connects_to", "@place:b"), ("place:d", "connects_to", "@place:b"), ("place:d", "kind", "door"), ("place:d", "state", "shut"), ("traversal:door", "blocks_state", "shut"),
        ("obj:box", "price", 2.5), ("obj:pen", "price", 4), ("place:c", "kind", "door"), ("place:c", "state", "open"),
    )

    def places(t):
        s = Snapshot(log, t)
        return s, fold.fold(s, Policy(), identity.canon_map(s))

    s, early = places(2.0)
    chains = {r["entity"]: r["chain"] for r in walks.locate(early).collect()}
    assert chains["obj:pen"] == ["obj:box", "place:room", "place:house"] and chains["obj:a"] == ["obj:b"]
    assert {r["entity"]: r["chain"] for r in walks.locate(places(6.0)[1]).collect()}["obj:pen"] == ["person:p"]
    rolled = {r["container"]: (r["count"], r["sum"]) for r in walks.aggregate(early, "price", recursive=True).collect()}
    assert rolled["place:house"] == (2, 6.5) and rolled["obj:box"] == (1, 4)
    pairs = spark.createDataFrame([("place:a", "place:b"), ("place:a", "place:a"), ("place:a", "place:zz")], "a string, b string")
    assert {r["b"]: r["path"] for r in walks.shortest(walks.lateral_edges(s), pairs).collect()} == {"place:b": ["place:a", "place:c", "place:b"], "place:a": ["place:a"], "place:zz": None}
    ways = {r["b"]: (r["status"], r["path"]) for r in walks.route(s, early, spark.createDataFrame([("place:a", "place:b"), ("place:a", "place:d"), ("place:a", "place:zz")], "a string, b string")).collect()}
    assert ways["place:b"] == ("clear", ["place:a", "place:c", "place:b"]) and ways["place:d"][0] == "blocked" and ways["place:zz"] == ("no_path", None)


def test_world_writes_and_reads(spark):
    w = World(spark, new_path(spark, "world"))
    skipped = w.ingest_structured([
        {"entity": "person:ann", "attribute": "in", "value": "place:hall", "source": "doc:one"}, {"entity": "Bad Id", "attribute": "name", "value": "x"}, {"entity": "place:hall", "attribute": "location", "value": "place:hall"},
        {"entity": "obj:box", "attribute": "in", "value": "obj:tin"}, {"entity": "obj:tin", "attribute": "in", "value": "obj:box"}, {"entity": "person:ann", "attribute": "name", "value": "Ann Lee", "timeless": True}, {"entity": "person:lee", "attribute": "name", "value": "ann lee"},
        {"entity": "person:ann", "attribute": "age", "value": 30, "valid_from": 5, "valid_to": 2},
    ], at=1.0)
    assert {(r["n"], r["reason"]) for r in skipped.collect()} == {(2, "malformed_id"), (3, "self_edge"), (4, "cycle"), (5, "cycle"), (8, "reversed_interval")}
    rows = {r["id"]: r for r in w.log.collect()}
    assert rows["a:2"]["entity"] == "a:1" and rows["a:2"]["attribute"] == "source" and len(rows) == 4
    assert w.state("person:ann", "in").first()["winner_value"] == '"place:hall"'
    assert w.merge("person:ann", "person:lee", "same name") == "merged" and w.merge("person:lee", "person:ann") == "noop_already_merged"
    assert w.merge("person:ann", "place:hall") == "vetoed"
    assert w.state("person:lee", "in").first()["winner_value"] == '"place:hall"'
    w.retract("a:1", "wrong")
    assert w.state("person:ann", "in").first() is None
    with pytest.raises(ValueError):
        w.retract("a:999")
    with pytest.raises(ValueError):
        w.ingest_structured([{"entity": "Bad Id", "attribute": "x", "value": 1}], atomic=True)


def test_dump_and_build(spark, tmp_path):
    log = log_of(spark, ("person:a", "name", "Ann"), ("person:a", "gold", 5, 1.0))
    dump.dump(log, f"file://{tmp_path}/dump")
    again = dump.build(spark, f"file://{tmp_path}/dump", f"file://{tmp_path}/log")
    assert sorted(map(str, again.collect())) == sorted(map(str, log.collect()))
    with pytest.raises(ValueError):
        dump.build(spark, f"file://{tmp_path}/dump", f"file://{tmp_path}/log")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.txt").write_text('{"seq": 1}\n')
    with pytest.raises(ValueError):
        dump.build(spark, f"file://{tmp_path}/bad", f"file://{tmp_path}/other")


def test_lines(spark):
    lines = ["obj:core|in|@place:vault|vf=4,s=stated", "person:ilsa|role|clerk|t", "place:office|reactor_count|2|vf=1", 'obj:x|note|{"a": "b|c"}|f=plot', "core|size|2.5", "nothing here", "obj:x|made_of|?{\"policy\": \"invent\"}", "obj:x|y|1|zz=3", "", "# note"]
    got = [r.asDict() for r in grammar.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert [r["outcome"] for r in got] == ["item", "item", "item", "item", "orphan", "reject", "item", "reject"]
    assert got[0]["value_type"] == "entity" and got[0]["valid_from"] == 4 and got[1]["timeless"] and got[2]["value"] == "2" and got[3]["value"] == '{"a": "b|c"}' and got[6]["value_type"] == "unresolved"
    parsed = grammar.parse_lines(spark.createDataFrame([("core|size|2.5",)], "value string"))
    assert grammar.completed(parsed, spark.createDataFrame([("obj:core",)], "id string")).first()["entity"] == "obj:core"


def test_exact_values():
    assert exact_total(["0.10", None, "0.20"]) == "0.30"
    from decimal import Decimal

    assert decoded(canonical(Decimal("12.50"))) == Decimal("12.50") and decoded('{"$decimal": "nan"}') == {"$decimal": "nan"}
