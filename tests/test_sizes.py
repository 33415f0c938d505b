"""Plans and layouts: what a log is read for once, and what grows with it."""

from __future__ import annotations

from tests.test_world import log_of
from worldfold.operators import fold, identity, sizes, visible, walks
from worldfold.operators.semantics import Policy
from worldfold.operators.visible import Snapshot
from worldfold.sources.sample_world import _LINE
from worldfold.storage import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log(spark):
    return written(log_of(spark, ("obj:x", "in", "@place:a", 1.0), ("obj:x", "color", "red", 1.0), ("obj:x", "color", "blue", 2.0), ("person:a", "gold", 5), ("person:a", "gold", "+2", 3.0), ("person:a", "name", "Ann"), ("person:b", "same_as", "@person:a"), ("a:3", "retracts", True), ("a:2", "source", "@doc:one")), "t")


def test_few_retractions_shuffle_no_rows(spark):
    rows = log(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in plan(visible.visible(Snapshot(rows))) and "BroadcastHashJoin" in plan(visible.visible(Snapshot(rows)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_retractions_and_sources_say_the_same(spark, monkeypatch):
    s = Snapshot(log(spark))
    told = lambda: sorted(map(str, fold.fold(s, Policy(accrues=("gold",)), identity.canon_map(s)).collect()))
    few = told()
    for module in (sizes, fold, identity):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sizes.hinted, "__defaults__", (0,))
    assert told() == few and any("a:2" in r for r in few) and not any("'a:3'" in r for r in few)


def test_a_fold_is_made_in_one_pass(spark):
    s = Snapshot(log(spark))
    folded = plan(fold.fold(s, Policy(accrues=("gold",)), identity.canon_map(s)))
    assert "Union" not in folded.split("Initial Plan")[0] and folded.count("REPARTITION_BY_NUM") == 1


def test_partitions_follow_the_rows(spark):
    assert sizes.spread(spark.range(10), 1000, "id", each=10).rdd.getNumPartitions() == 100
    assert sizes.spread(spark.range(10), 1000, "id", each=1000).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = ", ".join(f"0 as {c}" for c in "l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    many = spark.sql(_LINE, lineitem=sizes.spread(spark.sql(f"select id as l_orderkey, {lines} from range(10)"), 1000, "l_orderkey", each=10))
    assert plan(many).count("Exchange") == 1


def test_only_asked_entities_are_ranked(spark):
    ids = written(spark.createDataFrame([("person:a",)], "id string"), "ids")
    assert [tuple(r) for r in identity.first_seen(Snapshot(log(spark)), ids).collect()] == [("person:a", 4)]


def test_walks_read_folds_once(spark):
    s = Snapshot(log(spark))
    assert "Window" not in plan(walks.told(fold.fold(s, Policy(), identity.canon_map(s))))
