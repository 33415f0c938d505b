import pytest
from pyspark.sql import functions as F

from worldfold.functions.values import exact_div, unmixed
from worldfold.operators import walks
from worldfold.world import World


def test_exact_division_and_the_mix_guard(spark):
    rows = spark.createDataFrame([("1", "3"), ("10.00", "4"), ("1", "0"), (None, "1")], "a string, b string")
    assert [r[0] for r in rows.select(exact_div(F.col("a"), F.col("b"))).collect()] == ["0." + "3" * 50, "2.50", None, None]
    value = F.col("value")
    some = spark.createDataFrame([("x", '{"$decimal":"1.0"}'), ("x", "3"), ("y", "1.5"), ("y", "2")], "k string, value string")
    assert some.groupBy("k").agg(unmixed(value, F.count("*")).alias("n")).count() == 2
    with pytest.raises(Exception, match="one sum"):
        some.union(spark.createDataFrame([("x", "0.5")], "k string, value string")).groupBy("k").agg(unmixed(value, F.count("*")).alias("n")).collect()


def test_comparison_with_no_number_finds_nothing(spark):
    folded = spark.createDataFrame([("obj:a", "mass", "canon", "state", "literal", "3", None)], "entity string, attribute string, frame string, branch string, winner_type string, winner_value string, quantity double")
    assert walks.where(folded, "mass", ">", 2).count() == 1 and walks.where(folded, "mass", ">", "heavy").count() == 0 and walks.where(folded, "mass", ">", None).count() == 0


def test_facets_charter_conflicts_and_proposals(spark, tmp_path):
    w = World(spark, f"file://{tmp_path}/log")
    w.ingest_structured([
        {"entity": "person:ada", "attribute": "mood", "value": "calm", "valid_from": 1}, {"entity": "person:mask", "attribute": "mood", "value": "angry", "valid_from": 2},
        {"entity": "world:self", "attribute": "genre", "value": "noir"}, {"entity": "obj:cup", "attribute": "colour", "value": "red", "valid_from": 3}, {"entity": "obj:cup", "attribute": "colour", "value": "blue", "valid_from": 3},
    ])
    w.correlate("person:ada", "person:mask")
    assert w.state("person:ada", "mood").first()["winner_value"] == '"calm"'
    assert w.state_union("person:ada", "mood").first()["winner_value"] == '"angry"'
    assert [tuple(r) for r in w.charter().collect()] == [("genre", '"noir"')]
    assert [(r["entity"], r["attribute"]) for r in w.open_conflicts().collect()] == [("obj:cup", "colour")]
    assert w.confirm("person:ada", "person:bob") == "no_proposal"
    w.maybe_same_as("person:ada", "person:bob")
    assert w.confirm("person:bob", "person:ada") == "merged"
