from collections import defaultdict

from pyspark.sql import functions as F

from worldfold.llm import exact_dedup as e

from .helpers import SCHEMA, corpus, with_extras


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        if t is not None:
            by[t].append(i)
    out = []
    for ids in by.values():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids)) for i in ids[1:]]
    return sorted(out, key=str)


def test_copies_and_filter(spark, tmp_path):
    rows = corpus(5, 40)
    docs = with_extras(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in e.copies(docs).collect()), key=str) == brute(rows)
    docs.write.parquet(str(tmp_path / "docs"))
    filed = spark.read.parquet(str(tmp_path / "docs"))
    left = e.without_copies(filed)
    assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect()]
    assert len(texts) == len(rows) - len(brute(rows)) and len({t for t in texts if t is not None}) == sum(t is not None for t in texts)
    assert e.without_copies(docs.limit(0)).count() == 0 and e.copies(docs.limit(0)).count() == 0


def test_colliding_digests_lose_nothing(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc"), (5, "bb"), (6, None), (7, None), (8, ""), (9, "")]
    weak = lambda text: F.encode(F.when(text.isNull(), text).otherwise(F.lit("same")), "UTF-8")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in e.copies(docs, digest=weak).collect()) == [(3, 1, 2), (5, 2, 2), (9, 8, 2)]
    assert sorted(r["doc_id"] for r in e.without_copies(docs, digest=weak).collect()) == [1, 2, 4, 6, 7, 8]


def test_state_goes_on_after_a_restart(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", e.ROCKSDB)
    try:
        for k, rows in enumerate([[(5, "x"), (6, "y")], [(3, "x"), (7, "z")], [(9, "x")]]):
            slim = e.arrivals(spark.createDataFrame(rows, SCHEMA))
            slim.write.mode("append").parquet(f"{base}/in")
            e.keep_state(spark.readStream.schema(slim.schema).parquet(f"{base}/in"), f"{base}/hits", f"{base}/state").awaitTermination()
            found = spark.read.parquet(f"{base}/hits").where(f"batch = {k}").collect()
            assert [(r["doc_id"], r["n"]) for r in found] == [[], [(3, 2)], [(3, 3)]][k]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_joined_united_and_clashing_inputs(spark, tmp_path):
    rows = [(1, "a"), (2, "a"), (3, "b"), (None, "b"), (5, None), (1, "a")] + [(100 + k, "one text in most rows") for k in range(200)] + [(7, "long " * 200_000), (8, "long " * 200_000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = brute(rows)
    one = docs.join(spark.range(1).withColumnRenamed("id", "_other"), F.lit(True))
    for df in (docs, one, docs.withColumn("_metadata", F.lit("own")), docs.repartition(3)):
        assert sorted((tuple(r) for r in e.copies(df).collect()), key=str) == want
        assert e.without_copies(df).count() == len(rows) - len(want)
    twice = docs.union(docs)
    assert sorted((tuple(r) for r in e.copies(twice).collect()), key=str) == brute(rows + rows)
