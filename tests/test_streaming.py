"""A fold kept up to date batch by batch equals the fold of the whole log."""

from __future__ import annotations

from worldfold.operators import fold, identity
from worldfold.operators.semantics import Policy
from worldfold.operators.visible import Snapshot
from worldfold.schema import LOG
from worldfold.streaming.incremental import maintain, touched

from .test_world import log_of

ROWS = [
    ("person:a", "name", "Ann"), ("obj:x", "color", "red", 1.0), ("obj:x", "color", "blue", 2.0), ("person:b", "name", "Bo"),
    ("a:3", "retracts", True), ("person:b", "same_as", "@person:a"), ("obj:y", "in", "@place:p", 1.0),
]


def test_incremental_fold(spark, tmp_path):
    all_rows, base = log_of(spark, *ROWS), f"file://{tmp_path}"
    served: dict[tuple, tuple] = {}

    def sink(df, number):
        for r in df.collect():
            served[r["entity"], r["attribute"], r["frame"]] = (r["winner_id"], tuple(r["members"]))

    for lo, hi in ((1, 4), (5, 7)):
        all_rows.where(f"seq between {lo} and {hi}").write.mode("append").parquet(f"{base}/log")
        log = lambda: spark.read.schema(LOG).parquet(f"{base}/log")
        maintain(spark.readStream.schema(LOG).parquet(f"{base}/log"), log, Policy(), sink, f"{base}/state").awaitTermination()
    s = Snapshot(all_rows)
    whole = {(r["entity"], r["attribute"], r["frame"]): (r["winner_id"], tuple(r["members"])) for r in fold.fold(s, Policy(), identity.canon_map(s)).collect()}
    assert {k: v for k, v in served.items() if k in whole} == whole


def test_touched(spark):
    log = log_of(spark, *ROWS)
    assert {r["entity"] for r in touched(log, log.where("seq = 5")).collect()} == {"obj:x"}
    assert {r["entity"] for r in touched(log, log.where("seq = 4")).collect()} == {"person:a", "person:b"}
