import random

import corpus_pipeline
from worldfold.llm import bpe, decontaminate, jaccard_join, toxicity
from worldfold.llm.queries import RANKS

from . import test_decontaminate, test_jaccard_join
from .helpers import corpus


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = [r for r in corpus(14, 40) if r[0] != 3]
    long = next(t for i, t in rows if i and i % 7 > 1 and i % 6 and len(t.split()) > 100)
    bench = [(1, " ".join(long.split()[:20])), (2, "not in any document at all")]
    rows += [(600, "you worthless idiot, go"), (601, "kept and clean")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (600, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    import pyarrow as pa

    judge = toxicity.Judge(toxicity.Scoring())
    scores = [sum(s for _, _, _, s, _ in judge.hits(pa.array([t], pa.string()))) for _, t in rows]
    left = [r for r, s in zip(rows, scores) if s < 1]
    first: dict[str, int | None] = {}
    for i, t in sorted(left, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None:
            first.setdefault(t, i)
    left = [(i, t) for i, t in left if t is None or first[t] == i]
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in test_jaccard_join.brute(left, jaccard_join.Join()):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    left = [(i, t) for i, t in left if i is None or root(i) == i]
    dirty = {i for i, _ in test_decontaminate.brute(left, bench, decontaminate.Matching())}
    left = [(i, t) for i, t in left if i not in dirty]
    encoding = bpe.load(RANKS)
    assert got == {i: None if t is None else bpe.encode(t, encoding) for i, t in left}
    assert dirty and 600 not in got and 601 in got


def test_stages_pass_all_columns_on(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == none.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_one_text_are_dropped_without_listing_their_pairs(spark, monkeypatch):
    rows = test_jaccard_join.near_copies(random.Random(15), 1000, 90, 5)
    listed, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda docs, candidates, *rest: (listed.append(candidates.count()), verified(docs, candidates, *rest))[1])
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r["doc_id"] for r in left.collect()] == [1000]
    different = len({t for _, t in rows})  # a few that stand in too few long lists have no hub
    assert different > 64 and listed[0] < different * (different - 1) / 2 / 10
