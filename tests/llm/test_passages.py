import random
from collections import defaultdict

import pytest

from worldfold.llm import substring_dedup as s
from worldfold.llm import suffix_dedup as x

from .helpers import SCHEMA, corpus, with_extras, words_of


def brute(rows, length):
    seen, docs = defaultdict(set), {}
    for i, t in rows:
        if i is not None and t is not None:
            docs[i] = words_of(t)
    for i, w in docs.items():
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].add(i)
    out = []
    for i, w in docs.items():
        span = None
        for p in range(len(w) - length + 1):
            if len(seen[tuple(w[p : p + length])]) > 1:
                if span and p <= span[1]:
                    span[1] = p + length
                else:
                    span = [p, p + length]
                    out.append((i, span))
    return sorted((i, a, b) for i, (a, b) in out)


def rows_with_loops():
    rows = corpus(11, 40)
    return [*rows, (800, "spam " * 400), (801, "spam " * 90 + "end"), (802, "alone " * 200), (803, " ".join(f"c{k % 7}" for k in range(300))), (804, " ".join(f"c{k % 7}" for k in range(2, 120)))]


@pytest.mark.parametrize("how", [s.Cover(), s.Cover(20, 13, (0, 1, 3, 9)), s.Cover(7, 7, (0, 1, 3))])
def test_difference_cover(spark, how):
    rows = rows_with_loops()
    got = s.repeated_spans(with_extras(spark.createDataFrame(rows, SCHEMA)), how)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, how.length)


@pytest.mark.parametrize("how", [x.Sparse(), x.Sparse(20, 4, 10, 16), x.Sparse(8, 1, 1, 8)])
def test_suffix_array(spark, how):
    rows = rows_with_loops()
    got = x.repeated_spans(with_extras(spark.createDataFrame(rows, SCHEMA)), how)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, how.length)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert s.repeated_spans(none).count() == 0 and x.repeated_spans(none).count() == 0


def test_wrong_parameters():
    with pytest.raises(ValueError):
        s.Cover(50, 31, (1, 2, 3))
    with pytest.raises(ValueError):
        x.Sparse(length=20, gram=8, window=34)


def test_loser_tree_keeps_order_and_prefixes(monkeypatch):
    rng = random.Random(12)
    for trial in range(60):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 7))]

        def coded(run):
            last = b""
            for k, key in enumerate(run):
                yield key, x.common(last, key, 0) if k else 0, None
                last = key

        out = list(x.merged([coded(r) for r in runs]))
        assert [k for k, _, _ in out] == sorted(k for r in runs for k in r)
        for (a, _, _), (b, n, _) in zip(out, out[1:]):
            assert n == x.common(a, b, 0)


def test_known_prefixes_are_not_compared_again(monkeypatch):
    looked = []
    real = x.common
    monkeypatch.setattr(x, "common", lambda a, b, known: looked.append(known) or real(a, b, known))
    long = b"p" * 500
    runs = [iter([(long + bytes([c]), 0 if c == i else 500, None) for c in range(i, 200, 3)]) for i in range(3)]
    assert len(list(x.merged(runs))) == 200
    assert sum(k < 500 for k in looked) <= 3


@pytest.mark.parametrize("most", [0, 40, 10**6])
def test_pages_merge_as_they_come(most):
    """Runs of pages in the order of their first keys, with one key that fills most pages, whatever is held at once."""
    rng = random.Random(21)
    for trial in range(20):
        runs = [sorted((rng.choice([b"same", bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 6)))]), rng.randrange(5), k) for k in range(rng.randrange(60))) for _ in range(4)]
        pages = [p for i, run in enumerate(runs) for batch in x.front_coded(run, i, 7) for p in batch.to_pylist()]
        pages.sort(key=lambda p: (p["first"], p["run"], p["page"]))
        out = list(x.in_order(iter(pages), most))
        keys = [k for k, _, _ in out]
        assert keys == sorted(k for run in runs for k, _, _ in run)
        assert all(n == x.common(a, b, 0) for a, (b, n, _) in zip([b"", *keys], out))
        docs = defaultdict(set)
        for run in runs:
            for k, i, _ in run:
                docs[k].add(i)
        want = sorted((i, p) for run in runs for k, i, p in run if len(docs[k]) > 1)
        assert sorted(x.agreeing(iter(out))) == want
