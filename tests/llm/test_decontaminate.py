import random

import numpy as np
import pytest

from worldfold.llm import decontaminate as d

from .helpers import SCHEMA, corpus, invented, with_extras, words_of


def brute(rows, items, how):
    counts: dict[str, int] = {}
    docs = {i: words_of(t) for i, t in rows if i is not None and t is not None}
    all_docs = [(i, words_of(t)) for i, t in rows if i is not None and t is not None]
    for _, ws in all_docs:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    out = {}
    for item, text in items:
        terms = words_of(text)
        if len(terms) < how.least:
            continue
        n, m = len(terms), min(len(terms), how.phrase)
        rank = sorted(range(n), key=lambda o: (counts.get(terms[o], 0), o))
        need = int(np.ceil(how.share * n - 1e-9))
        for i, ws in docs.items():
            at = [p for k in range(n - m + 1) for p in range(len(ws) - m + 1) if ws[p : p + m] == terms[k : k + m]]
            if at:
                out[i, item] = min(("phrase", min(at)), out.get((i, item), ("z", 0)))
                continue
            near = []
            for o in rank[: n - need + 1]:
                for p, w in enumerate(ws):
                    if w == terms[o]:
                        a = p - o
                        hits = sum(any(ws[q] == terms[x] for q in range(max(0, a + x - how.slop), min(len(ws), a + x + how.slop + 1))) for x in range(n))
                        if hits >= need:
                            near.append(max(0, a))
            if near:
                out[i, item] = min(("proximity", min(near)), out.get((i, item), ("z", 0)))
    return out


@pytest.mark.parametrize("how", [d.Matching(), d.Matching(phrase=4, slop=1, share=0.6, least=2), d.Matching(round_words=30)])
def test_matches(spark, how):
    rng = random.Random(9)
    items = [(k, " ".join(invented(rng, n))) for k, n in enumerate([3, 6, 13, 20, 40])] + [(7, None), (8, ""), (None, "a b c d e f g"), (2, None)]
    items += [(3, items[1][1]), (3, "another text under one id"), (900, "lonely"), (None, items[2][1])]
    rows = corpus(10, 25)
    rows += [(790, "a lonely word"), (791, "another text under one id")]
    for k, (item, text) in enumerate(items[:5]):
        w = words_of(text)
        rows.append((700 + k, "lead in " + text.upper() + ", and more"))
        loose = list(w)
        loose[len(loose) // 2 : len(loose) // 2] = ["inserted"]
        rows.append((720 + k, " ".join(loose)))
        rows.append((740 + k, " ".join(w[: len(w) // 2])))
        rows.append((760 + k, " ".join(w[: len(w) // 2])))
    docs, bench = with_extras(spark.createDataFrame(rows, SCHEMA)), with_extras(spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["first_word"]) for r in d.contamination(docs, bench, how).collect()}
    assert got == brute(rows, items, how)


def test_filter_and_empty_tables(spark):
    docs = with_extras(spark.createDataFrame([(1, "one two three four five six"), (2, "clean words here"), (None, "one two three four five six"), (3, None)], SCHEMA))
    bench = spark.createDataFrame([(1, "Two three, four five six")], "item_id long, text string")
    left = d.without_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [2, 3]
    assert d.contamination(docs.limit(0), bench).count() == 0 and d.contamination(docs, bench.limit(0)).count() == 0


def test_postings_round_trip():
    values = np.array([0, 1, 200, 3, 70000, 1 << 31, 5])
    begin = np.array([0, 3, 6])
    data, at = d.pack(values, begin)
    assert [d.unpack(data[a:b].tobytes()).tolist() for a, b in zip(at, at[1:])] == [[0, 1, 200], [3, 70000, 1 << 31], [5]]
