from worldfold.llm import licenses as c

from .helpers import with_extras, words_of

MIT = c.TEMPLATES["MIT"]
CHANGED = MIT.replace("free of charge", "without any charge").replace("sublicense, ", "")
ROWS = [
    (1, "intro words here. " + MIT + " trailing words"), (2, "some code " + CHANGED + " end"), (3, "Released under the MIT License."), (4, "nothing to see"), (5, None), (6, ""), (None, MIT),
    (7, "All rights reserved. x y z All rights reserved."), (8, "word " * 20_000 + "licensed under CC BY-NC 4.0"), (3, "Released under the MIT License."), (9, " ".join(MIT.split()[:40])),
]


def brute(text, how=c.Scan()):
    """Local alignment of whole texts without index or band; the same settlement of overlaps."""
    import numpy as np
    import pyarrow as pa

    from worldfold.llm.words import words

    reports = []
    for name in sorted(c.TEMPLATES):
        h, at = words(pa.array([text, c.TEMPLATES[name]]))
        doc, template = h[: at[1]], h[at[1] :]
        begin = 0
        while begin < len(doc):
            part = doc[begin:]
            matched, a, b = c.align(np.asarray(part), template, -len(template), len(part))
            if matched < how.coverage * len(template) - 1e-9 or not matched:
                break
            reports.append((-matched, -matched / len(template), name, a + begin, b + begin))
            begin += b
    kept = []
    for r in sorted(reports):
        if all(r[4] <= k[3] or k[4] <= r[3] for k in kept):
            kept.append(r)
    return sorted((name, -m, a, b) for m, _, name, a, b in kept)


def test_reports(spark):
    docs = with_extras(spark.createDataFrame(ROWS, "doc_id long, text string"))
    got: dict[int, list] = {}
    for r in c.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["matched_words"], r["begin_word"], r["end_word"]))
    assert sorted(got) == [1, 2, 3, 7, 8]
    assert len(got[3]) == 2 and len(got[7]) == 2
    for i, text in ROWS:
        if i in (1, 2, 7):
            assert sorted(got[i]) == brute(text)
    n = len(words_of(MIT))
    assert got[1] == [("MIT", n, 3, 3 + n)] and got[2][0][1] == n - 3 or got[2][0][1] >= n - 4
    assert c.scan(docs.limit(0)).count() == 0
    assert c.scan(docs, {}).count() == 0 and c.scan(docs, {"none": ""}).count() == 0


def test_copies_with_inserted_words(spark):
    name = max(c.TEMPLATES, key=lambda n: len(words_of(c.TEMPLATES[n])))
    text = c.TEMPLATES[name].split()
    half = len(text) // 2
    rows = [(k, " ".join(text[:half] + ["inserted"] * k + text[half:])) for k in (0, 8, 9, 20, 39)]
    got = {r["doc_id"]: r for r in c.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["license"] == name}
    assert set(got) == {k for k, _ in rows} and all(r["coverage"] == 1.0 for r in got.values())
    for k, x in rows:
        assert (name, got[k]["matched_words"], got[k]["begin_word"], got[k]["end_word"]) in brute(x)
