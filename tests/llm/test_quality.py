import math
import random
from collections import Counter, defaultdict

from worldfold.llm import quality as q

from .helpers import with_extras

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, trusted_of, order):
    """(half, lang) -> log perplexity of a text, by dictionaries."""
    models = {}
    for half in (0, 1):
        for lang in {r[1] for r in rows}:
            counts = [Counter() for _ in range(order + 1)]
            for i, l, t in rows:
                if l == lang and t is not None and trusted_of.get(i) == half:
                    w = q.START * (order - 1) + t
                    counts[order].update(w[k : k + order] for k in range(len(w) - order + 1))
            for n in range(order - 1, 0, -1):
                counts[n] = Counter(g[1:] for g in counts[n + 1])
            levels = []
            for n in range(1, order + 1):
                of = Counter(counts[n].values())
                n1, n2, n3, n4 = (max(of[k], 1) for k in (1, 2, 3, 4))
                y = n1 / (n1 + 2 * n2)
                d = [0, *(max(0.1, v) for v in (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
                ctx = defaultdict(lambda: [0, 0.0])
                for g, c in counts[n].items():
                    ctx[g[:-1]][0] += c
                    ctx[g[:-1]][1] += min(d[min(c, 3)], c)
                levels.append((counts[n], d, ctx))
            models[half, lang] = levels

    def log_perplexity(half, lang, text):
        total, levels = 0.0, models[half, lang]
        w = q.START * (order - 1) + text
        for k in range(order - 1, len(w)):
            p = 1 / (len(levels[0][0]) + 1)
            for n, (counts, d, ctx) in enumerate(levels, 1):
                g = w[k - n + 1 : k + 1]
                if g[:-1] in ctx:
                    total_n, given = ctx[g[:-1]]
                    c = counts.get(g, 0)
                    p = (c - min(d[min(c, 3)], c)) / total_n + given / total_n * p
            total -= math.log(p)
        return total / len(text)

    return log_perplexity


def test_perplexities_and_verdicts(spark):
    rng = random.Random(13)
    syllables = {"en": "the ing ed an er".split(), "fr": "é le la oi eau".split(), None: "zu ko pa".split()}
    rows = [(k, lang, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.choice([1, 20, 60])))) for k, lang in enumerate([*["en", "fr", None] * 20])]
    rows += [(100, "en", "XQZ!! 77## " * 20), (101, "en", None), (102, "en", ""), (103, "xx", "no model here"), (None, "en", "the ing the"), (4, *rows[4][1:]), (105, "en", "🙂 the ed")]
    labels = [(k, 1, 0) for k in range(45)] + [(100, 0, 0), (50, 1, 0), (50, 0, 0), (None, 1, 0)]
    docs = with_extras(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    got = {(r["doc_id"], r["lang"]): r for r in q.judge(docs, spark.createDataFrame(labels, LABELS), q.Model(block=3000)).collect()}
    halves = dict(map(tuple, spark.createDataFrame([(k,) for k in range(45)], "doc_id long").selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 2) as int)").collect()))
    log = brute(rows, halves, q.Model().order)
    for i, lang, text in rows:
        r = got[i, lang]
        if not text:
            assert r["perplexity"] is None and r["keep"] is False
            continue
        one, two = (log(h, lang, text) for h in (0, 1))
        want = two if halves.get(i) == 0 else one if halves.get(i) == 1 else (one + two) / 2
        assert abs(math.log(r["perplexity"]) - want) < 1e-5, (i, lang)
        if lang == "xx":
            assert r["threshold"] is None and r["keep"]
        else:
            limits = sorted(math.exp(log(1 - halves[k], lang, t)) for k, l, t in rows if k in halves and l == lang)
            assert abs(r["threshold"] - limits[math.ceil(0.99 * len(limits)) - 1]) < 1e-3
            assert r["keep"] == (r["perplexity"] <= r["threshold"])
    # A shuffled input is read alike both times.
    assert q.judge(docs.repartition(5), spark.createDataFrame(labels, LABELS), q.Model(block=500)).where("keep").count() == sum(r["keep"] for r in got.values()) + 1
    assert got[100, "en"]["keep"] is False and len(got) == len(rows) - 1
    assert q.judge(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_digits_are_told_apart_like_letters(spark):
    """Texts with digits get what the same texts get with a letter of its own for each digit; five characters are seen."""
    assert q.Model().order >= 5
    rng = random.Random(5)
    rows = [(k, "en", " ".join(f"no {rng.choice([1999, 2024, 7])} of {rng.randrange(50)}" for _ in range(12))) for k in range(16)] + [(50, "en", "no 1999 of 2024"), (51, "en", "no 9919 of 4202")]
    letters = str.maketrans("0123456789", "ABCDEFGHIJ")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(16)], LABELS)
    one, two = ({r["doc_id"]: r["perplexity"] for r in q.judge(spark.createDataFrame(x, "doc_id long, lang string, text string"), labels).collect()} for x in (rows, [(i, l, t.translate(letters)) for i, l, t in rows]))
    assert all(abs(one[i] - two[i]) < 1e-6 for i in one) and one[50] < one[51]


def test_language_with_all_trusted_text_in_one_half(spark):
    rows = [(1, "aa", "the one trusted text of a rare language"), (2, "aa", "another text of a rare language"), (3, None, "zu ko pa zu ko"), (4, None, "ko pa zu")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in q.judge(docs, spark.createDataFrame([(1, 1, 0), (3, 1, 0)], LABELS)).collect()}
    halves = dict(map(tuple, docs.selectExpr("doc_id", "cast(pmod(xxhash64(doc_id), 2) as int)").collect()))
    trusted = {k: halves[k] for k in (1, 3)}
    log = brute(rows, trusted, q.Model().order)
    for (i, lang, text), own in zip(rows, (1, 1, 3, 3)):
        assert got[i]["threshold"] is None and got[i]["keep"]
        assert abs(math.log(got[i]["perplexity"]) - log(halves[own], lang, text)) < 1e-5 and got[i]["perplexity"] > 1.1
