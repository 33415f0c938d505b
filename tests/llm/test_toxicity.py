from functools import lru_cache

import pytest

from worldfold.llm import toxicity as t

from .helpers import with_extras

ROWS = [
    (1, "You are an idiot and a moron."), (2, "A clean text about gardens."), (3, 'The report said: "he is an idiot" and left.'), (4, "what an idiiot, so stupidd and patetic"),
    (5, None), (6, ""), (7, "The rhetorical word stupid is quoted: “stupid” they wrote."), (8, "clean words " * 50_000 + "scum scum"), (None, "worthless scum"), (1, "You are an idiot and a moron."), (9, "oron lower laser motion crowns"),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("first", [True, False])
def test_automaton_finds_what_edit_distance_finds(first):
    a = t.Automaton(t.LEXICON, first_letter=first)
    tried = set()
    for term in t.LEXICON:
        for k in range(len(term) + 1):
            for c in "aeix":
                tried |= {term[:k] + c + term[k:], term[:k] + c + term[k + 1 :], term[:k] + term[k + 1 :], term[:k] + c + term[k:] + c, term[1:k] + c}
    for word in sorted(tried):
        fits = [(distance(word, x), x) for x in t.LEXICON if distance(word, x) <= a.allowance(x) and word and (not first or word[0] == x[0])]
        found = a.match(word)
        if first:
            # With the first letter fixed, what follows it must be within the allowance.
            fits = [(distance(word[1:], x[1:]), x) for _, x in fits if distance(word[1:], x[1:]) <= a.allowance(x)]
        assert (found is None) == (not fits), word
        if found:
            assert found[1] == min(fits)[0]


def test_documents(spark):
    docs = with_extras(spark.createDataFrame(ROWS, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in t.toxic_documents(docs).collect()}
    assert set(found) == {1, 4, 8, None}
    assert found[1]["n_hits"] == 2 and found[4]["n_misspelled"] == 3
    left = t.without_toxic(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 6, 7, 9]
    none = docs.limit(0)
    assert t.toxic_documents(none).count() == 0 and t.without_toxic(none).count() == 0


@lru_cache
def quoted(before, after):
    return t.context(before, after, t.Scoring())


def test_context_tells_quotation_from_abuse():
    assert quoted('he said "you are an ', ' person" and left') == (0.2, True)
    assert quoted("you are an ", " person") == (1.5, False)
    assert quoted("the report called it ", " for years") == (0.5, True)
    assert quoted("“quoted” an ", " here") == (1.0, False)


def test_near_words_alone_and_far_apart_are_clean(spark):
    texts = [
        "they were discussing and digesting a wordless work of some worthiness", "you lose and he loses", "your lover knows the idiom of a salad", "der verein und ihr verein, verein verein verein", "the loser " + "plays on " * 200 + "a loser again",
        "what bastards they are", "those losers and clowns", "what an idiiot, so stupidd and patetic", "a pathetik loser",
    ]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in t.toxic_documents(docs).collect()) == [5, 6, 7, 8]
    assert sorted(r["doc_id"] for r in t.without_toxic(docs).collect()) == [0, 1, 2, 3, 4]


def test_near_words_that_a_corpus_has_often_are_its_own(spark):
    rows = [(k, f"der verein im idiom {k}") for k in range(6)] + [(10, "idiom verein salad"), (11, "a stupit man"), (12, "a loser in the verein")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert t.own_words(docs) == {"verein", "idiom"}
    assert t.toxic_documents(docs).count() == 0 and t.without_toxic(docs).count() == len(rows)
    # Far rarer than their term, they are misspellings.
    told = docs.union(spark.createDataFrame([(k, "vermin") for k in range(100, 280)], "doc_id long, text string"))
    assert t.own_words(told) == {"idiom"}


def test_rows_do_not_see_their_neighbours(spark):
    texts = ["call you ", "idiot here", 'he was talking "', 'idiot, go away."', "something here"]
    for order in (texts, texts[::-1]):
        docs = spark.createDataFrame([(texts.index(x), x) for x in order], "doc_id long, text string").coalesce(1)
        assert {r["doc_id"]: r["score"] for r in t.toxic_documents(docs).collect()} == {1: 1.0, 3: 1.0}


def brute_score(text, how):
    """The worst span of one text, by edit distances and plain strings."""
    import re

    hits = []
    found = list(re.finditer("[0-9a-z\\x80-\U0010ffff]+", (text or "").lower()))
    low = (text or "").lower()
    for k, m in enumerate(found):
        word, best = m[0], None
        if word in how.allowed:
            continue
        if word.endswith("s") and word[:-1] in how.lexicon and word not in how.lexicon:
            best = (0, word[:-1])
        else:
            for term in how.lexicon:
                room = 0 if len(term) < 5 else 1 if len(term) < 8 else 2
                room = min(room, 1) if term in how.learned else room
                if word[0] == term[0] and (e := distance(word[1:], term[1:])) <= room:
                    best = min(best or (99, ""), (e, term))
        if best is None:
            continue
        before = low[found[max(0, k - how.window)].start() : m.start()] if k < how.window else low[found[k - how.window - 1].end() if k > how.window else 0 : m.start()]
        if k <= how.window:
            before = low[: m.start()]
        after = low[m.end() : found[k + how.window + 1].start() if k + how.window + 1 < len(found) else len(low)]
        quoted, factor = False, 1.0
        near = {x.strip(".,;:!?()") for x in (before + " " + after).split()}
        closes = set("”»“›")
        if (before.count('"') % 2 and '"' in after) or any(o in before and closes & set(after) and not (closes - {o}) & set(before.split(o)[-1]) for o in "“«„‹"):
            quoted, factor = True, how.quoted
        elif near & t.ADDRESS:
            factor = how.addressed
        elif near & t.REPORTS:
            quoted, factor = True, how.reported
        edits, term = best
        squeezed = lambda x: re.sub(r"(.)\1+", r"\1", x)
        hits.append((k, term, edits, how.lexicon[term] * factor * (how.misspelled if edits else 1), quoted, edits == 1 and (len(term) >= 8 or squeezed(word) == squeezed(term))))
    worst = 0.0
    for k, *_ in hits:
        near = [x for x in hits if k - how.span < x[0] <= k]
        exact = [x for x in near if not x[2]]
        if not any(not x[4] for x in exact):
            sure = [x for x in near if x[5]]
            near = exact + sure if len({x[1] for x in sure}) >= how.unlike else exact
        worst = max(worst, sum(x[3] for x in near))
    return worst


def test_whole_query_against_brute_force(spark):
    import random

    rng = random.Random(5)
    how = t.taught(t.Scoring(), {"zorkel": 0.6, "blimflang": 0.6})
    parts = ["idiot", "idiiot", "stupidd", "worthles", "zorkel", "zorkl", "blimflang", "blmflng", "losers", "you", "said", '"', '"', "“", "”", "clown", "trash", *("plain words of a text that goes on and on".split() * 3)]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 12, 60, 400])))) for k in range(300)] + [(900, None), (901, ""), (3, "idiot"), (None, "a moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = t.replace(how, own_documents=10**9)
    got = sorted(((r["doc_id"], round(r["score"], 5)) for r in t.toxic_documents(docs, how).collect()), key=str)
    want = sorted(((i, round(s, 5)) for i, x in rows if (s := brute_score(x, how)) >= how.threshold - 1e-9), key=str)
    assert got == want and 50 < len(want) < 290


def test_learned_terms_catch_what_was_held_out(spark):
    """Held-out recall in every language, of words that no list has; a single chance hit is clean."""
    import random

    rng, rows, labels = random.Random(3), [], []
    for k in range(600):
        lang = ("xx", "yy")[k % 2]
        toxic = k % 5 == 0
        words = [f"{lang}{rng.randrange(300)}" for _ in range(80)]
        for _ in range(3 if toxic else rng.random() < 0.1):
            words[rng.randrange(80)] = f"grolm{lang}{rng.randrange(4)}"
        rows.append((k, " ".join(words), lang))
        if k < 300:
            labels.append((k, int(toxic)))
    docs = with_extras(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    told = spark.createDataFrame([*labels, (0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    terms = t.learn(docs, told)
    assert set(terms) == {f"grolm{lang}{n}" for lang in ("xx", "yy") for n in range(4)}
    found = {r["doc_id"] for r in t.toxic_documents(docs, labels=told).collect()}
    held = range(300, 600)
    for lang in (0, 1):
        assert sum(k in found for k in held if k % 5 == 0 and k % 2 == lang) >= 28
    assert sum(k in found for k in held if k % 5) <= 2
    assert t.learn(docs, told.limit(0)) == {} and t.learn(docs.limit(0), told) == {}
    assert t.without_toxic(docs, labels=told).count() == 600 - len(found)


def test_copies_among_labelled_documents_teach_once(spark):
    """Near copies of one toxic text make no terms of its rare words; texts that differ do."""
    import random

    rng, rows = random.Random(8), []
    base = [f"rare{k}" for k in range(200)]
    for k in range(12):
        near = list(base)
        near[rng.randrange(200)] = f"edit{k}"
        rows.append((k, " ".join(near) + " grolmx", "xx", 1))
    for k in range(12, 24):
        rows.append((k, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " grolmx", "xx", 1))
    for k in range(24, 224):
        rows.append((k, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)), "xx", 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    assert set(t.learn(table.drop("toxic").union(table.drop("toxic")), table.select("doc_id", "toxic"))) == {"grolmx"}
    assert t._apart([(1, "a", [5, 6]), (2, "a", [6, 7]), (3, "a", [7, 8]), (4, "b", [5, 8]), (5, "a", [9, 9])]) == {1, 4, 5}
