"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the words around each hit.

The product of the trie and the automata of all its terms is determinised as words arrive: a state is the set of
(trie node, edits so far) pairs that remain possible, so each letter of a word is one table lookup, and most words
die within two letters. A term of under 5 letters allows no edit, of under 8 one, of 8 or more two; the first letter
must agree, as typing errors seldom touch it.

Every hit counts by its term's severity, less if misspelled, less again if the words around it show a quotation
(an open quote mark before and a closing one after, or a reporting verb without anyone being addressed), more if
they address someone. A document is toxic if the hits of some ``span`` words of it sum to ``threshold``, whatever its length.

A misspelled hit is weak evidence, as ordinary words lie near terms too (lover, loser). It counts only beside an exact hit
that isn't quoted, or where ``unlike`` different terms are clearly misspelled within the span (one edit, which repeats a letter
or is in a term of 8 letters or more); and a near word that the corpus itself has often (``own_words``) is a word of its
own and no hit at all. A term with a plural s is an exact hit.

The terms come from a short list of strong ones and, where ``labels`` are given, from them: words that toxic documents of a
language have far more often than clean ones of any language (log odds over whole texts). Copies and near copies among the
labelled documents teach once, or every rare word of a copied toxic text would be a term. A learned term alone is never
enough, whoever is addressed: two must meet within the span, as chance brings single ones into clean texts too.

Defined cases: a null or empty text has no hit and is not toxic; repeated rows and ties are judged row by row, a null
doc_id is passed through; an empty table gives an empty result, and empty labels teach nothing; a doc_id labelled twice is toxic
if one label says so, and teaches by the first of its texts in order; very long texts are judged whole, span by span; any further columns are ignored or passed through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch, written
from .words import WORD_RE, chunks, plain, words

LEXICON: dict[str, float] = {
    **dict.fromkeys("idiot moron stupid pathetic worthless scum disgusting imbecile vermin degenerate subhuman bastard dumbass scumbag".split(), 1.0),
    **dict.fromkeys("idiota imbécil estúpido estúpida crétin connard salaud abruti dummkopf abschaum arschloch vollidiot".split(), 1.0),
    **dict.fromkeys("loser trash clown".split(), 0.8),
}
#: Words of their own that lie within an edit of a term.
ALLOWED = frozenset("lower loner laser closer loose looser crown crash thrash trasher sloped motion motor mormon studio stupor bastion bustard patheticism stupidity".split())
ADDRESS = frozenset("you your you're youre yours u ur yourself du dich dein deine ihr tu toi ton votre vous vos te tú usted eres".split())
REPORTS = frozenset("said says wrote writes called calls quoted quote quotes quoting alleged claimed reported term word phrase dijo escribió dit écrit sagte schrieb nannte mot palabra wort".split())
_WORD = re.compile(WORD_RE)
OPENING, CLOSING, EITHER = "“«„‹", "”»“›", '"'


@dataclass
class Automaton:
    """Terms as a trie, with the Levenshtein automaton of each run along it at once."""

    terms: Mapping[str, float]
    first_letter: bool = True
    #: Terms that allow one edit at most.
    tight: frozenset = frozenset()
    _child: list[dict[str, int]] = field(default_factory=list)
    _term: list[str | None] = field(default_factory=list)
    _room: list[int] = field(default_factory=list)
    _steps: list[dict[str, int]] = field(default_factory=list)
    _sets: list[tuple] = field(default_factory=list)
    _ids: dict[tuple, int] = field(default_factory=dict)
    _ends: list[tuple[str, int] | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._node()
        for term in self.terms:
            at, room = 0, self.room(term)
            self._room[0] = max(self._room[0], room)
            for c in term:
                if c not in self._child[at]:
                    self._child[at][c] = self._node()
                at = self._child[at][c]
                self._room[at] = max(self._room[at], room)
            self._term[at] = term
        self._state({0: 0}, start=True)

    @staticmethod
    def allowance(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 8 else 2

    def room(self, term: str) -> int:
        return min(self.allowance(term), 1) if term in self.tight else self.allowance(term)

    def _node(self) -> int:
        self._child.append({})
        self._term.append(None)
        self._room.append(0)
        return len(self._child) - 1

    def _state(self, found: dict[int, int], start: bool = False) -> int:
        """The id of a set of nodes with their least edits, after adding skips of term letters; -1 if none is left."""
        todo = [] if start and self.first_letter else list(found)
        while todo:
            n = todo.pop()
            for m in self._child[n].values():
                if (e := found[n] + 1) <= self._room[m] and e < found.get(m, 99):
                    found[m] = e
                    todo.append(m)
        if not found:
            return -1
        key = tuple(sorted(found.items()))
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._steps.append({})
            ends = [(e, self._term[n]) for n, e in key if self._term[n] is not None and e <= self.room(self._term[n])]
            self._ends.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for n, e in self._sets[state]:
            for letter, m in self._child[n].items():
                cost = e + (letter != c)
                if cost <= self._room[m] and cost < found.get(m, 99) and not (n == 0 and e == 0 and letter != c and self.first_letter):
                    found[m] = cost
            if e + 1 <= self._room[n] and not (n == 0 and self.first_letter) and e + 1 < found.get(n, 99):
                found[n] = e + 1
        self._steps[state][c] = to = self._state(found)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowance and the edits to it; the first in order among equals."""
        state = 0
        for c in word:
            steps = self._steps[state]
            state = steps[c] if c in steps else self._step(state, c)
            if state < 0:
                return None
        return self._ends[state]


@dataclass(frozen=True)
class Scoring:
    lexicon: Mapping[str, float] = field(default_factory=lambda: LEXICON)
    allowed: frozenset = ALLOWED
    #: Terms of the lexicon that were learned from labels.
    learned: frozenset = frozenset()
    window: int = 8
    threshold: float = 1.0
    misspelled: float = 0.7
    quoted: float = 0.2
    reported: float = 0.5
    addressed: float = 1.5
    #: Words within which hits are summed.
    span: int = 100
    #: Different clearly misspelled terms within the span that count without an exact hit.
    unlike: int = 3
    #: A near word is one of its own if so many documents have it, and so large a share of those that have the term.
    own_documents: int = 5
    own_share: float = 0.1


@dataclass(frozen=True)
class Learning:
    #: Labelled documents that are read at most, those whose doc_id has the least hashes.
    documents: int = 12_000
    #: Toxic documents of a language that have a term, at least, and their share of all its toxic ones.
    least: int = 3
    share: float = 0.05
    #: Log of the odds of a term in toxic documents against clean ones, in any language.
    odds: float = 2.5
    #: What a hit counts: below the threshold, even if someone is addressed.
    severity: float = 0.6
    #: Terms of a language at most, the most telling ones.
    terms: int = 500


def _bands(text: str, bands: int = 6, rows: int = 3) -> list[int]:
    """Min-hashes of the runs of three words, ``rows`` to a band: near copies agree in some band, others hardly ever."""
    found = _WORD.findall(text.lower())
    runs = {" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))}
    base = np.fromiter((xxhash.xxh64_intdigest(x) for x in runs), np.uint64, len(runs))
    least = [int(((base ^ np.uint64(xxhash.xxh64_intdigest(str(k)))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)).min()) for k in range(bands * rows)]
    return [hash((b, *least[b * rows : b * rows + rows])) for b in range(bands)]


def _apart(rows: Iterable[tuple[int, tuple, list[int]]]) -> frozenset:
    """The least id of every class of (id, kind, bands) that are of one kind and linked by equal bands."""
    root: dict[int, int] = {}
    first: dict[tuple, int] = {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, kind, bands in rows:
        root[i] = i
        for band in bands:
            a, b = sorted((top(i), top(first.setdefault((kind, band), i))))
            root[b] = a
    return frozenset(i for i in root if root[i] == i)


def learn(docs: DataFrame, labels: DataFrame, how: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> dict[str, float]:
    """Terms and severities told by ``labels``: a classifier's weights, fitted on at most ``how.documents`` whole documents."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.max(label_col) > 0).alias("toxic"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.documents)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(lang, F.lit("")).alias("lang")).where("text is not null")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["text"]).append_column("bands", pa.array([_bands(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int64())))

    with scratch(docs.sparkSession):
        told = F.broadcast(written(told, "labelled"))  # how.documents rows at most
        one = slim.join(told, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.max("toxic").alias("toxic"))
        seen = written(one.select("doc_id", "t.lang", "toxic", "t.text"), "texts")
        apart = _apart((r["doc_id"], (r["lang"], r["toxic"]), r["bands"]) for r in seen.mapInArrow(places, "doc_id long, lang string, toxic boolean, bands array<long>").collect())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for key, lang, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if key in apart:
                        counts.update((lang, toxic, word) for word in {None, *_WORD.findall(text.lower())})
            lang, toxic, word = zip(*counts) if counts else ((), (), ())
            n = np.array(list(counts.values()), np.int64)
            bad = np.array(toxic, bool)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(np.where(bad, n, 0)), pa.array(np.where(bad, 0, n))], names=["lang", "word", "bad", "good"])

        counts = written(seen.mapInArrow(run, "lang string, word string, bad long, good long").groupBy("lang", "word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
        total = {r["lang"]: (r["bad"], r["good"]) for r in counts.where("word is null").collect()}
        if not any(bad for bad, _ in total.values()):
            return {}
        # At most 1 / share times the words of a toxic document in each language.
        often = F.create_map(*[F.lit(x) for lang, (bad, _) in total.items() for x in (lang, float(max(how.least, how.share * bad)))])
        some = counts.where(F.col("word").isNotNull() & (F.col("bad") >= often[F.col("lang")])).select("word").distinct()
        rows = counts.join(some, "word").collect()
    worst: dict[str, float] = {}
    for r in rows:
        worst[r["word"]] = max(worst.get(r["word"], 0.0), (r["good"] + 0.5) / (total[r["lang"]][1] + 1))
    out: dict[str, float] = {}
    for lang, (bad, _) in total.items():
        own = [(log((r["bad"] + 0.5) / (bad + 1)) - log(worst[r["word"]]), r["bad"], r["word"]) for r in rows if r["lang"] == lang and r["bad"] >= max(how.least, how.share * bad) and len(r["word"]) > 2]
        best = sorted((x for x in own if x[0] >= how.odds), key=lambda x: (-x[0] * x[1], x[2]))[: how.terms]
        out |= dict.fromkeys((x[2] for x in best), how.severity)
    return out


def taught(how: Scoring, terms: Mapping[str, float]) -> Scoring:
    """``how`` with learned terms beside its own; its own ones keep their severity."""
    fresh = {t: s for t, s in terms.items() if t not in how.lexicon}
    return replace(how, lexicon={**how.lexicon, **fresh}, learned=how.learned | frozenset(fresh), allowed=how.allowed - frozenset(fresh))


def context(before: str, after: str, how: Scoring) -> tuple[float, bool]:
    """The factor that the text on either side of a hit gives it, and whether it stands in a quotation."""
    opened = before.count(EITHER) % 2 == 1 and EITHER in after
    for mark in OPENING:
        at = before.rfind(mark)
        opened |= at >= 0 and not any(c in CLOSING and c != mark for c in before[at + 1 :]) and any(c in CLOSING for c in after)
    if opened:
        return how.quoted, True
    around = {w.strip(".,;:!?()") for w in (before + " " + after).split()}
    if around & ADDRESS:
        return how.addressed, False
    return (how.reported, True) if around & REPORTS else (1.0, False)


def clear(word: str, term: str, edits: int) -> bool:
    """Whether a near word can hardly be another word."""
    return edits == 1 and (len(term) >= 8 or [c for c, _ in groupby(word)] == [c for c, _ in groupby(term)])


@dataclass(frozen=True)
class Hit:
    place: int
    term: str
    edits: int
    score: float
    quoted: bool
    clear: bool


def worst(hits: list[Hit], how: Scoring) -> float:
    """The highest sum of the hits (in order of place) within the span."""
    most, first = 0.0, 0
    for last, hit in enumerate(hits):
        while hit.place - hits[first].place >= how.span:
            first += 1
        near = hits[first : last + 1]
        exact = [x for x in near if not x.edits]
        if not any(not x.quoted for x in exact):
            sure = [x for x in near if x.clear]
            near = exact + sure if len({x.term for x in sure}) >= how.unlike else exact
        most = max(most, sum(x.score for x in near))
    return most


class Judge:
    """Scores texts; made once in each Python worker."""

    def __init__(self, how: Scoring) -> None:
        self.how, self.automaton, self.known = how, Automaton(how.lexicon, tight=how.learned), {}
        starts = {t[0].encode()[0] for t in how.lexicon if t}
        lengths = [len(t.encode()) for t in how.lexicon] or [0]
        self.first = np.zeros(256, bool)
        self.first[list(starts)] = True
        self.shortest, self.longest = min(lengths) - 4, max(lengths) + 8

    def match(self, word: str) -> tuple[str, int] | None:
        if word in self.how.allowed:
            return None
        return (word[:-1], 0) if word.endswith("s") and word[:-1] in self.how.lexicon and word not in self.how.lexicon else self.automaton.match(word)

    def by_row(self, texts: pa.Array) -> dict[int, list[Hit]]:
        """The hits of every row that has some."""
        out: dict[int, list[Hit]] = {}
        for row, i, word, lo, hi, (s, e, data), term, edits in self.found(texts):
            factor, quoted = context(data[lo : s[i]].tobytes().decode(errors="ignore"), data[e[i] : hi].tobytes().decode(errors="ignore"), self.how)
            out.setdefault(row, []).append(Hit(i, term, edits, self.how.lexicon[term] * factor * (self.how.misspelled if edits else 1.0), quoted, clear(word, term, edits)))
        return out

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, str, int, float, bool]]:
        """(row, term, edits, score, quoted) of every hit."""
        for row, hits in self.by_row(texts).items():
            for x in hits:
                yield row, x.term, x.edits, x.score, x.quoted

    def found(self, texts: pa.Array) -> Iterator[tuple]:
        """(row, place, word, begin and end of the words around it, where words are, term, edits) of every hit."""
        h, offsets, data, s, e, bounds = words(texts, spans=True)
        size = e - s
        some = np.flatnonzero(self.first[data[s]] & (size >= self.shortest) & (size <= self.longest)) if len(s) else s
        if not len(some):
            return
        kinds, at, of = np.unique(h[some], return_index=True, return_inverse=True)
        if len(self.known) > 1_000_000:
            self.known.clear()
        hit = np.zeros(len(kinds), bool)
        found: list[tuple[str, int] | None] = [None] * len(kinds)
        for k, (key, i) in enumerate(zip(kinds.tolist(), some[at].tolist())):
            if key not in self.known:
                word = data[s[i] : e[i]].tobytes().decode()
                self.known[key] = self.match(word)
            if (m := self.known[key]) is not None:
                hit[k], found[k] = True, m
        rows = np.searchsorted(offsets, some, side="right") - 1
        for j in np.flatnonzero(hit[of]).tolist():
            i, row = int(some[j]), int(rows[j])
            term, edits = found[of[j]]
            a, b = max(int(offsets[row]), i - self.how.window), min(int(offsets[row + 1]), i + self.how.window + 1)
            lo = e[a - 1] if a > offsets[row] else bounds[row]  # never a byte of a neighbouring text
            hi = s[b] if b < offsets[row + 1] else bounds[row + 1]
            yield row, i, data[s[i] : e[i]].tobytes().decode(), lo, hi, (s, e, data), term, edits


def own_words(docs: DataFrame, how: Scoring = Scoring(), text_col: str = "text") -> frozenset:
    """The near words that ``docs`` have too often for misspellings; one row for each near word and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, counts = Judge(how), Counter()
        for batch in chunks(batches):
            seen = {(row, word if edits else term, term, edits > 0) for row, _, word, *_, term, edits in judge.found(batch.column("text"))}
            counts.update(x[1:] for x in seen)
        word, term, near = zip(*counts) if counts else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(term, pa.string()), pa.array(near, pa.bool_()), pa.array(list(counts.values()), pa.int64())], names=["word", "term", "near", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, term string, near boolean, n long").groupBy("word", "term", "near").agg(F.sum("n").alias("n"))
    rows = counts.where(F.expr(f"not near or n >= {how.own_documents}")).collect()
    exact = {r["term"]: r["n"] for r in rows if not r["near"]}
    return frozenset(r["word"] for r in rows if r["near"] and r["n"] >= how.own_share * exact.get(r["term"], 0))


def _told(docs: DataFrame, how: Scoring, labels: DataFrame | None, id_col: str, text_col: str) -> Scoring:
    """``how`` with learned terms and the corpus's own words; a stream can't be read beforehand."""
    if labels is not None and not docs.isStreaming:
        how = taught(how, learn(docs, labels, id_col=id_col, text_col=text_col))
    return how if docs.isStreaming else replace(how, allowed=how.allowed | own_words(docs, how, text_col))


def toxic_documents(docs: DataFrame, how: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text", labels: DataFrame | None = None) -> DataFrame:
    """Every toxic document: doc_id, score (of its worst span), n_hits, n_quoted, n_misspelled, terms."""
    how = _told(docs, how, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(how)
        for batch in chunks(batches):
            rows = judge.by_row(batch.column("text"))
            ids = batch.column("doc_id").to_pylist() if rows else []
            out = [(ids[r], round(score, 6), len(x), sum(h.quoted for h in x), sum(h.edits > 0 for h in x), " ".join(sorted({h.term for h in x}))) for r, x in rows.items() if (score := worst(x, how)) >= how.threshold - 1e-9]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out)) or [()] * 6, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "score", "n_hits", "n_quoted", "n_misspelled", "terms"])

    return plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_hits long, n_quoted long, n_misspelled long, terms string")


def without_toxic(docs: DataFrame, how: Scoring = Scoring(), text_col: str = "text", labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; a row filter, without a join."""
    how = _told(docs, how, labels, id_col, text_col)
    judges: list[Judge] = []

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        if not judges:
            judges.append(Judge(how))
        out = []
        for part in chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            found = np.zeros(part.num_rows, bool)
            for row, hits in judges[0].by_row(part.column(0)).items():
                found[row] = worst(hits, how) >= how.threshold - 1e-9
            out.append(found)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(~toxic(docs[text_col].cast("string")))
