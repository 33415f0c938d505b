"""Quality: an interpolated modified Kneser-Ney model of character n-grams, trained for each language on trusted text.

Training counts the highest order in all trusted documents; lower orders count the distinct letters to the left.
Discounts, context totals and back-off weights are aggregates and joins of count tables sharded by n-gram. For scoring,
documents are packed into blocks (a task's documents, up to ``block`` bytes); each block asks once for each n-gram that it holds, every distinct n-gram is scored
once by joins with the tables of the orders down to one that it was seen in, and the answers go back to the block, which adds them up by document.
Input that isn't a plain scan of files is written first, as it is read twice and must come in the same order.

A text is no surprise to a model that was trained on it, so the trusted documents are split in two (by a hash of doc_id) and
each half trains a model: a trusted document is scored by the other half's, any other by both (the geometric mean of the perplexities). A
document's perplexity is compared with a quantile of all trusted documents' perplexities in its language. Where one half has no
text of a language, the other's model scores all its documents; its own trusted documents, which it was trained on, then give no
threshold.

Characters, not words, as words of noise are mostly new in clean and in bad documents alike.

Defined cases: null and empty texts have no perplexity and aren't kept; a null language is one of its own; documents of a
language without trusted text, or with all of it in one half, have no threshold and are kept; a document is trusted if all its labels are 1 and it has one; repeated rows
are judged row by row, and count as often in training; a perplexity equal to the threshold is kept; empty tables give an
empty result; a very long text is scored whole, in a piece of its own; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept, release, scratch, settled, written
from .sizes import hinted
from .words import chunks, mix, trim, window_hashes

START = "\x02"
#: Least discount: with few counts the estimates can reach 0, which would leave nothing for n-grams that were not seen.
LEAST = 0.1


@dataclass(frozen=True)
class Model:
    order: int = 5
    #: Quantile of the trusted documents' perplexities up to which a document is kept.
    quantile: float = 0.99
    #: Bytes of text in a block, the unit that asks for scores.
    block: int = 256 << 20


def _symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ``order - 1`` starts, and where each begins."""
    pad = START * (order - 1)
    points = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le"), np.uint32)
    return points, np.cumsum([0, *(len(t) + order - 1 for t in texts)])


def _gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    return window_hashes(mix(points.astype(np.uint64)), order)


def _inside(bounds: np.ndarray, n: int, order: int) -> np.ndarray:
    """Which of ``n`` n-grams lie within one text."""
    out = np.ones(n, bool)
    for k in range(1, order):
        cut = bounds[1:-1] - k
        out[cut[(cut >= 0) & (cut < n)]] = False
    return out


def _distinct(points: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, count and one place of every distinct n-gram."""
    h = _gram_hashes(points, order)
    at = np.flatnonzero(_inside(bounds, len(h), order))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, order), np.uint32)
    codes, kinds = pd.factorize(h[at])
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = at[::-1]
    return kinds, np.bincount(codes, minlength=len(kinds)), np.stack([points[first + k] for k in range(order)], axis=1)


def _hashes_of(grams: pa.Array, order: int) -> np.ndarray:
    """_gram_hashes of n-grams that stand for themselves."""
    points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32)
    return _gram_hashes(points, order)[::order]


class Grams:
    """Distinct n-grams with their counts, by language."""

    def __init__(self, order: int) -> None:
        self.order, self.parts = order, {}

    def add(self, lang: str | None, points: np.ndarray, bounds: np.ndarray) -> None:
        held = self.parts.setdefault(lang, [])
        held.append(_distinct(points, bounds, self.order))
        if len(held) > 8:
            self.parts[lang] = [self.joined(lang)]

    def joined(self, lang: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, n, g = (np.concatenate(x) for x in zip(*self.parts[lang]))
        codes, kinds = pd.factorize(h)
        first = np.empty(len(kinds), np.int64)
        first[codes[::-1]] = np.arange(len(h))[::-1]
        return kinds, np.bincount(codes, weights=n, minlength=len(kinds)).astype(np.int64), g[first]

    def rows(self) -> Iterator[tuple[str | None, pa.Array, np.ndarray]]:
        for lang in self.parts:
            _, n, g = self.joined(lang)
            for begin in range(0, len(n), 50_000):
                part = slice(begin, begin + 50_000)
                text = g[part].astype("<u4").tobytes().decode("utf-32-le")
                yield lang, pa.array([text[k : k + self.order] for k in range(0, len(text), self.order)], pa.string()), n[part]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    langs = batch.column("lang").to_pylist()
    for lang in dict.fromkeys(langs):
        yield lang, batch.filter(pa.array([x == lang for x in langs]))


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each n-gram of the highest order occurs in ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(order)
        for batch in chunks(batches):
            for lang, part in _by_language(batch):
                grams.add(lang, *_symbols([t or "" for t in part.column("text").to_pylist()], order))
        for lang, gram, n in grams.rows():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), gram, pa.array(n)], names=["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """Of (lang, gram, n) of the highest order, by order from 1: (lang, gram, p), the probability of the gram's last letter after its
    others, and (lang, context, back, kinds), the weight of the lower order and the number of letters that follow."""
    tables = []
    for k in range(order, 0, -1):
        if k < order:
            counts = counts.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        counts = written(counts, "counts")
        tables.append(counts)
    levels: list[tuple[DataFrame, DataFrame]] = []
    for k, counts in enumerate(tables[::-1], 1):
        of = counts.groupBy("lang").agg(*[F.greatest(F.count_if(F.col("n") == i), F.lit(1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        less = [F.greatest(F.lit(LEAST), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).alias(f"d{i}") for i in (1, 2, 3)]
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = counts.join(hinted(written(of.select("lang", *less), "discounts")), "lang").select("lang", "gram", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), "n", F.least(cut, F.col("n")).alias("cut"))
        # A context is followed by at most as many letters as there are.
        after = Window.partitionBy("lang", "context")
        rows = rows.select("lang", "gram", "context", "n", "cut", F.sum("n").over(after).alias("total"), F.sum("cut").over(after).alias("given"), F.count("*").over(after).alias("kinds"))
        rows = rows.select("lang", "gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("mass"), (F.col("given") / F.col("total")).alias("back"), "kinds")
        if levels:
            lower = levels[-1][0].withColumnRenamed("gram", "_s").withColumnRenamed("p", "lower")
            rows = rows.withColumn("_s", F.expr("substring(gram, 2)")).join(hinted(lower), ["lang", "_s"])
        else:
            rows = rows.withColumn("lower", 1 / (F.col("kinds") + 1))
        rows = written(rows.select("lang", "gram", "context", "back", "kinds", (F.col("mass") + F.col("back") * F.col("lower")).alias("p")), "level")
        contexts = written(rows.groupBy("lang", "context").agg(F.max("back").alias("back"), F.max("kinds").alias("kinds")), "contexts")
        levels.append((rows.select("lang", "gram", "p"), contexts))
    release(counts.sparkSession)
    return levels


def score_grams(asked: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``asked`` (distinct lang, gram, …) with logp. An n-gram that was seen has its probability; of the others, fewer with each order,
    the back-off weights are multiplied until a shorter one was."""
    order, names = len(levels), asked.columns
    todo, done = asked.withColumn("weight", F.lit(1.0)), []
    for k in range(order, 0, -1):
        seen, contexts = levels[k - 1]
        part = todo.withColumn("_g", F.expr(f"substring(gram, {order - k + 1})"))
        part = written(part.join(hinted(seen.withColumnRenamed("gram", "_g")), ["lang", "_g"], "left").select(*names, "weight", "p"), "met")
        done.append(part.where("p is not null").select(*names, (F.col("weight") * F.col("p")).alias("p")))
        left = part.where("p is null").withColumn("_c", F.expr(f"substring(gram, {order - k + 1}, {k - 1})"))
        left = left.join(hinted(contexts.withColumnRenamed("context", "_c")), ["lang", "_c"], "left")
        todo = left.select(*names, (F.col("weight") * F.coalesce("back", F.lit(1.0))).alias("weight"), *["kinds"] * (k == 1))
    out = todo.select(*names, (F.col("weight") / (F.coalesce("kinds", F.lit(0)) + 1)).alias("p"))
    for part in done:
        out = out.union(part)
    return out.select(*names, F.ln("p").alias("logp"))


PACKED = "block long, piece int, tongue string, gram string, head binary, body binary"


def _tongue(lang: str | None) -> str:
    """A language's name that is never null."""
    return "" if lang is None else "=" + lang


def fixed(df: DataFrame) -> DataFrame:
    """``df`` itself if every reading gives the same rows in the same order, a plain scan of files; else it is written first."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    plain = all(line.lstrip(" +-:").startswith(("Project", "Filter", "Relation")) for line in plan.splitlines() if line.strip())
    return df if plain else settled(df, "fixed")


def _packed(docs: DataFrame, model: Model, bodies: bool) -> DataFrame:
    """Blocks of documents: their compressed texts by language (``bodies``), or the n-grams that they ask for."""

    names, kinds = zip(*(x.split() for x in PACKED.split(", ")))
    arrow = dict(long=pa.int64(), int=pa.int32(), string=pa.string(), binary=pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=9)

        def rows(n: int, **columns) -> pa.RecordBatch:
            own = [columns.get(name) for name in names]
            return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array([v] * n, arrow[t]) for v, t in zip(own, kinds)], names=list(names))

        def settled(digest, pieces: list, grams: Grams) -> Iterator[pa.RecordBatch]:
            # Named by its content: both kinds of rows name a block alike, wherever and however often they are made.
            block = digest.intdigest() >> 1
            for k, (lang, head, body) in enumerate(pieces, 1):
                yield rows(1, block=block, piece=k, tongue=_tongue(lang), head=head, body=body)
            for lang, gram, n in grams.rows():
                yield rows(len(n), block=block, piece=0, tongue=_tongue(lang), gram=gram)

        digest, pieces, grams, size = xxhash.xxh3_64(), [], Grams(model.order), 0
        for batch in chunks(batches):
            for lang, part in _by_language(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = part.column("doc_id")
                head = np.stack([pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), np.array([len(t) for t in texts])]).astype(np.int64).tobytes()
                body = "".join(texts).encode()
                digest.update(repr(lang).encode() + head + body)
                if bodies:
                    pieces.append((lang, head, press.compress(body)))
                else:
                    grams.add(lang, *_symbols(texts, model.order))
            size += batch.nbytes
            if size > model.block:
                yield from settled(digest, pieces, grams)
                digest, pieces, grams, size = xxhash.xxh3_64(), [], Grams(model.order), 0
        yield from settled(digest, pieces, grams)

    return docs.mapInArrow(run, PACKED)


def perplexities(docs: DataFrame, trusted: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lang, n_chars, log0, log1) of every row of ``docs`` (doc_id, lang, text), its log perplexity under each half's model that is
    trained on ``trusted`` (lang, text); and the models' names (lang)."""
    with scratch(docs.sparkSession):  # the tables of training are gone before texts are moved
        levels = train(count_grams(trusted, model.order), model.order)
        models = kept(levels[0][1].select("lang"), "models")
        asked = _packed(docs, model, bodies=False).select("block", "tongue", "gram")
        kinds = kept(asked.groupBy("tongue", "gram").agg(F.collect_list("block").alias("blocks")), "asked")
        halves = F.explode(F.array(F.lit("0"), F.lit("1"))).alias("half")
        both = kinds.select("tongue", "gram", halves).select(F.concat("half", "tongue").alias("lang"), "gram", "tongue", "half")
        logs = score_grams(both, levels)
        scored = kept(logs.groupBy("tongue", "gram").agg(*[F.max(F.when(F.col("half") == k, F.col("logp"))).cast("float").alias(f"log{k}") for k in "01"]), "scored")
        del levels, logs, both, asked
    release(docs.sparkSession)
    answers = kinds.join(hinted(scored), ["tongue", "gram"]).select(F.explode("blocks").alias("block"), "tongue", "gram", "log0", "log1")
    none = F.lit(None)
    rows = answers.select("block", F.lit(0).alias("piece"), "tongue", "gram", none.cast("binary").alias("head"), none.cast("binary").alias("body"), "log0", "log1")
    rows = rows.union(_packed(docs, model, bodies=True).select("*", none.cast("float"), none.cast("float")))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index, values = None, [], {}, {}
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            begin = np.flatnonzero(np.diff(batch.column("block").to_numpy(), prepend=-1))
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if (k := part.column("block")[0].as_py()) != block:
                    block, held, index, values = k, [], {}, {}
                told = part.column("gram").is_valid()
                if (own := part.filter(told)).num_rows:
                    names = own.column("tongue").dictionary_encode()
                    grams, logs = own.column("gram"), np.stack([own.column(c).to_numpy(zero_copy_only=False) for c in ("log0", "log1")], axis=1)
                    hashes = _hashes_of(grams, model.order)
                    for code, name in enumerate(names.dictionary.to_pylist()):
                        at = names.indices.to_numpy() == code
                        held.append((name, hashes[at], logs[at]))
                for name, head, body in zip(*(part.filter(pc.invert(told)).column(c).to_pylist() for c in ("tongue", "head", "body"))):
                    if name not in index:
                        mine = [x for x in held if x[0] == name]
                        keys = np.concatenate([x[1] for x in mine]) if mine else np.zeros(0, np.uint64)
                        keys, first = np.unique(keys, return_index=True)
                        index[name], values[name] = pd.Index(keys), (np.concatenate([x[2] for x in mine]) if mine else np.zeros((0, 2)))[first].astype(np.float64)
                        held = [x for x in held if x[0] != name]
                    ids, null, size = np.frombuffer(head, np.int64).reshape(3, -1)
                    text = press.decompress(body).decode()
                    cut = np.concatenate([[0], np.cumsum(size)]).tolist()
                    points, bounds = _symbols([text[x:y] for x, y in zip(cut, cut[1:])], model.order)
                    logs = np.zeros((len(size), 2))
                    some = np.flatnonzero(size > 0)
                    if len(some):
                        h = _gram_hashes(points, model.order)
                        inside = _inside(bounds, len(h), model.order)
                        at = index[name].get_indexer(h[inside])
                        if (at < 0).any():
                            raise RuntimeError("a block's n-grams differ between two readings of its documents")
                        logs[some] = np.add.reduceat(values[name][at], np.concatenate([[0], np.cumsum(size[some])[:-1]]), axis=0)
                    logs = -logs / np.maximum(size, 1)[:, None]
                    lang = name[1:] if name else None
                    yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array([lang] * len(ids), pa.string()), pa.array(size), pa.array(logs[:, 0].copy()), pa.array(logs[:, 1].copy())], names=["doc_id", "lang", "n_chars", "log0", "log1"])
        trim()

    placed = rows.repartition("block").sortWithinPartitions("block", "piece")
    return placed.mapInArrow(add_up, "doc_id long, lang string, n_chars long, log0 double, log1 double"), models


def _named(half: Column, lang: Column) -> Column:
    """The name of a half's model of a language; never null."""
    return F.concat(half.cast("string"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")))


def judge(docs: DataFrame, labels: DataFrame, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, keep of every row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    good = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(label_col).alias("least")).where("least = 1").select("doc_id")
    with scratch(docs.sparkSession):
        return kept(_judged(slim, good, model), "judged")


def _judged(slim: DataFrame, good: DataFrame, model: Model) -> DataFrame:
    slim = fixed(slim)
    good = written(good.withColumn("half", F.expr("cast(pmod(xxhash64(doc_id), 2) as int)")), "trusted")
    trusted = slim.where("text is not null").join(hinted(good), "doc_id")
    logs, models = perplexities(slim, trusted.select(_named(F.col("half"), F.col("lang")).alias("lang"), "text"), model)
    logs = logs.join(hinted(good), "doc_id", "left")
    for k in (0, 1):
        logs = logs.join(F.broadcast(models.select(F.col("lang").alias(f"of{k}"))), _named(F.lit(k), F.col("lang")) == F.col(f"of{k}"), "left")
    log0, log1 = (F.when(F.col(f"of{k}").isNotNull(), F.col(f"log{k}")) for k in (0, 1))
    some = F.coalesce(log0, log1, F.lit(0.0))
    log = F.when(F.col("half") == 0, F.coalesce(log1, some)).when(F.col("half") == 1, F.coalesce(log0, some)).otherwise(F.coalesce((log0 + log1) / 2, some))
    fair = F.coalesce(F.when(F.col("half") == 0, log1).otherwise(log0).isNotNull() & F.col("half").isNotNull(), F.lit(False))
    scores = written(logs.select("doc_id", "lang", "n_chars", fair.alias("fair"), F.when(F.col("n_chars") > 0, F.exp(log)).alias("perplexity")), "perplexities")
    limits = scores.where("fair").groupBy("lang").agg(F.percentile_approx("perplexity", model.quantile, 10_000).alias("threshold"))
    out = scores.alias("s").join(F.broadcast(limits).alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    keep = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return out.select("doc_id", "s.lang", "n_chars", F.round("perplexity", 9).alias("perplexity"), F.round("threshold", 9).alias("threshold"), keep.alias("keep"))
