"""Benchmark decontamination over a positional inverted index of the training tokens.

The index is stored in blocks of documents, one row for each term of a block: its positions in the block's run of
words, ascending, as variable-length differences. A block also has a row (term null) with its documents and where
each begins. So a phrase is looked up within a block, without moving lists between blocks, and only the lists of
terms that some test item has leave the index.

A phrase match is a run of ``phrase`` consecutive words of an item (all of it, if it is shorter) that stands in a
document word for word. Its lists are shifted by their offsets and intersected, the rarest term of all training
tokens first. A proximity match places the item so that at least ``share`` of its words stand within ``slop`` words
of their places, in one document; the placements tried are those of its rarest words, of which any such match must
hold one, each exactly at its place.

Defined cases: null and empty texts hold nothing; items of under ``least`` words (1: of any length) match nothing, a text in a script without
spaces is one word; several items under one item_id, or none, each count, and give one result for each doc_id and item_id, the best of theirs;
documents without id have no result, and the filter tells them by their texts; terms of equal rarity are taken in
item order; very long texts are a block of their own; empty tables give an empty result; further columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, new_path, scratch, written
from .runs import run_lengths
from .sizes import hinted
from .words import chunks, plain, words

INDEX = "block long, term long, n int, postings binary"


@dataclass(frozen=True)
class Matching:
    phrase: int = 13
    slop: int = 3
    share: float = 0.8
    least: int = 1
    #: Words of test items that are sent to the executors at once; a larger benchmark is taken in several rounds.
    round_words: int = 500_000


def pack(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of ascending lists (each starting anew at an index of ``begin``) in 7-bit bytes; where each list starts."""
    gap = values.astype(np.int64)
    gap[1:] -= values[:-1]
    gap[begin] = values[begin]
    size = 1 + (gap >= 1 << 7) + (gap >= 1 << 14) + (gap >= 1 << 21) + (gap >= 1 << 28)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        some = size > k
        out[at[:-1][some] + k] = (gap[some] >> 7 * k & 127) | ((size[some] > k + 1) << 7)
    return out, at[np.append(begin, len(values))]


def unpack(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    return np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << shift, first)) if len(data) else np.zeros(0, np.int64)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Store the postings of all words of ``docs`` at ``path``, and read them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number = TaskContext.get(), 0
        for batch in chunks(batches, most=block_bytes):
            h, offsets = words(batch.column("text"))
            block = ((context.partitionId() if context else 0) << 32) + number
            number += 1
            head = np.concatenate([batch.column("doc_id").to_numpy(), offsets]).astype(np.int64).tobytes()
            order = np.argsort(h, kind="stable")
            begin, n = run_lengths(h[order])
            data, at = pack(order, begin)
            lists = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            term = pa.array(h[order][begin].view(np.int64))
            blocks = lambda k: pa.array(np.full(k, block))
            names = ["block", "term", "n", "postings"]
            yield pa.RecordBatch.from_arrays([blocks(1), pa.nulls(1, pa.int64()), pa.array([batch.num_rows], pa.int32()), pa.array([head], pa.binary())], names=names)
            if len(begin):
                yield pa.RecordBatch.from_arrays([blocks(len(begin)), term, pa.array(n.astype(np.int32)), lists], names=names)

    plain(docs, id_col, text_col).where("doc_id is not null and text is not null").mapInArrow(run, INDEX).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def _items(bench: DataFrame, how: Matching) -> DataFrame:
    """item_id, terms of every item of at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, offsets = words(batch.column("text"))
            keep = np.flatnonzero(np.diff(offsets) >= how.least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep)), pa.array([h[offsets[k] : offsets[k + 1]].view(np.int64) for k in keep], pa.list_(pa.int64()))], names=["item_id", "terms"])

    return bench.mapInArrow(run, "item_id long, terms array<long>")


class Item:
    """One test item: its terms and their offsets from the rarest on."""

    def __init__(self, item_id: int, terms: list[int], frequency: list[int], how: Matching) -> None:
        self.id, self.terms, self.n = item_id, terms, len(terms)
        rank = sorted(range(self.n), key=lambda o: (frequency[o], o))
        m = min(self.n, how.phrase)
        self.windows = [(w, w + m - 1, [o for o in rank if w <= o < w + m]) for w in range(self.n - m + 1)]
        self.need = int(np.ceil(how.share * self.n - 1e-9))
        self.seeds = rank[: self.n - self.need + 1]

    def matches(self, lists: dict[int, np.ndarray], starts: np.ndarray, how: Matching) -> dict[int, list]:
        """By document of the block: kind and the first word of its first match of that kind."""
        found: dict[int, list] = {}
        none = np.zeros(0, np.int64)

        def add(kind: str, at: np.ndarray) -> None:
            for p in at.tolist():
                doc = int(np.searchsorted(starts, p, side="right")) - 1
                best = (kind, p - int(starts[doc]))
                found[doc] = min(found.get(doc, best), best)

        for first, last, order in self.windows:
            at = lists.get(self.terms[order[0]], none) - order[0]
            for o in order[1:]:
                if not len(at):
                    break
                own = lists.get(self.terms[o], none)
                at = at[_has(own, at + o)]
            if len(at):
                add("phrase", (at + first)[np.searchsorted(starts, at + first, side="right") == np.searchsorted(starts, at + last, side="right")])
        seeds = [(lists[self.terms[o]], o) for o in self.seeds if self.terms[o] in lists]
        if not seeds:
            return found
        held = np.concatenate([p for p, _ in seeds])
        at = held - np.concatenate([np.full(len(p), o) for p, o in seeds])
        doc = np.searchsorted(starts, held, side="right") - 1
        at, doc = np.unique(np.stack([at, doc]), axis=1)
        count = np.zeros(len(at), np.int64)
        for o, term in enumerate(self.terms):
            if self.need - count.max(initial=0) > self.n - o:
                return found
            own = lists.get(term, none)
            lo = np.maximum(at + o - how.slop, starts[doc])
            hi = np.minimum(at + o + how.slop, starts[doc + 1] - 1)
            k = np.searchsorted(own, lo)
            count += (k < len(own)) & (own[np.minimum(k, len(own) - 1)] <= hi) if len(own) else 0
        some = count >= self.need
        add("proximity", np.clip(at[some], starts[doc[some]], None))
        return found


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def match(index: DataFrame, bench: DataFrame, how: Matching = Matching(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every match of a test item in an indexed document: doc_id, item_id, kind (phrase before proximity), first_word."""
    spark = index.sparkSession
    names = plain(bench, id_col, text_col).where("text is not null")
    # Items are told apart by a key of their own: several texts may have one id, or none.
    keyed = written(_items(names, how).dropDuplicates(["item_id", "terms"]).withColumn("key", F.monotonically_increasing_id()), "items")
    items = keyed.select(F.col("key").alias("item_id"), "terms")
    terms = written(items.select(F.explode("terms").alias("term")).groupBy("term").count(), "terms")
    lists = written(index.where("term is not null").join(hinted(terms.select("term")), "term", "left_semi").select("block", "term", "n", "postings"), "lists")
    counts = lists.groupBy("term").agg(F.sum("n").alias("n"))
    each = items.select("item_id", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    each = each.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", F.coalesce("n", F.lit(0)).alias("n")))).alias("words"))
    ranked = written(each.select("item_id", F.col("words.term").alias("terms"), F.col("words.n").alias("counts")), "ranked")
    heads = index.where("term is null").select("block", "term", "n", "postings")
    out = None
    for part in _rounds(ranked, how):
        sent = spark.sparkContext.broadcast(part)  # bounded by round_words
        rows = heads.union(lists).repartition("block").sortWithinPartitions("block", F.col("term").asc_nulls_first())
        found = rows.mapInArrow(_matcher(sent, how), "doc_id long, item_id long, kind string, first_word long")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, kind string, first_word long")
    best = F.min(F.struct("kind", "first_word")).alias("best")
    named = out.withColumnRenamed("item_id", "key").join(hinted(written(keyed.select("key", "item_id"), "keys")), "key")
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.kind", "best.first_word")


def _rounds(items: DataFrame, how: Matching) -> Iterator[list[tuple[int, list[int], list[int]]]]:
    part, size = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        part.append((row["item_id"], list(row["terms"]), list(row["counts"])))
        size += len(row["terms"])
        if size >= how.round_words:
            yield part
            part, size = [], 0
    if part:
        yield part


def _matcher(sent, how: Matching):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [Item(*x, how) for x in sent.value]
        wanted = {t for x in items for t in x.terms}
        # A phrase has its rarest term, a proximity match one of the item's seeds: the others can't match in a block.
        led: dict[int, set[int]] = {}
        for i, x in enumerate(items):
            for o in {*x.seeds, *(order[0] for _, _, order in x.windows)}:
                led.setdefault(x.terms[o], set()).add(i)
        head, lists = None, {}

        def answer() -> Iterator[pa.RecordBatch]:
            if head is None or not lists:
                return
            ids, starts = head
            out = [(int(ids[d]), items[i].id, *best) for i in sorted(set().union(*(led.get(t, ()) for t in lists))) for d, best in items[i].matches(lists, starts, how).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "item_id", "kind", "first_word"])

        for batch in batches:
            for term, n, raw in zip(batch.column("term").to_pylist(), batch.column("n").to_pylist(), batch.column("postings").to_pylist()):
                if term is None:
                    yield from answer()
                    all_ = np.frombuffer(raw, np.int64)
                    head, lists = (all_[:n], all_[n:]), {}
                elif term in wanted:
                    lists[term] = unpack(raw)
        yield from answer()

    return run


def contamination(docs: DataFrame, bench: DataFrame, how: Matching = Matching(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", index_path: str | None = None) -> DataFrame:
    """Index ``docs`` (at ``index_path``, or for this once) and match every item of ``bench`` in it."""
    spark: SparkSession = docs.sparkSession
    with scratch(spark):
        path = index_path or new_path(spark, "index")
        return kept(match(build_index(docs, path, id_col, text_col), bench, how, item_col, text_col), "matches")


def without_contaminated(docs: DataFrame, bench: DataFrame, how: Matching = Matching(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` in which no item of ``bench`` was found; all columns as they are. Rows without id are told by their texts."""
    found = written(contamination(docs, bench, how, id_col, text_col, item_col).select(F.col("doc_id").alias("_found")).distinct(), "found")
    left = docs.join(hinted(found), docs[id_col] == found["_found"], "left_anti")
    if not docs.where(docs[id_col].isNull()).limit(1).count():
        return left
    texts = written(docs.where(docs[id_col].isNull() & docs[text_col].isNotNull()).select(F.col(text_col).alias("_text")).distinct().withColumn("_key", F.monotonically_increasing_id()), "unnamed")
    dirty = texts.join(contamination(texts, bench.withColumnRenamed(text_col, "_text"), how, "_key", "_text", item_col).select(F.col("doc_id").alias("_key")).distinct(), "_key")
    bad = written(dirty.select("_text"), "dirty")
    return left.join(bad, left[id_col].isNull() & (left[text_col] == bad["_text"]), "left_anti")
