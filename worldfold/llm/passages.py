"""Repeated passages: from places where documents may agree to the exact spans of words that several documents have."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .runs import run_lengths, whole_runs
from .sizes import hinted
from .words import chunks, window_hashes, words

HASHED = "h long, doc_id long, pos int"


def hashed(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32))], names=["h", "doc_id", "pos"])


def in_several_documents(rows: DataFrame) -> DataFrame:
    """(doc_id, pos) of the rows (h, doc_id, pos) whose h two or more doc_ids have.

    Equal h meet by one shuffle and a sort that can spill; a run of them is read as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "h"):
            if not t.num_rows:
                continue
            doc = t.column("doc_id").to_numpy()
            begin, length = run_lengths(t.column("h").to_numpy())
            several = np.repeat(np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin), length)
            if several.any():
                t = t.select(["doc_id", "pos"]).filter(pa.array(several))
                yield from t.combine_chunks().to_batches()

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc_id long, pos int")


def confirm(docs: DataFrame, anchors: DataFrame, length: int, back: int) -> DataFrame:
    """Spans of ``docs`` (doc_id, text) of ``length`` or more words that stand in several documents.

    ``anchors`` (doc_id, pos), a written table, are words near which two documents may agree: every such run of ``length`` words begins at most
    ``back`` words before one. From these beginnings whole runs are hashed afresh, with another hash than drew the
    anchors; runs that several documents have are the result, overlapping and adjoining ones joined. This extends an anchor's match as far as it goes.
    """
    ids = written(anchors.select("doc_id").distinct(), "ids")
    placed = anchors.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    held = docs.join(hinted(ids), "doc_id", "left_semi").join(placed.hint("merge"), "doc_id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, offsets = words(batch.column("text"))
            lists = batch.column("at")
            at = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, np.maximum(at - back, np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))), 1)
            np.add.at(edge, at + 1, -1)
            hashes = window_hashes(h, length, 7)
            n = len(hashes)
            begin = np.flatnonzero((np.cumsum(edge)[:n] > 0) & (np.arange(n) + length <= offsets[1:][doc[:n]]))
            yield hashed(hashes[begin], batch.column("doc_id").to_numpy()[doc[begin]], begin - offsets[:-1][doc[begin]])

    return spans(in_several_documents(held.mapInArrow(windows, HASHED)), length)


def spans(starts: DataFrame, length: int) -> DataFrame:
    """(doc_id, begin_word, end_word) of the union of ``length`` words from each (doc_id, pos), in maximal spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "doc_id"):
            if not t.num_rows:
                continue
            doc, pos = t.column("doc_id").to_numpy(), t.column("pos").to_numpy().astype(np.int64)
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + length)])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(pos[first]), pa.array(pos[last] + length)], names=["doc_id", "begin_word", "end_word"])

    return starts.repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInArrow(run, "doc_id long, begin_word long, end_word long")
