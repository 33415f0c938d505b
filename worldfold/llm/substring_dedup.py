"""Substring deduplication by difference-cover anchors.

The positions of a document whose index modulo a period is in a difference cover are anchors. Whatever two positions
two documents agree from, some shift smaller than the period puts both on the cover, so two equal runs of ``length``
words share an aligned pair of anchors whose next ``length - period + 1`` words are equal too. Only those windows, 6 in
31 of all, are hashed and brought together; around windows that several documents have the match is extended.

Words are numbered from 0 within a document (see words.py); spans are half open. Hashes have 64 bits, and a span rests on two
independent ones of its words.

Defined cases: null and empty texts, texts of under ``length`` words and rows with a null doc_id have no span; rows repeated
under one doc_id are one document, and a run that only one document has, even twice, is none; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import kept, scratch, settled
from .passages import HASHED, confirm, hashed, in_several_documents
from .words import chunks, plain, window_hashes, words


@dataclass(frozen=True)
class Cover:
    """Every residue modulo ``period`` is a difference of two of ``residues``."""

    length: int = 50
    period: int = 31
    residues: tuple[int, ...] = (1, 5, 11, 24, 25, 27)

    def __post_init__(self) -> None:
        if {(a - b) % self.period for a in self.residues for b in self.residues} != set(range(self.period)):
            raise ValueError("the residues don't cover all differences")
        if self.length < self.period:
            raise ValueError("length must be at least the period")

    @property
    def window(self) -> int:
        return self.length - self.period + 1


def repeated_spans(docs: DataFrame, cover: Cover = Cover(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin_word, end_word of every maximal span covered by runs of ``length`` words that several documents have."""
    slim = plain(docs, id_col, text_col).where("doc_id is not null and text is not null")
    on = np.zeros(cover.period, bool)
    on[list(cover.residues)] = True

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, offsets = words(batch.column("text"))
            hashes = window_hashes(h, cover.window)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))[: len(hashes)]
            pos = np.arange(len(hashes)) - offsets[:-1][doc]
            size = np.diff(offsets)[doc]
            at = np.flatnonzero(on[pos % cover.period] & (pos + cover.window <= size) & (size >= cover.length))
            yield hashed(hashes[at], batch.column("doc_id").to_numpy()[doc[at]], pos[at])

    with scratch(docs.sparkSession):
        agreeing = settled(in_several_documents(slim.mapInArrow(anchors, HASHED)), "anchors")
        return kept(confirm(slim, agreeing, cover.length, cover.period - 1), "spans")
