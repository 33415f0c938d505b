"""Byte-level BPE with tiktoken and a local rank file.

Long texts are cut before the regular expression sees them, only where a pre-token must begin whatever surrounds it:
before white space that follows something else. No pattern alternative holds white space after another character,
and the pattern looks only forward, so the pieces of the parts are those of the whole. A run without such a place stays whole.

Decoding concatenates the tokens' raw bytes and only then reads them as UTF-8, so that characters split over tokens survive.

Defined cases: a null text gives null tokens, an empty one an empty list; special-token strings are ordinary text;
null ids, repeated rows and ties are encoded row by row; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .words import chunks, plain

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text from which it is cut, and of a part.
PART = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=\s)")


def load(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> list[str]:
    """``text`` in parts of at least ``size`` characters, each beginning at a safe boundary."""
    if len(text) <= size:
        return [text]
    out, begin = [], 0
    while (cut := _SAFE.search(text, begin + size)) is not None:
        out.append(text[begin : cut.start()])
        begin = cut.start()
    return [*out, text[begin:]]


def encode(text: str, encoding: tiktoken.Encoding, size: int = PART) -> list[int]:
    pieces = parts(text, size)
    return encoding.encode_ordinary(text) if len(pieces) == 1 else [t for p in pieces for t in encoding.encode_ordinary(p)]


def _ship(docs: DataFrame, rank_file: str) -> str:
    """Send the rank file to every executor; its name there."""
    docs.sparkSession.sparkContext.addFile(rank_file)
    return Path(rank_file).name


def encode_documents(docs: DataFrame, rank_file: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, n_tokens, n_bytes, and round_trip: whether the decoded bytes are the text's. No shuffle."""
    name = _ship(docs, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(SparkFiles.get(name), pattern)
        for batch in chunks(batches, most=1 << 20):
            flat, counts, sizes, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    counts.append(-1), sizes.append(None), same.append(None)
                    continue
                tokens = encode(text, encoding)
                raw = text.encode()
                flat.append(np.array(tokens, np.int32))
                counts.append(len(tokens)), sizes.append(len(raw)), same.append(encoding.decode_bytes(tokens) == raw)
            n = np.array(counts, np.int64)
            null = n < 0
            offsets = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens, pa.array(n, mask=null), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "tokens", "n_tokens", "n_bytes", "round_trip"])

    return plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str = PATTERN, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """doc_id, raw (the bytes) and text (null where the bytes aren't UTF-8)."""
    name = _ship(encoded, rank_file)

    def utf8(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else raw.decode()
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load(SparkFiles.get(name), pattern)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                raw = [None if t is None else encoding.decode_bytes(t) for t in part.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(raw, pa.binary()), pa.array([utf8(r) for r in raw], pa.string())], names=["doc_id", "raw", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{tokens_col}` as array<int>) tokens").mapInArrow(run, "doc_id long, raw binary, text string")
