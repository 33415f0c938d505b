"""Suffix-array deduplication by a distributed merge sort that knows common prefixes.

Each task sorts the suffixes of its documents into runs and front-codes them: every suffix is stored as the length
that it shares with the one before, and the rest. Pages of these runs are exchanged by key range (cut where a range ends) and come in the order
of their first keys; pages are decoded as the merge reaches them, and in each range the
runs meet in a loser tree in which each loser holds its common prefix with the winner that beat it, so that two
suffixes are compared only from the first letter that isn't known to be equal. Neighbours in the merged order that agree
throughout come out with no further comparison.

The array is sparse, and its order bounded, without loss for runs of ``length`` words: suffixes begin at the minima
of the hashes of ``gram`` words in every ``window`` such grams, so equal texts begin suffixes at the same places, and every run of
``length`` words has one within its first ``window`` places; ``length - window + 1`` words are left from there, which is as far as
suffixes are sorted. Around suffixes that agree so far in several documents the match is extended both ways.

Spans and defined cases are those of substring_dedup.py: nothing for null, empty and short texts and null ids, rows
repeated under one doc_id are one document, empty tables give empty results, further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, kept, new_path, scratch, settled
from .passages import confirm
from .words import _LUT, chunks, plain, trim, window_hashes, words

PAGE = "run long, page int, first binary, last binary, n int, shared binary, size binary, rest binary, doc_ids binary, pos binary"


@dataclass(frozen=True)
class Sparse:
    length: int = 50
    gram: int = 8
    window: int = 34
    page: int = 512
    #: Bytes of text whose suffixes a worker sorts at once.
    run: int = 16 << 20

    def __post_init__(self) -> None:
        if self.depth < self.gram:
            raise ValueError("length must be at least gram + window - 1")

    @property
    def depth(self) -> int:
        return self.length - self.window + 1


def sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``w`` neighbours."""
    if len(a) < w:
        return a[:0]
    done = 1
    while done < w:
        step = min(done, w - done)
        a = pick(a[:-step], a[step:])
        done += step
    return a


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some ``w`` neighbours; of equal ones all."""
    least = sliding(h, w, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    pad = np.zeros(w - 1, h.dtype)
    return np.flatnonzero(sliding(np.concatenate([pad, least, pad]), w, np.maximum) == h)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` letters aren't looked at."""
    if a == b:
        return len(a)
    end, at = min(len(a), len(b)), known
    while at < end:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            n = min(len(x), len(y))
            diff = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (diff.bit_length() + 7) // 8
        at += 32
    return end


def merged(runs: list[Iterator[tuple[bytes, int, object]]]) -> Iterator[tuple[bytes, int, object]]:
    """The runs' (key, prefix shared with the key before, payload) in one order, in the same form: a loser tree."""
    size = 1
    while size < len(runs):
        size *= 2
    nothing: Iterator = iter(())
    runs = [*runs, *[nothing] * (size - len(runs))]
    now: list = [next(r, None) for r in runs]
    loser, held = [0] * size, [0] * size

    def duel(i: int, h: int, j: int, g: int) -> tuple[int, int, int, int]:
        """Winner and its known prefix with the last output, loser and its common prefix with the winner."""
        x, y = now[i], now[j]
        if x is None or y is None:
            return (j, g, i, 0) if x is None else (i, h, j, 0)
        if h != g:
            return (i, h, j, g) if h > g else (j, g, i, h)
        a, b = x[0], y[0]
        n = common(a, b, h)
        return (i, h, j, n) if n == len(a) or n < len(b) and a[n] < b[n] else (j, g, i, n)

    winner = {size + i: (i, 0) for i in range(size)}
    for node in range(size - 1, 0, -1):
        i, h, loser[node], held[node] = duel(*winner[2 * node], *winner[2 * node + 1])
        winner[node] = (i, h)
    i, h = winner[1]
    while (item := now[i]) is not None:
        yield item[0], h, item[2]
        now[i] = new = next(runs[i], None)
        h = 0 if new is None else new[1]
        node = (size + i) >> 1
        while node:
            j, g = loser[node], held[node]
            if now[j] is not None:
                i, h, loser[node], held[node] = duel(i, h, j, g)
            node >>= 1


def _suffixes(batch: pa.RecordBatch, how: Sparse) -> Iterator[tuple[bytes, int, int]]:
    """(key, doc_id, first word) of every suffix of the sparse array."""
    h, offsets, data, s, e, _ = words(batch.column("text"), spans=True)
    at = minima(window_hashes(h, how.gram), how.window)
    if not len(at):
        return
    doc = np.searchsorted(offsets, at, side="right") - 1
    size = np.diff(offsets)
    keep = (at + how.depth <= offsets[1:][doc]) & (size[doc] >= how.length)
    at, doc = at[keep], doc[keep]
    word = _LUT[data]
    kept = word.copy()
    kept[1:] |= word[:-1]  # a word and one space
    place = np.cumsum(kept) - 1
    text = np.where(word, data, 32).astype(np.uint8)[kept].tobytes()
    ids = batch.column("doc_id").to_numpy()[doc]
    for a, b, i, p in zip(place[s[at]].tolist(), (place[e[at + how.depth - 1] - 1] + 1).tolist(), ids.tolist(), (at - offsets[:-1][doc]).tolist()):
        yield text[a:b], i, p


def front_coded(run: list[tuple[bytes, int, int]], number: int, page: int) -> Iterator[pa.RecordBatch]:
    for k, begin in enumerate(range(0, len(run), page)):
        part = run[begin : begin + page]
        shared, rest, last = [], [], b""
        for key, _, _ in part:
            n = common(last, key, 0)
            shared.append(n), rest.append(key[n:])
            last = key
        i32 = lambda x: np.array(x, np.int32).tobytes()
        row = [number, k, part[0][0], part[-1][0], len(part), i32(shared), i32([len(r) for r in rest]), b"".join(rest), np.array([x[1] for x in part], np.int64).tobytes(), i32([x[2] for x in part])]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[x.split()[0] for x in PAGE.split(", ")])


def decoded(page: dict) -> list[tuple[bytes, int, tuple[int, int]]]:
    """(key, prefix shared with the key before, (doc_id, first word)) of every suffix of a page."""
    out, key, at, rest = [], b"", 0, page["rest"]
    shared, size = np.frombuffer(page["shared"], np.int32).tolist(), np.frombuffer(page["size"], np.int32).tolist()
    for n, m, i, p in zip(shared, size, np.frombuffer(page["doc_ids"], np.int64).tolist(), np.frombuffer(page["pos"], np.int32).tolist()):
        key = key[:n] + rest[at : at + m]
        at += m
        out.append((key, n, (i, p)))
    return out


def sorted_runs(slim: DataFrame, how: Sparse, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, number, held, size = TaskContext.get(), 0, [], 0
        name = lambda: ((context.partitionId() if context else 0) << 24) + number
        for batch in chunks(batches):
            held.extend(_suffixes(batch, how))
            size += batch.nbytes
            if size > how.run:  # a run fits in a worker's memory
                held.sort()
                yield from front_coded(held, name(), how.page)
                number, held, size = number + 1, [], 0
        held.sort()
        yield from front_coded(held, name(), how.page)

    slim.mapInArrow(run, PAGE).write.parquet(path)
    return slim.sparkSession.read.schema(PAGE).parquet(path)


def in_order(pages: Iterator[dict], most: int) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """All suffixes of the pages, which come in the order of their first keys, merged: (key, prefix shared with the one before, payload).

    Of each run only what may still be needed is held: whenever ``most`` bytes of pages wait, everything up to the first key
    of the next page goes through the tree; a key that repeats without end streams by.
    """
    waiting: dict[int, list] = {}
    before, size = b"", 0

    def settle(high: bytes | None) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
        nonlocal before
        heads = []
        for run, held in list(waiting.items()):
            cut = len(held) if high is None else bisect_right(held, high, key=lambda x: x[0])
            if cut:
                heads.append(iter(held[:cut]))
            if cut < len(held):
                waiting[run] = held[cut:]
            else:
                del waiting[run]
        for k, (key, n, payload) in enumerate(merged(heads)):
            yield key, n if k else common(before, key, 0), payload
            before = key

    for page in pages:
        if size > most:
            yield from settle(page["first"])
            size = 0
        held, more = waiting.setdefault(page["run"], []), decoded(page)
        if held:
            more[0] = (more[0][0], common(held[-1][0], more[0][0], 0), more[0][2])
        held.extend(more)
        size += len(page["rest"]) + 12 * page["n"]
    yield from settle(None)


def agreeing(ordered: Iterator[tuple[bytes, int, tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """(doc_id, first word) of the suffixes whose key another document has too; a group is let go as soon as a second document is seen."""
    last, group, several = None, [], False
    for key, n, payload in ordered:
        if last is None or n < len(key) or n < len(last):
            group, several = [], False
        last = key
        if several:
            yield payload
            continue
        group.append(payload)
        if payload[0] != group[0][0]:
            yield from group
            group, several = [], True


def agreeing_suffixes(slim: DataFrame, how: Sparse) -> DataFrame:
    """(doc_id, pos) of the suffixes that agree to the depth with one of another document."""
    spark = slim.sparkSession
    path = new_path(spark, "suffix-runs")
    pages = sorted_runs(slim, how, path)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = splitters(pages, parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every page under the range that it is in; one across several ranges is cut between them, so that no suffix is sent twice."""
        for batch in batches:
            low = [bisect_right(bounds, x) for x in batch.column("first").to_pylist()]
            high = [bisect_right(bounds, x) for x in batch.column("last").to_pylist()]
            whole = np.array(low) == np.array(high)
            some = batch.filter(pa.array(whole))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(low, np.int32)[whole]), *some.columns], names=["part", *some.schema.names])
            for page in batch.filter(pa.array(~whole)).to_pylist():
                keys = [(key, i, p) for key, _, (i, p) in decoded(page)]
                cuts = [0, *(bisect_left(keys, (bounds[k],)) for k in range(bisect_right(bounds, page["first"]), bisect_right(bounds, page["last"]))), len(keys)]
                for a, b in zip(cuts, cuts[1:]):
                    for cut in front_coded(keys[a:b], page["run"], how.page):
                        part = bisect_right(bounds, cut.column("first")[0].as_py())
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *cut.columns], names=["part", *cut.schema.names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
        try:
            for _, pages in groupby(rows, key=lambda x: x["part"]):
                found = agreeing(in_order(pages, how.run // 8))
                while out := list(islice(found, 50_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32())], names=["doc_id", "pos"])
        finally:
            trim()

    exchanged = pages.mapInArrow(place, "part int, " + PAGE).repartition(parts, "part").sortWithinPartitions("part", "first", "run", "page")
    found = settled(exchanged.mapInArrow(merge, "doc_id long, pos int"), "agreeing")
    drop(spark, path)
    return found


def splitters(pages: DataFrame, parts: int) -> list[bytes]:
    """First keys of pages that cut all suffixes into about ``parts`` equal ranges: ``parts - 1`` keys reach the driver."""
    cut = pages.repartitionByRange(parts, "first").select("first", F.spark_partition_id().alias("part"))
    return sorted({bytes(r["low"]) for r in cut.groupBy("part").agg(F.min("first").alias("low")).collect()})[1:]


def repeated_spans(docs: DataFrame, how: Sparse = Sparse(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin_word, end_word of every maximal span covered by runs of ``length`` words that several documents have."""
    slim = plain(docs, id_col, text_col).where("doc_id is not null and text is not null")
    with scratch(docs.sparkSession):
        return kept(confirm(slim, agreeing_suffixes(slim, how), how.length, how.window - 1), "spans")
