"""WARC transactions: request, response and metadata records joined through concurrent-to identifiers.

Records are parsed from files (one member or the whole file compressed with gzip, or plain) into rows; a capture is the
connected set of records that name each other in WARC-Concurrent-To, whichever of them does, through any record in between.
It is one nested row: the response (or revisit, or resource), the request, and all metadata records.

Records name their partners directly, or through a record that both name, so a few rounds of taking the smallest
identifier in reach settle every capture; rounds go on until none changes. Only identifiers are shuffled in them; contents meet once,
in one grouping by capture.

Defined cases: records without identifier are left out (nothing can name them); identifiers that no record has are passed over;
a record that stands twice under one identifier counts once, the one of the smallest file and offset (then content) staying; records that
nothing concerns are captures of their own; of several responses or requests in a capture the one of the smallest
identifier is given, and all are counted; null and empty payloads and header maps are kept as they are; empty tables give
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, scratch, written
from .sizes import hinted

RECORD = "record_id string, type string, target_uri string, date string, concurrent_to array<string>, headers map<string,string>, payload binary, file string, offset long"
MAIN = ("response", "revisit", "resource")
_HEAD = re.compile(rb"WARC/\d+\.\d+\r?\n")


def parse(data: bytes) -> Iterator[tuple[int, list[tuple[str, str]], bytes]]:
    """(offset, headers, block) of every record of an uncompressed WARC file; a truncated last record has what is there."""
    at = 0
    while (head := _HEAD.search(data, at)) is not None:
        end = data.find(b"\r\n\r\n", head.end())
        gap = 4
        if end < 0:
            end, gap = data.find(b"\n\n", head.end()), 2
        if end < 0:
            return
        fields: list[tuple[str, str]] = []
        for line in data[head.end() : end].decode("utf-8", "replace").splitlines():
            if line[:1] in " \t" and fields:
                fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
            elif ":" in line:
                name, value = line.split(":", 1)
                fields.append((name.strip().lower(), value.strip()))
        size = next((int(v) for k, v in fields if k == "content-length" and v.isascii() and v.isdigit()), 0)
        yield head.start(), fields, data[end + gap : end + gap + size]
        at = end + gap + size


def unpacked(data: bytes) -> bytes:
    """``data`` without gzip, member by member; a damaged end is left off."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files at ``path``. A file is a task's unit, as archives are cut to about 1 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows: list[tuple] = []
                for offset, fields, block in parse(unpacked(content)):
                    one = dict(reversed(fields))
                    rows.append((one.get("warc-record-id"), one.get("warc-type"), one.get("warc-target-uri"), one.get("warc-date"), [v for k, v in fields if k == "warc-concurrent-to"], list(one.items()), block, name, offset))
                    if len(rows) == 256:
                        yield _records(rows)
                        rows = []
                if rows:
                    yield _records(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").repartition("path").mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 4, pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def record_bytes(fields: list[tuple[str, str]], block: bytes, compress: bool = False) -> bytes:
    """One WARC/1.1 record, as a gzip member if ``compress``."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw) if compress else raw


def captures(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): the smallest record id that each record is joined with."""
    ids = records.where("record_id is not null").select("record_id", "concurrent_to")
    named = ids.select("record_id", F.explode("concurrent_to").alias("other")).where("other is not null and other <> record_id")
    edges = named.select(F.col("record_id").alias("a"), F.col("other").alias("b"))
    both = written(edges.union(edges.select("b", "a")).distinct(), "concurrent")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("capture_id")), "captures")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("capture_id").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        via = labels.select(F.col("a").alias("capture_id"), F.col("capture_id").alias("via"))
        new = labels.join(near, "a").join(via, "capture_id", "left").select("a", F.least("capture_id", "near", "via").alias("new"), "capture_id")
        new = written(new.select("a", F.col("new").alias("capture_id"), (F.col("new") < F.col("capture_id")).alias("changed")), "captures")
        labels = new.select("a", "capture_id")
        if not new.where("changed").limit(1).count():
            break
    # An identifier that no record has may be the smallest of its capture: name captures by a record that there is.
    held = ids.select("record_id").distinct().join(labels, F.col("record_id") == F.col("a"), "left").select("record_id", F.coalesce("capture_id", "record_id").alias("via"))
    real = held.groupBy("via").agg(F.min("record_id").alias("capture_id"))
    return held.join(real, "via").select("record_id", "capture_id")


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, date, response, request, metadata (all, by id), n_records.

    A record's content goes to the identifier that it names first, or to its own if it names none: records that meet there are of
    one capture, and most captures are whole there. Only those of several such places are moved once more.
    """
    fields = ["record_id", "type", "target_uri", "date", "headers", "payload"]
    slim = records.where("record_id is not null").select(*fields, "concurrent_to", "file", "offset")
    place = F.coalesce(F.get(F.filter("concurrent_to", lambda x: x.isNotNull()), 0), "record_id")
    order = F.struct(F.coalesce("file", F.lit("")), F.coalesce("offset", F.lit(-1)), F.coalesce("payload", F.lit(b"")), F.coalesce("type", F.lit("")), F.coalesce("target_uri", F.lit("")), F.coalesce("date", F.lit("")))
    with scratch(records.sparkSession):
        repeated = kept(slim.groupBy("record_id").count().where("count > 1").select("record_id"), "repeated")
        of_capture = written(captures(slim), "captures")
        # A repeated record is placed by its own identifier.
        places = slim.join(hinted(repeated), "record_id", "left_anti").select("record_id", place.alias("place")).union(repeated.select("record_id", "record_id"))
        met = written(places.join(hinted(of_capture), "record_id").select("place", "capture_id").distinct(), "met")
        several = written(met.groupBy("capture_id").count().where("count > 1").select("capture_id", F.lit(True).alias("several")), "several")
        met = kept(met.join(hinted(several), "capture_id", "left").select("place", "capture_id", F.coalesce("several", F.lit(False)).alias("several")), "places")
    alone = slim.join(hinted(repeated), "record_id", "left_anti").select(place.alias("place"), F.struct(*fields).alias("r"))
    one = alone.union(slim.join(hinted(repeated), "record_id", "left_semi").groupBy("record_id").agg(F.min_by(F.struct(*fields), order).alias("r")).select("record_id", "r"))
    pieces = one.groupBy("place").agg(F.collect_list("r").alias("rs")).join(met.hint("merge"), "place")
    out = pieces.where("not several").select("capture_id", "rs")
    if met.where("several").limit(1).count():
        out = out.union(pieces.where("several").groupBy("capture_id").agg(F.flatten(F.collect_list("rs")).alias("rs")))

    def by_id(x: Column, y: Column) -> Column:
        return F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)

    def first(*kinds: str) -> Column:
        return F.get(F.filter("rs", lambda r: r["type"].isin(*kinds)), 0)

    out = out.select("capture_id", F.array_sort("rs", by_id).alias("rs"))
    metadata = F.transform(F.filter("rs", lambda r: r["type"] == "metadata"), lambda r: F.struct(r["record_id"].alias("record_id"), r["headers"].alias("headers"), r["payload"].alias("payload")))
    least = lambda name: F.array_min(F.transform("rs", lambda r: r[name]))
    out = out.select("capture_id", first(*MAIN).alias("response"), first("request").alias("request"), metadata.alias("metadata"), F.size("rs").cast("long").alias("n_records"), least("target_uri").alias("uri"), least("date").alias("first_date"))
    return out.select("capture_id", F.coalesce("response.target_uri", "uri").alias("target_uri"), F.coalesce("response.date", "first_date").alias("date"), "response", "request", "metadata", "n_records")


def from_pages(pages: DataFrame) -> DataFrame:
    """The records that a crawl of ``pages`` (page_id, url, html) writes: for each a response, and a request and metadata that name it."""
    name = lambda kind: F.concat(F.lit(f"<urn:{kind}:"), F.col("page_id").cast("string"), F.lit(">"))
    none = F.array().cast("array<string>")
    kinds = [
        ("response", none, F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.coalesce("html", F.lit("")))),
        ("request", F.array(name("response")), F.concat(F.lit("GET "), F.coalesce("url", F.lit("")), F.lit(" HTTP/1.1\r\n\r\n"))),
        ("metadata", F.array(name("response")), F.concat(F.lit("htmlLength: "), F.length(F.coalesce("html", F.lit(""))).cast("string"))),
    ]
    rows = F.array(*[F.struct(name(kind).alias("record_id"), F.lit(kind).alias("type"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("date"), to.alias("concurrent_to"), F.create_map(F.lit("warc-type"), F.lit(kind)).alias("headers"), F.encode(body, "UTF-8").alias("payload"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("offset")) for kind, to, body in kinds])
    return pages.where("page_id is not null").select(F.explode(rows).alias("r")).select("r.*")
