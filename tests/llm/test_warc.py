import gzip

from pyspark.sql import functions as F

from worldfold.llm import warc as w

from .helpers import with_extras


def record(i, kind, to=(), block=b"x", uri="http://a/"):
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{i}>"), ("WARC-Target-URI", uri), ("WARC-Date", "2024-01-01T00:00:00Z"), *[("WARC-Concurrent-To", f"<{t}>") for t in to]]
    return fields, block


RECORDS = [
    record("r1", "response", block=b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\nbody"), record("q1", "request", ["r1"]), record("m1", "metadata", ["q1"], b""), record("m2", "metadata", ["r1"], b"k: v"),
    record("r2", "response"), record("q3", "request", ["gone"]), record("m3", "metadata", ["gone"]), record("i", "warcinfo"),
]


def test_files_to_captures(spark, tmp_path):
    plain = b"".join(w.record_bytes(*r) for r in RECORDS[:4])
    zipped = b"".join(w.record_bytes(*r, compress=True) for r in RECORDS[4:]) + gzip.compress(b"WARC/1.1\r\nWARC-Type: cut")[:-9]
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(zipped)
    (tmp_path / "c.warc").write_bytes(w.record_bytes(*RECORDS[0]))  # r1 again
    (tmp_path / "d.warc").write_bytes(b"")
    rows = w.read_warc(spark, str(tmp_path))
    assert rows.count() == len(RECORDS) + 1
    out = {r["capture_id"]: r for r in w.assemble(with_extras(rows)).collect()}
    assert set(out) == {"<m1>", "<r2>", "<m3>", "<i>"}
    one = out["<m1>"]
    assert one["n_records"] == 4 and one["response"]["record_id"] == "<r1>" and one["request"]["record_id"] == "<q1>"
    assert bytes(one["response"]["payload"]) == RECORDS[0][1] and [m["record_id"] for m in one["metadata"]] == ["<m1>", "<m2>"]
    assert out["<m3>"]["n_records"] == 2 and out["<m3>"]["response"] is None and out["<i>"]["request"] is None
    assert w.assemble(rows.limit(0)).count() == 0


def test_nulls_and_repeats(spark):
    rows = [("a", "response", None, None, None, None, None, None, None), ("a", "response", "u", None, ["b", "b", None, "a"], {}, b"", "f", 1), (None, "request", None, None, ["a"], None, b"", None, None), ("b", None, None, None, [], None, None, None, None)]
    out = w.assemble(spark.createDataFrame(rows, w.RECORD)).collect()
    assert len(out) == 1 and out[0]["n_records"] == 2 and out[0]["request"] is None and out[0]["metadata"] == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://x/", "<p>"), (2, None, None), (None, "u", "h")], "page_id long, url string, html string")
    out = w.assemble(w.from_pages(pages)).orderBy("capture_id")
    assert [(r["n_records"], r["request"] is not None, len(r["metadata"])) for r in out.collect()] == [(3, True, 1)] * 2
    assert out.select(F.decode("response.payload", "UTF-8")).first()[0].endswith("<p>")


def test_lengths_that_are_no_numbers():
    assert [x[2] for x in w.parse(b"WARC/1.1\r\nContent-Length: \xc2\xb2\r\n\r\nxx")] == [b""]


def test_contents_move_once_at_any_size(spark, monkeypatch):
    """Without any broadcast the captures are the same, and payloads of ordinary captures are shuffled once."""
    from worldfold.llm import sizes

    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>" * k) for k in range(40)], "page_id long, url string, html string")
    one = sorted(map(str, w.assemble(w.from_pages(pages)).collect()))
    monkeypatch.setattr(w, "hinted", lambda keys, most=0: keys.hint("merge"))
    out = w.assemble(w.from_pages(pages))
    assert sorted(map(str, out.collect())) == one and len(one) == 40
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
