"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, jaccard_join, licenses, quality, substring_dedup, suffix_dedup, toxicity, warc

RANKS = os.environ.get("WORLDFOLD_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op2_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), RANKS)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = """
select doc_id, keep_id, n_copies from (
  select doc_id, min(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as n_copies,
         row_number() over (partition by text order by doc_id nulls last) as rn
  from documents where text is not null) where rn > 1"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), labels=_table(spark, sf_dir, "labels"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(_table(spark, sf_dir, "documents"))


ORACLES["op9_ngram_jaccard_join"] = """
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') ws from documents where doc_id is not null),
g as (select distinct doc_id, unnest(case when len(ws) >= 2 then [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] else ws end) as gram from w),
s as (select doc_id, count(*) n from g group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
e as (select o.x, o.y from o join s p on p.doc_id = o.x join s q on q.doc_id = o.y where c >= 0.7 * (p.n + q.n - c) - 1e-9),
r(doc_id, reach) as (select distinct x, x from e union select r.doc_id, e.y from r join e on r.reach = e.x)
select c.doc_id, c.class_id, l.n_links from (select doc_id, min(reach) as class_id from r group by doc_id) c
join (select x as doc_id, count(*) as n_links from e group by x) l on l.doc_id = c.doc_id"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


ORACLES["op8_suffix_array_dedup"] = ORACLES["op10_substring_dedup"] = """
with w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') ws from documents where doc_id is not null),
p as (select doc_id, ws, unnest(range(0, greatest(len(ws) - 49, 0))) as pos from w),
r as (select doc_id, pos, md5(array_to_string(ws[pos + 1 : pos + 50], ' ')) as h from p),
s as (select h from r group by h having min(doc_id) <> max(doc_id)),
f as (select distinct doc_id, pos from r semi join s on r.h = s.h),
c as (select doc_id, pos, case when pos <= lag(pos) over (partition by doc_id order by pos) + 50 then 0 else 1 end as fresh from f),
i as (select doc_id, pos, sum(fresh) over (partition by doc_id order by pos) as island from c)
select doc_id, min(pos) as begin_word, max(pos) + 50 as end_word from i group by doc_id, island"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@query
def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of the whole pages table, nested records flattened to texts so that they can be compared."""
    whole = warc.assemble(warc.from_pages(_table(spark, sf_dir, "pages")))
    return whole.select("capture_id", "target_uri", "n_records", F.col("response.record_id").alias("response_id"), F.col("request.record_id").alias("request_id"), F.element_at("metadata", 1)["record_id"].alias("metadata_id"), F.decode("response.payload", "UTF-8").alias("response_text"), F.decode("request.payload", "UTF-8").alias("request_text"), F.decode(F.element_at("metadata", 1)["payload"], "UTF-8").alias("metadata_text"))


ORACLES["op6_warc_transactions"] = """
select '<urn:metadata:' || page_id || '>' as capture_id, url as target_uri, 3 as n_records,
       '<urn:response:' || page_id || '>' as response_id, '<urn:request:' || page_id || '>' as request_id, '<urn:metadata:' || page_id || '>' as metadata_id,
       'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') as response_text,
       'GET ' || coalesce(url, '') || ' HTTP/1.1' || chr(13) || chr(10) || chr(13) || chr(10) as request_text,
       'htmlLength: ' || length(coalesce(html, '')) as metadata_text
from pages where page_id is not null"""
