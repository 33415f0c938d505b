"""Exact deduplication as a stateful stream.

State, in RocksDB and without expiry, has one entry per content digest: the smallest stable identifier seen, the
locator (file, row) of that content, and how many rows had the digest. Only digests, identifiers and locators are
shuffled to it. Each micro-batch reports the digests that more than one row now has; on such a hit the full bytes
decide: rows count as copies only if their whole texts are equal, so a digest collision never drops a document.
Of every set of copies the row with the smallest doc_id stays.

Defined cases: null texts are never copies of anything and stay; empty texts are copies of one another; rows with a
null doc_id come last in their set; of repeated rows one stays; an empty table gives an empty result; further columns
are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import kept, new_path, scratch, written
from .sizes import hinted

#: Digests that one partition of the state is meant for; each is a store of its own on disk.
STATE_ROWS = 50_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the stream is fed: digest, stable identifier and content locator of every row with a text."""
    try:  # rows of joins and unions, of other formats or of memory have no place in a file
        docs.select("_metadata.file_path", "_metadata.row_index")
        filed = "_metadata" not in docs.columns
    except AnalysisException:
        filed = False
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")) if filed else F.lit(None).cast("struct<file:string,row:bigint>")
    return docs.where(docs[text_col].isNotNull()).select(digest(docs[text_col].cast("string")).alias("digest"), docs[id_col].cast("long").alias("doc_id"), where.alias("locator"))


def keep_state(arriving: DataFrame, hits_path: str, state_path: str) -> StreamingQuery:
    """Run ``arriving``, a stream of arrivals(), into the keyed state; each batch writes its hits to ``hits_path``.

    Restarting it with the same ``state_path`` goes on from the state; a batch that is run again overwrites its own hits.
    """

    def hits(batch: DataFrame, number: int) -> None:
        batch.where("n > 1").select("digest", "first.doc_id", "first.locator", "n").write.mode("overwrite").parquet(f"{hits_path}/batch={number}")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "locator")).alias("first")
    entries = arriving.groupBy("digest").agg(first, F.count("*").alias("n"))
    return entries.writeStream.outputMode("update").foreachBatch(hits).option("checkpointLocation", state_path).trigger(availableNow=True).start()


def hit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that several rows of ``docs`` have, found by streaming its arrivals through the state."""
    with scratch(docs.sparkSession):
        return kept(_hit_digests(docs, id_col, text_col, digest), "hits")


def _hit_digests(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    spark = docs.sparkSession
    base = new_path(spark, "exact-dedup")
    slim = arrivals(docs, id_col, text_col, digest)
    slim.write.parquet(f"{base}/arrivals")
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.read.parquet(f"{base}/arrivals").count() // STATE_ROWS + 1)
    own = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        keep_state(spark.readStream.schema(slim.schema).parquet(f"{base}/arrivals"), f"{base}/hits", f"{base}/state").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_hits(spark, f"{base}/hits", slim)


def read_hits(spark: SparkSession, path: str, slim: DataFrame) -> DataFrame:
    kind = f"digest {slim.schema['digest'].dataType.simpleString()}, doc_id bigint, locator struct<file:string,row:bigint>, n bigint, batch int"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kind).select("digest")
    return spark.read.schema(kind).parquet(path).select("digest").distinct()


def _hit(docs: DataFrame, hits: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` whose digest was hit, in a struct ``_row``, with their text and digest."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs[text_col].cast("string").alias("_text")).withColumn("_digest", digest(F.col("_text")))
    return keyed.join(hinted(hits.withColumnRenamed("digest", "_digest")), "_digest", "left_semi")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row that exact deduplication drops: doc_id, keep_id (the one that stays for it), n_copies (of that text)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = hit_digests(docs, id_col, text_col, digest)
    with scratch(docs.sparkSession):
        return kept(_copies(_hit(slim, hits, "text", digest)), "copies")


def _copies(hit: DataFrame) -> DataFrame:
    # Equal texts are put together before they are shuffled: a text in a third of all rows travels once for each task.
    groups = hit.groupBy("_digest", "_text").agg(F.min("_row.doc_id").alias("keep"), F.count("*").alias("n"))
    per = written(groups.groupBy("_digest").agg(F.count("*").alias("texts"), F.min("keep").alias("keep_id"), F.min("n").alias("n_copies")), "groups")
    ids = hit.groupBy("_digest", F.col("_row.doc_id").alias("doc_id")).agg(F.count("*").alias("c")).join(hinted(per.where("texts = 1")), "_digest")
    spare = ids.withColumn("c", F.col("c") - F.col("doc_id").eqNullSafe(F.col("keep_id")).cast("long")).where("c > 0")
    out = spare.select("doc_id", "keep_id", "n_copies", F.explode(F.expr("sequence(1, c)"))).select("doc_id", "keep_id", "n_copies")
    # Different texts of one digest are ranked by their whole bytes.
    mixed = written(per.where("texts > 1").select("_digest"), "mixed")
    same = Window.partitionBy("_digest", "_text")
    order = same.orderBy(F.col("_row.doc_id").asc_nulls_last())
    ranked = hit.join(hinted(mixed), "_digest", "left_semi").select(F.col("_row.doc_id").alias("doc_id"), F.first("_row.doc_id").over(order).alias("keep_id"), F.count("*").over(same).alias("n_copies"), F.row_number().over(order).alias("rank"))
    return out.union(ranked.where("rank > 1").select("doc_id", "keep_id", "n_copies"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with one row of every set of equal texts; all columns as they are."""
    hits = hit_digests(docs, id_col, text_col, digest)
    named = digest(docs[text_col].cast("string"))
    alone = docs.join(hinted(hits), named == hits["digest"], "left_anti")
    first = F.min_by("_row", F.struct(F.col("_row")[id_col].isNull(), F.col("_row")[id_col])).alias("_row")
    return alone.unionAll(_hit(docs, hits, text_col, digest).groupBy("_digest", "_text").agg(first).select("_row.*"))
