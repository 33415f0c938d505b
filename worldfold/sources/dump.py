"""The log as JSON lines, and back: dump, validated build, and an append that numbers rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS, LOG, STATUSES, VALUE_TYPES
from ..storage import exists


def json_lines(log: DataFrame) -> DataFrame:
    """(line) of every row in the order of assertion: one JSON object with all fields, keys sorted, nulls written."""
    return log.orderBy("seq").select(F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"}).alias("line"))


def dump(log: DataFrame, path: str) -> None:
    json_lines(log).write.text(path)


def problems(log: DataFrame) -> list[str]:
    """What keeps rows from being a log: one aggregate over them."""
    of = lambda c, name: F.count_if(c).alias(name)
    r = log.agg(
        F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_distinct("seq").alias("seqs"), F.count_distinct("world_id").alias("worlds"),
        of(~F.col("id").eqNullSafe(F.concat(F.lit("a:"), F.col("seq").cast("string"))), "ids"), of(~F.col("asserted_at").eqNullSafe(F.col("seq")), "times"),
        of(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "statuses"), of(~F.coalesce(F.col("value_type").isin(*VALUE_TYPES), F.lit(False)), "types"),
    ).first()
    found = []
    if r["n"] and (r["lo"], r["hi"], r["seqs"]) != (1, r["n"], r["n"]):
        found.append("seq isn't contiguous from 1")
    if r["worlds"] > 1:
        found.append("several worlds")
    return found + [f"{r[k]} rows with a wrong {name}" for k, name in (("ids", "id"), ("times", "asserted_at"), ("statuses", "status"), ("types", "value_type")) if r[k]]


def build(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Read a dump into a new log table. Lines that aren't objects with exactly the fields, or rows that aren't a log, raise; nothing is written then."""
    if exists(spark, target):
        raise ValueError("the target isn't empty")
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys: Column = F.array_sort(F.json_object_keys("value"))
    bad = lines.where(~keys.eqNullSafe(F.array(*[F.lit(f) for f in sorted(FIELDS)]))).limit(1).count()
    log = lines.select(F.from_json("value", LOG).alias("r")).select("r.*")
    found = ["a line without exactly the log's fields"] * bad + problems(log)
    if found:
        raise ValueError("; ".join(found))
    log.write.parquet(target)
    return spark.read.schema(LOG).parquet(target)


def head(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def numbered(log: DataFrame, rows: DataFrame, world_id: str) -> DataFrame:
    """``rows`` (n, entity, attribute, value_type, value, valid_from, valid_to, frame, status, confidence), n from 1, as the log's next rows."""
    seq = F.lit(head(log)) + F.col("n")
    return rows.select(seq.cast("long").alias("seq"), F.concat(F.lit("a:"), seq.cast("string")).alias("id"), F.lit(world_id).alias("world_id"), "entity", "attribute", "value_type", "value", "valid_from", "valid_to", "frame", "status", "confidence", seq.cast("long").alias("asserted_at"))
