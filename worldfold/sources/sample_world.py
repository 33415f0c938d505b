"""A world told by the relational sample tables: the same log for Spark and for the SQL that checks it.

Sequence numbers are arithmetic on keys, never a window over everything. Amounts are written with fixed decimals, so that their
text is the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sizes import spread, total

_DAY = {
    "spark": "(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) / 86400000000D)",
    "duckdb": "(epoch_us({c}) / 86400000000.0)",
}
_COLUMNS = "seq, entity, attribute, value_type, value, valid_from, valid_to, frame, status"
_T, _O = "cast(null as double)", "cast(null as double)"


def _row(seq: str, entity: str, attribute: str, kind: str, value: str, vf: str = _T, vt: str = _O, frame: str = "'canon'", status: str = "'stated'") -> str:
    named = zip((seq, entity, attribute, f"'{kind}'", value, vf, vt, frame, status), _COLUMNS.split(", "))
    casts = {"seq": "bigint", "valid_from": "double", "valid_to": "double"}
    return ", ".join(f"cast({v} as {casts[n]}) as {n}" if n in casts else f"{v} as {n}" for v, n in named)


def _q(expr: str) -> str:
    """A JSON string."""
    return f"('\"' || {expr} || '\"')"


def _ent(prefix: str, key: str) -> str:
    return f"('{prefix}' || cast({key} as string))"


def _num(expr: str, scale: int = 2) -> str:
    return f"cast(cast({expr} as decimal(18,{scale})) as string)"


#: (name, table, row, condition); each table has its own range of sequence numbers.
_PARTS: list[tuple[str, str, str]] = [
    ("region", _row("1000 + r_regionkey * 2", _ent("place:region_", "r_regionkey"), "'kind'", "literal", "'\"region\"'"), ""),
    ("region", _row("1001 + r_regionkey * 2", _ent("place:region_", "r_regionkey"), "'name'", "literal", _q("r_name")), ""),
    ("nation", _row("2000 + n_nationkey * 4", _ent("place:nation_", "n_nationkey"), "'in'", "entity", _q(_ent("place:region_", "n_regionkey"))), ""),
    ("nation", _row("2001 + n_nationkey * 4", _ent("place:nation_", "n_nationkey"), "'kind'", "literal", "'\"nation\"'"), ""),
    ("nation", _row("2002 + n_nationkey * 4", _ent("place:nation_", "n_nationkey"), "'connects_to'", "entity", _q(_ent("place:nation_", "(n_nationkey + 1) % 25")), "0.0", "case when n_nationkey % 6 = 5 then 10000.0 else null end"), ""),
    ("nation", _row("2003 + n_nationkey * 4", _ent("place:nation_", "n_nationkey"), "'adjacent_to'", "entity", _q(_ent("place:nation_", "(n_nationkey + 5) % 25"))), "n_nationkey % 5 = 0"),
    ("nation", _row("3000 + n_nationkey", _ent("obj:flag_", "n_nationkey"), "'part_of'", "entity", _q(_ent("place:nation_", "n_nationkey"))), ""),
    ("nation", _row("3100 + n_nationkey", _ent("obj:pole_", "n_nationkey"), "'part_of'", "entity", _q(_ent("obj:flag_", "n_nationkey"))), ""),
    ("nation", _row("3200 + n_nationkey", _ent("obj:pole_", "n_nationkey"), "'part_of'", "entity", _q(_ent("place:region_", "n_regionkey"))), "n_nationkey % 8 = 0"),
    ("customer", _row("10000000 + c_custkey * 4", _ent("person:cust_", "c_custkey"), "'in'", "entity", _q(_ent("place:nation_", "c_nationkey")), "1.0"), ""),
    ("customer", _row("10000001 + c_custkey * 4", _ent("person:cust_", "c_custkey"), "'segment'", "literal", _q("c_mktsegment")), ""),
    ("customer", _row("10000002 + c_custkey * 4", _ent("person:cust_", "c_custkey"), "'spend'", "literal", _num("c_acctbal"), _T), ""),
    ("customer", _row("10000003 + c_custkey * 4", _ent("person:cust_", "c_custkey"), "'segment'", "literal", _q("'OTHER'"), _T, _O, "'canon'", "'inferred'"), "c_custkey % 9 = 0"),
    ("supplier", _row("2000000000 + s_suppkey * 4", _ent("person:supp_", "s_suppkey"), "'in'", "entity", _q(_ent("place:nation_", "s_nationkey")), "1.0"), ""),
    ("supplier", _row("2000000001 + s_suppkey * 4", _ent("person:supp_", "s_suppkey"), "'acctbal'", "literal", _num("s_acctbal")), ""),
    ("part", _row("3000000000 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'name'", "literal", _q("p_name")), ""),
    ("part", _row("3000000001 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'name'", "literal", _q("p_brand"), "5.0"), "p_partkey % 4 = 0"),
    ("part", _row("3000000002 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'kind'", "literal", _q("p_type")), ""),
    ("part", _row("3000000003 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'kind'", "literal", "'\"odd\"'", "7.0"), "p_partkey % 11 = 0"),
    ("part", _row("3000000004 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'contents'", "unresolved", "'\"deny\"'"), "p_partkey % 50 = 0"),
    ("part", _row("3000000005 + p_partkey * 8", "('a:' || cast(3000000004 + p_partkey * 8 as string))", "'resolved_by'", "literal", "'[]'"), "p_partkey % 100 = 0"),
    ("part", _row("3000000006 + p_partkey * 8", _ent("obj:part_", "p_partkey"), "'retailprice'", "literal", _num("p_retailprice")), ""),
    ("orders", _row("20000000000 + o_orderkey * 8", _ent("obj:order_", "o_orderkey"), "'state'", "literal", _q("o_orderstatus"), "{day:o_orderdate}"), ""),
    ("orders", _row("20000000001 + o_orderkey * 8", _ent("person:cust_", "o_custkey"), "'spend'", "delta", _num("o_totalprice"), "{day:o_orderdate}"), ""),
    ("orders", _row("20000000002 + o_orderkey * 8", _ent("event:order_", "o_orderkey"), "'kind'", "literal", "'\"order\"'", "{day:o_orderdate}"), ""),
    ("orders", _row("20000000003 + o_orderkey * 8", _ent("event:order_", "o_orderkey"), "'agent'", "entity", _q(_ent("person:cust_", "o_custkey")), "{day:o_orderdate}"), ""),
    ("orders", _row("20000000004 + o_orderkey * 8", _ent("event:order_", "o_orderkey"), "'patient'", "entity", _q(_ent("obj:order_", "o_orderkey")), "{day:o_orderdate}"), "o_orderkey % 2 = 0"),
    ("orders", _row("20000000005 + o_orderkey * 8", "('a:' || cast(20000000000 + o_orderkey * 8 as string))", "'caused_by'", "entity", _q(_ent("event:order_", "o_orderkey"))), "o_orderkey % 3 = 0"),
    ("lineitem", _row("{line}", _ent("obj:part_", "l_partkey"), "'held_by'", "entity", _q(_ent("person:supp_", "l_suppkey")), "{day:l_shipdate}"), ""),
    ("events", _row("40000000000 + event_id * 8", _ent("person:user_", "user_id"), "('last_' || event_type)", "literal", _num("value", 6), "{day:ts}", _O, "case when event_id % 5 = 0 then 'knows:person:user_' || cast(user_id % 7 as string) else 'canon' end", "case event_id % 3 when 0 then 'stated' when 1 then 'observed' else 'inferred' end"), ""),
    ("events", _row("40000000001 + event_id * 8", "('a:' || cast(40000000000 + event_id * 8 as string))", "'source'", "entity", _q(_ent("doc:feed_", "event_id % 4"))), "event_id % 2 = 0"),
    ("events", _row("40000000002 + event_id * 8", "('a:' || cast(40000000000 + event_id * 8 as string))", "'source'", "entity", _q(_ent("person:teller_", "event_id % 4"))), "event_id % 10 = 1"),
    ("events", _row("40000000003 + event_id * 8", "('a:' || cast(40000000000 + event_id * 8 as string))", "'retracts'", "literal", "'true'"), "event_id % 97 = 0"),
    ("events", _row("40000000004 + event_id * 8", _ent("person:user_", "user_id"), "'mood'", "literal", "case user_id % 2 when 0 then '\"calm\"' else '\"restless\"' end", "{day:ts}"), "event_id % 4 = 0"),
    ("users", _row("90000000000 + u * 4", _ent("person:user_", "u"), "'same_as'", "entity", _q(_ent("person:user_", "u + 75"))), "u < 75 and u % 10 = 0"),
    ("users", _row("90000000001 + u * 4", _ent("person:user_", "u"), "'aka'", "entity", _q(_ent("person:user_", "u + 1")), "10000.0"), "u % 15 = 5"),
    ("users", _row("90000000002 + u * 4", _ent("person:user_", "u"), "'distinct_from'", "entity", _q(_ent("person:user_", "u + 1"))), "u % 45 = 5"),
    ("users", _row("90000000003 + u * 4", _ent("person:user_", "u"), "'name'", "literal", _q("'Caller ' || cast(u % 40 as string)")), ""),
]

#: Every column, so that lines of one order are numbered alike everywhere.
_LINE = "select l_partkey, l_suppkey, l_shipdate, 30000000000 + l_orderkey * 100 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as line from {lineitem}"
_USERS = "select distinct user_id as u from {events}"
#: Attributes whose literals are baselines and whose deltas add up.
ACCRUES = ("spend",)


def log_sql(engine: str) -> str:
    """The log as one SELECT; ``{table}`` stands for each table."""

    def text(row: str) -> str:
        for mark in ("o_orderdate", "l_shipdate", "ts"):
            row = row.replace("{day:" + mark + "}", _DAY[engine].format(c=mark))
        return row.replace("{line}", "line")

    parts = []
    for table, row, where in _PARTS:
        source = {"lineitem": f"({_LINE}) lines", "users": f"({_USERS}) users"}.get(table, "{" + table + "}")
        parts.append(f"select {text(row)} from {source}" + (f" where {where}" if where else ""))
    body = "\nunion all\n".join(parts)
    return f"select seq, 'a:' || cast(seq as string) as id, 'world:sample' as world_id, entity, attribute, value_type, value, valid_from, valid_to, frame, status, cast(null as double) as confidence, seq as asserted_at from ({body}) rows"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sample_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    # Lines are numbered within their order, in as many tasks as keep the sort of each in memory.
    tables["lineitem"] = spread(tables["lineitem"], total(tables["lineitem"]), "l_orderkey")
    return spark.sql(log_sql("spark"), **tables)


def duckdb_log() -> str:
    sql = log_sql("duckdb")
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
