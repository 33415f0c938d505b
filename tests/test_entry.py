"""The driver contract: names, SQL, and a run of some queries against DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no sample tables")


def compare(spark, name):
    df = entry.queries()[name](spark, str(SF))
    own = df.toPandas()
    with duckdb.connect() as con:
        for p in SF.glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p if p.is_file() else f'{p}/*.parquet'}'")
        other = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(own.columns)
    assert cols == sorted(other.columns)
    rows = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(own) == rows(other)


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    if entry._HAS_LLM:
        assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries if q.startswith("op")} and "pipeline" in queries


@pytest.mark.parametrize("name", ["visible_asof", "retraction_antijoin", "fold_containment_move", "fold_constitutive", "fold_set_valued", "fold_accrue_asof", "fold_cross_source", "correlation_set", "path_shortest", "who_knows", "salience"])
def test_query_matches_its_sql(spark, name):
    compare(spark, name)


def test_whole_queries_leave_no_entity_out(spark):
    """Beside what SQL holds to some ids, each operator runs over all entities, and says the same of those ids."""
    told = lambda name: [tuple(r) for r in entry.queries()[name](spark, str(SF)).collect()]
    kinds = lambda rows: {r[0].split("_")[0] for r in rows}
    ways = told("path_shortest_whole")
    assert len({a for a, _, _ in ways}) > 2 and set(told("path_shortest")) <= set(ways)
    ranked = told("salience_whole")
    assert kinds(ranked) > kinds(told("salience")) and set(told("salience")) <= set(ranked)
    chains = told("locate_chain_whole")
    assert kinds(chains) > {"obj:part"} and set(told("locate_chain")) <= set(chains)
    assert len({r[1] for r in told("confidence_whole")}) > 1
    assert {k.split(":")[0] for k in kinds(told("budget_topk"))} > {"place", "person"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_operators(tmp_path):
    """The rest imports where the separable folders and corpus_pipeline.py are gone."""
    import shutil
    import subprocess
    import sys

    root = Path(entry.__file__).parent
    shutil.copytree(root / "worldfold", tmp_path / "worldfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
