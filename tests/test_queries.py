"""Every registered corpus query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from quirelight.plans import corpus_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, Decimal) else value


def table_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(corpus_queries.SQL))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    df = corpus_queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(corpus_queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table_of(df.columns, df.collect()) == table_of(names, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(corpus_queries.QUERIES) - set(corpus_queries.SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert corpus_queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "quirelight", tmp_path / "quirelight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
