"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from packetloom.plans.file_queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (df[columns].sort_values(columns, ignore_index=True) for df in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry_works_without_the_training_data_operators(spark, tmp_path, data):
    """A copy of the engine alone imports, and has its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/packetloom", tmp_path / "packetloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLES))], said.stderr
