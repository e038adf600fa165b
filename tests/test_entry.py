"""Every query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from commonloom import queries as engine

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, db, name):
    df = engine.QUERIES[name](spark, str(SMALL))
    want = db.sql(engine.SQL[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables aren't here")
def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_engine_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['commonloom.llm'] = None; import __spark_entry__ as e; assert 'tpch_q6' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
