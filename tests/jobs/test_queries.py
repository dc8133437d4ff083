"""The registered jobs against their SQL; nothing of them needs the training operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import queries as J


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got, want = J.QUERIES[name](spark, data), con.execute(J.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_jobs_import_no_training_operators():
    code = "import sys, jobs.queries; assert not [m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], check=True)
