"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tessera import catalogue

ROOT = Path(__file__).resolve().parent.parent
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        return
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(r[k] for k in at) for r in got.fetchall()]
    near = lambda r: tuple(f"{x:.4f}" if isinstance(x, float) else repr(x) for x in r)
    assert sorted(map(near, rows)) == sorted(map(near, want))


@pytest.mark.parametrize("extra", [(), ("corpus_pipeline.py",)])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, extra):
    for name in ("tessera", "__spark_entry__.py", *extra):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'best_frame_per_object' in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
