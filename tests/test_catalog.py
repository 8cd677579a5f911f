"""Registered queries against their DuckDB SQL on the smallest tables, and the entry without its optional part."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from hushgrid.plans import base, catalog

DATA = Path(os.environ.get("HUSHGRID_TEST_DATA", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = Path(__file__).resolve().parents[1]


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    clean = lambda x: round(float(x), 6) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(clean(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    base.importable(spark)
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO / "hushgrid", tmp_path / "hushgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pii_exposure_by_document' in q and not any(k.startswith('op1') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
