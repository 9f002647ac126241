"""Every query runs; those with SQL give DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from glyphmill.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat()[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in got.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, data, name):
    rows = catalogue.queries()[name](spark, data).collect()
    assert rows or name == "train_metrics"


def test_entry_works_without_the_llm_subpackage(tmp_path):
    """As after the driver's deletion: the entry module imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "glyphmill", tmp_path / "glyphmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_panel_metrics' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
