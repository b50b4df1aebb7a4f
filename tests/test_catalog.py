"""Every registered query runs, and those with SQL return what DuckDB does."""

import os

import duckdb
import pandas as pd
import pytest

from attesta.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(repr(tuple(str(v)[:19] if hasattr(v, "year") else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)) for r in plain.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for c in columns:
        for df in (got, want):
            if "date" in c or "deadline" in c:
                df[c] = df[c].astype(str).str[:10]
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"doc_id", "n_findings", "risk"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data_operators(tmp_path):
    """With the subpackage, its tests and the pipeline left out, or the subpackage alone, all else is there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for k, gone in enumerate((("attesta/llm",), ("attesta/llm", "corpus_pipeline.py"))):
        copy = tmp_path / str(k)
        copy.mkdir()
        shutil.copytree(root / "attesta", copy / "attesta", ignore=shutil.ignore_patterns("__pycache__"))
        for f in ("__spark_entry__.py", "corpus_pipeline.py"):
            if (root / f).exists():  # this very copy may be one without them
                shutil.copy(root / f, copy / f)
        for f in gone:
            if (copy / f).exists():
                (shutil.rmtree if (copy / f).is_dir() else Path.unlink)(copy / f)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and q and set(o) <= set(q)"
        subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True)
