"""Queries with SQL give its rows; the entry works without this subpackage."""

import subprocess
import sys

import pytest

from reviewloom.llm import queries

from conftest import DATA, ROOT


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_the_operators_and_the_pipeline():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {x.split("_")[0] for x in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names and set(e.oracle_sql()) <= names


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "reviewloom", tmp_path / "reviewloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'path_tfidf' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=100)


def test_native_plans(spark):
    """No Python in the plans of the native operators."""
    for name in ("op5_url_filters", "op7_mixing"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
