"""Every core query against its SQL, on the smallest tables."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from plumbline.queries import ORACLE_SQL, QUERIES

from .oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small_dir, name):
    assert differences(QUERIES[name], ORACLE_SQL[name], spark, small_dir) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, small_dir, name):
    assert QUERIES[name](spark, small_dir).columns


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


@pytest.mark.parametrize("gone", [["plumbline/llm"], ["plumbline/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_operators(tmp_path, gone):
    root = Path(__file__).resolve().parents[1]
    for name in ("plumbline", "__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).is_dir():
            shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in gone:
        if (tmp_path / name).is_dir():
            shutil.rmtree(tmp_path / name)
        else:
            (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, 'op5_byte_shards' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[1] == "False" and done.stdout.split()[2] == str("plumbline/llm" not in gone and (root / "plumbline/llm").exists())
