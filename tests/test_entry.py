"""The catalogue without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTING = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_core_queries_without_the_subpackage(tmp_path, with_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])))
    told = subprocess.run([sys.executable, "-c", LISTING], cwd=copy, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    names = told.stdout.split()
    assert "keyword_summary" in names and len(names) >= 56
    assert not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names) and "pipeline" not in names
