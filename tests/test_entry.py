"""The driver's entry works without the folders of the training-data pipeline, whatever the path has."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def offered(tmp_path, gone, path=""):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", *(Path(x).name for x in gone)))
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'impact_preview' in q; print(*sorted(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": path} if path else {})
    return subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120, check=True, env=env).stdout.split()


@pytest.mark.parametrize("gone", [("termlake/llm", "tests/llm"), ("termlake/llm", "tests/llm", "corpus_pipeline.py")])
@pytest.mark.parametrize("path", ["", str(ROOT)])
def test_entry_without(tmp_path, gone, path):
    out = offered(tmp_path, gone, path)
    assert "pipeline" not in out and not any(name.startswith("op1_") for name in out)
