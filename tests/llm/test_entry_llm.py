"""The driver's entry offers the operators' queries, and the pipeline only where its file is."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
@pytest.mark.parametrize("path", ["", str(ROOT)])
def test_entry_with(tmp_path, gone, path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", *gone))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": f"{path}:{os.environ.get('PYTHONPATH', '')}" if path else ""}
    said = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"
    out = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120, check=True, env=env).stdout.split()
    assert ("pipeline" in out) == (not gone)
    assert sum(name.startswith("op") and "_" in name for name in out) == 13
