"""The entry module where the training-data operators are gone."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_without_the_operators(tmp_path):
    """Their folder may be left behind with nothing but compiled files in it."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "chronoframe", tmp_path / "chronoframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "chronoframe/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and int(found.stdout) > 150, found.stderr
