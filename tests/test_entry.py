"""The entry works without the optional subpackage, with and without the pipeline's file."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_part(tmp_path, pipeline):
    skipped = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(*skipped))
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert "llm" not in {p.name for p in (tmp_path / "copy").rglob("*")}
