"""Without the training-data folders the entry still imports and gives the other queries."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names; print(any(n.startswith('op') and n[2].isdigit() for n in names), 'pipeline' in names, len(names) > 100)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_llm(tmp_path, pipeline):
    shutil.copytree(ROOT / "marketlens", tmp_path / "marketlens", ignore=lambda folder, names: [n for n in names if n in ("llm", "__pycache__")])
    for name in ("__spark_entry__.py", *(("corpus_pipeline.py",) if pipeline and (ROOT / "corpus_pipeline.py").is_file() else ())):
        shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == ["False", "False", "True"]
