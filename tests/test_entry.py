"""The entry without the optional subpackage, with and without the pipeline's file."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", [("corpus_pipeline.py",), ()])
def test_the_entry_imports_without_the_subpackage(tmp_path, left):
    for name in ("__spark_entry__.py", *left):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "premia", tmp_path / "premia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "premia" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    found, optional, oracles = map(int, done.stdout.split())
    assert found > 100 and oracles > 100 and optional == 0
