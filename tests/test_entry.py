"""The driver contract without the subpackage for training data, in a copy of the repository."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("leave_empty", [False, True])
@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_without_llm(tmp_path, leave_empty, with_pipeline):
    shutil.copytree(ROOT / "quarrymill", tmp_path / "quarrymill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if leave_empty:  # a folder that only held compiled files
        (tmp_path / "quarrymill" / "llm" / "__pycache__").mkdir(parents=True)
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline):
        shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
