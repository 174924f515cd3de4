"""The driver's contract holds with and without the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, check=True)
    return out.stdout.split("NAMES")[1].split()


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_subpackage(tmp_path, pipeline):
    """With the subpackage gone, with corpus_pipeline.py gone or still there."""
    shutil.copytree(ROOT / "evidentia", tmp_path / "evidentia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(("corpus_pipeline.py",) if pipeline and (ROOT / "corpus_pipeline.py").exists() else ())):
        shutil.copy(ROOT / name, tmp_path)
    found = names(tmp_path)
    assert "R01_bm25" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "evidentia").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text())
