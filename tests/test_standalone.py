"""The rest of the repository without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_operators(tmp_path, gone):
    for name in ("tallyrack", "workload", "tools"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    say = "import __spark_entry__ as e; q = set(e.queries()); print(len(q) > 90, any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= q)"
    run = subprocess.run([sys.executable, "-c", say], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert run.stdout.split() == ["True", "False", "True"], run.stderr


def test_nothing_else_imports_them():
    for path in [*(ROOT / "tallyrack").rglob("*.py"), *(ROOT / "workload").rglob("*.py"), *(ROOT / "tools").rglob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tallyrack.llm" not in path.read_text(), path
