"""The engine without its optional subpackage: copied without those folders, it imports and lists its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_engine_stands_without_training_data_operators(tmp_path):
    leave = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=leave)
    code = (
        "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
        "assert len(q) > 100 and set(s) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; print(len(q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "countloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "countloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
