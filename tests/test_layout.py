"""The library without the corpus operators: everything else imports and stays registered."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def ask(folder: Path) -> list[str]:
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_corpus_operators(tmp_path):
    from siftwell.plans import registry

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert ask(copy) == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL)), "False"]


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "siftwell").rglob("*.py"):
        if "llm" not in path.parts:
            assert "siftwell.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
