"""The rest stands without the optional folders, and without the pipeline file too."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from emberlog import registry

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()); print(len(e.queries()))"


@pytest.mark.parametrize("gone", [("emberlog/llm", "tests/llm"), ("emberlog/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_on_a_copy(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for part in gone:
        at = copy / part
        if at.is_dir():
            shutil.rmtree(at)
        elif at.exists():
            at.unlink()
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(registry.QUERIES)
