"""The entry module by itself: without a session, and without the llm folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len([n for n in q if n.startswith('op') or n == 'pipeline']))"


def run(folder):
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()]


def test_queries_are_listed_without_a_session():
    every, llm = run(ROOT)
    assert llm in (0, 14) and every - llm > 100


def test_the_rest_stands_without_the_llm_folders(tmp_path):
    for name in ("lintlake", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    every, llm = run(tmp_path)
    assert llm == 0 and every > 100
