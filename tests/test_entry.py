"""The entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "*.md"))
    for gone in (False, True):
        if gone and os.path.exists(tmp_path / "r" / "corpus_pipeline.py"):
            os.remove(tmp_path / "r" / "corpus_pipeline.py")
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
