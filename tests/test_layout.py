"""The engine without the corpus folders, as a user may have it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_entry_imports_without_the_corpus_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    assert not (copy / "barloom/llm").exists() and (copy / "corpus_pipeline.py").exists() == os.path.exists(f"{ROOT}/corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'touch_reaction' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
